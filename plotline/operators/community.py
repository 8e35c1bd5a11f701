"""Linking addresses and building projects in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline import constants as K
from plotline.functions import address as A, text as T
from plotline.functions.text import blank
from plotline.operators.gazetteer import resolve_city
from plotline.operators.stats import join_back, top_per
from plotline.session import stage

# (level, kind of key, confidence, how many candidates, needs a district or city)
_STEPS = (
    (1, "full", 98, 5, False),
    (2, "main", 98, 5, False),
    (3, "number", 90, 5, False),
    (4, "number_main", 90, 5, False),
    (5, "lane", 72, 5, True),
    (6, "road", 40, 10, True),
)


def _link_keys(form: Column) -> dict[str, Column]:
    number = A.up_to_number(form)
    return {
        "full": form,
        "main": A.main_number_form(form),
        "number": number,
        "number_main": A.main_number_form(number),
        "lane": A.up_to_lane(form),
        "road": A.road_in(form),
    }


def _keyed(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per level and key of the linking form ``__form``."""
    keys = _link_keys(F.col("__form"))
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), keys[k].alias("key")) for lv, k, *_ in _STEPS])
    return (
        df.withColumn("__k", F.explode(steps)).select(*keep, "__k.level", "__k.key").where("key <> ''")
    )


def address_queries(queries: DataFrame, text: str = "query_text", gazetteer: DataFrame | None = None) -> DataFrame:
    """Add the linking form, the district and the city of each query address."""
    out = queries.withColumns(
        {
            "__form": A.link_form(F.coalesce(text, F.lit(""))),
            "q_district": A.extract_district(text),
            "q_city": A.extract_city(text),
        }
    )
    return resolve_city(out, gazetteer, district="q_district", city="q_city")


def address_to_community(
    tx: DataFrame, queries: DataFrame, top_n: int = 5, text: str = "query_text",
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Building projects of each address, from the first level that knows any.

    Levels: whole address, the same without the 之 part, up to the house number, that without 之,
    lane, road.  A named district (else the city) must agree.  Transactions are counted per key,
    place and project, and each key keeps its leading projects, before they meet the queries; so
    neither copies of one project nor many queries for one road multiply the work.
    """
    q = address_queries(queries, text, gazetteer)
    by_district = F.concat(F.lit("d:"), "q_district")
    by_city = F.concat(F.lit("c:"), "q_city")
    q = q.withColumn(
        "place", F.when(~blank("q_district"), by_district).when(~blank("q_city"), by_city).otherwise("")
    )
    qk = _keyed(q, ["query_id", "place"])
    need_place = F.col("level").isin(*[lv for lv, _, _, _, need in _STEPS if need])
    qk = stage(qk.where(~need_place | (F.col("place") != "")), "link_keys")
    named = tx.where(~blank("community_name") & ~blank("address"))
    # Equal addresses are counted before their form is made, equal forms after it.
    place = ["community_name", "district", "county_city"]
    facts = named.groupBy(*place, "address").agg(F.count("*").alias("n")).select(*place, A.link_form("address").alias("__form"), "n")
    facts = stage(facts.groupBy(*place, "__form").agg(F.sum("n").alias("n")), "link_forms")
    near = _keyed(facts, ["community_name", "district", "county_city", "n"]).join(
        qk.select("level", "key").distinct(), ["level", "key"], "left_semi"
    )
    places = F.array(
        F.concat(F.lit("d:"), F.coalesce("district", F.lit(""))),
        F.concat(F.lit("c:"), F.coalesce("county_city", F.lit(""))), F.lit(""),
    )
    where = ["level", "key", "place"]
    known = (
        near.withColumn("place", F.explode(places)).join(qk.select(*where).distinct(), where, "left_semi")
        .groupBy(*where, "community_name", "district").agg(F.sum("n").alias("n"))
        .groupBy(*where, "community_name").agg(
            F.sum("n").alias("count"), F.max_by("district", F.struct("n", "district")).alias("district")
        )
    )
    order = [F.col("count").desc(), F.col("community_name")]
    leading = top_per(known, where, order, max(n for _, _, _, n, _ in _STEPS), rank="rank")
    hits = qk.join(leading, where)
    first = F.min("level").over(Window.partitionBy("query_id"))
    best = hits.withColumn("__first", first).where("level = __first")
    conf = F.create_map(*[F.lit(x) for lv, _, c, _, _ in _STEPS for x in (lv, c)])
    cap = F.create_map(*[F.lit(x) for lv, _, _, n, _ in _STEPS for x in (lv, n)])
    return best.where((F.col("rank") <= cap[F.col("level")]) & (F.col("rank") <= top_n)).select(
        "query_id", "community_name", conf[F.col("level")].alias("confidence"), "count", "district", "rank"
    )


def best_link(links: DataFrame) -> DataFrame:
    """(query_id, name): the leading project of each address."""
    return links.where("rank = 1").select("query_id", F.col("community_name").alias("name"))


def manual_rows(manual: DataFrame) -> DataFrame:
    """Rows of the manual mapping in the index's shape."""
    ok = ~blank(T.strip("community_name")) & ~blank(T.strip("address"))
    return manual.where(ok).select(
        T.community_name("community_name").alias("norm"), T.strip("community_name").alias("name"),
        T.strip("address").alias("address"), F.coalesce(T.strip("district"), F.lit("")).alias("district"),
        F.lit("").alias("county_city"), F.lit(0).cast("long").alias("n"), F.lit("manual").alias("origin"),
    )


def community_index(tx: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(norm, name, address, district, county_city, n, origin): trades per project and address."""
    # Equal rows are counted first, then their forms are made and added up.
    raw = tx.groupBy("community_name", "address", "district", "county_city").agg(F.count("*").alias("n"))
    ok = ~blank(T.strip("community_name")) & ~blank(T.strip("address"))
    rows = raw.where(ok).groupBy(
        T.community_name("community_name").alias("norm"), T.strip("community_name").alias("name"),
        T.strip("address").alias("address"), F.coalesce(T.strip("district"), F.lit("")).alias("district"),
        F.coalesce(T.strip("county_city"), F.lit("")).alias("county_city"),
    ).agg(F.sum("n").alias("n")).withColumn("origin", F.lit("db"))
    return rows if manual is None else rows.unionByName(manual_rows(manual))


def community_info(index: DataFrame) -> DataFrame:
    """Per comparison form: smallest spelling, trades, first district and city, number of addresses."""
    first = F.min_by(F.struct("district", "county_city"), F.struct("origin", "name", "address", "district"))
    return (
        index.groupBy("norm")
        .agg(
            F.min("name").alias("name"), F.sum("n").alias("tx_count"), first.alias("f"),
            F.countDistinct("address").alias("addresses"),
        )
        .select("norm", "name", "tx_count", "f.district", "f.county_city", "addresses")
    )


def community_addresses(index: DataFrame, queries: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Exact join on the comparison form: distinct (query_id, norm, address), from both origins."""
    q = queries.select("query_id", T.community_name(keyword).alias("norm")).where("norm <> ''")
    addresses = index.select("norm", "address").distinct()
    return q.join(addresses, "norm").select("query_id", "norm", "address")


def origin_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("origin").agg(
        F.countDistinct("norm").alias("communities"), F.sum("n").cast("long").alias("rows")
    )


# --- all house numbers of a project --------------------------------------
def sibling_numbers(tx: DataFrame, addresses: DataFrame) -> DataFrame:
    """House numbers of the buildings that look like the given one.

    ``addresses``: address_id, district, street, lane, number.  The reference row of an address is
    its transaction with the smallest id; siblings share street, lane, district, floors and
    completion date.  Distinct building features are matched, so addresses of one building share
    the work.  Output (address_id, road, number).
    """
    lane = F.coalesce("lane", F.lit(""))
    rows = tx.where(~blank("street") & ~blank("number")).withColumn("lane", lane)
    where = ["district", "street", "lane"]
    look = where + ["total_floors", "build_date"]
    asked = addresses.withColumn("lane", lane).select("address_id", *where, "number")
    ref = (
        rows.join(asked.select(*where, "number").distinct(), where + ["number"], "left_semi")
        .groupBy(*where, "number").agg(F.min_by(F.struct("total_floors", "build_date"), "id").alias("b"))
        .select(*where, "number", "b.total_floors", "b.build_date")
    )
    with_look = asked.join(ref, where + ["number"]).drop("number")
    wanted = with_look.select(*look).distinct()
    # A building without floors or date matches nothing, as an equality with NULL does not.
    numbers = (
        rows.join(wanted, look, "left_semi")
        .select(*look, F.col("number").try_cast("int").alias("number")).where("number is not null").distinct()
    )
    road = F.concat("street", F.when(F.col("lane") != "", F.concat("lane", F.lit("巷"))).otherwise(""))
    return with_look.join(numbers, look).select("address_id", road.alias("road"), "number").distinct()


def address_ranges(addresses: DataFrame, group: str = "norm", address: str = "address", listed: int = 10) -> DataFrame:
    """Per project and road: count of house numbers, and their text form.

    Up to ``listed`` numbers are spelled out, more become ``first～last號（共n個門牌）``; only the
    numbers to be spelled out are ever gathered.
    """
    a = F.col(address)
    # Written once, read for the counts, the spelled numbers and the roads without any.
    rows = addresses.select(group, a.alias("__a")).distinct().select(
        group, A.road_and_lane("__a").alias("road"), A.house_number("__a").alias("number"), F.col("__a").rlike("|".join(K.CROSSING_WORDS)).alias("crossing")
    ).where("road <> ''")
    rows = stage(rows.distinct(), "house_numbers")
    numbers = rows.where("number > 0").select(group, "road", "number").distinct()
    base = numbers.groupBy(group, "road").agg(
        F.count("*").alias("count"), F.min("number").alias("first"), F.max("number").alias("last")
    )
    few = top_per(numbers, [group, "road"], [F.col("number")], listed).groupBy(group, "road").agg(
        F.sort_array(F.collect_list("number")).alias("numbers")
    )
    out = join_back(base, few, [group, "road"])
    spelled = F.concat("road", F.array_join(F.col("numbers").cast("array<string>"), "、"), F.lit("號"))
    span = F.concat(
        "road", F.col("first").cast("string"), F.lit("～"), F.col("last").cast("string"),
        F.lit("號（共"), F.col("count").cast("string"), F.lit("個門牌）"),
    )
    out = out.select(
        group, "road", "count", "first", "last",
        F.when(F.col("count") <= listed, spelled).otherwise(span).alias("formatted"),
    )
    bare = (
        rows.where((F.col("number") <= 0) & ~F.col("crossing")).select(group, "road").distinct()
        .join(base.select(group, "road"), [group, "road"], "left_anti")
        .select(
            group, "road", F.lit(0).cast("long").alias("count"), F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"), F.concat("road", F.lit("（無門牌號碼）")).alias("formatted"),
        )
    )
    return out.unionByName(bare)


def range_summary(ranges: DataFrame, group: str = "norm", top: int = 5) -> DataFrame:
    """One line per project: its ``top`` largest roads, and how many more there are."""
    largest = top_per(ranges, [group], [F.col("count").desc(), F.col("road")], top, rank="__r")
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("__r", "formatted"))), lambda x: x["formatted"]), "；"
    )
    lines = largest.groupBy(group).agg(text.alias("__text"))
    total = ranges.groupBy(group).agg(F.count("*").alias("roads"), F.sum("count").cast("long").alias("numbers"))
    out = join_back(total, lines, [group])
    more = F.when(
        F.col("roads") > top, F.concat(F.lit("；...還有 "), (F.col("roads") - top).cast("string"), F.lit(" 條路段"))
    ).otherwise("")
    return out.select(group, "roads", "numbers", F.concat("__text", more).alias("summary"))


def misc_places(addresses: DataFrame, group: str = "norm", address: str = "address") -> DataFrame:
    """Distinct addresses that are places (crossings, beside ...) or have no road; shown as they are."""
    a = F.col(address)
    odd = (A.house_number(a) <= 0) | (A.road_and_lane(a) == "")
    place = (A.road_and_lane(a) == "") | a.rlike("|".join(K.MISC_PLACE_WORDS))
    shown = F.coalesce(F.nullif(A.strip_city_district(a), F.lit("")), a)
    return addresses.where(odd & place).select(group, shown.alias("place")).distinct()


# --- crawl bookkeeping and learned rows ----------------------------------
def crawl_items(items: DataFrame, json_col: str = "raw_data") -> DataFrame:
    """Name, address and short name of crawled items, whichever field holds them."""
    names = "buildname name address location addr sq_name short_name sq".split()
    j = F.from_json(json_col, ", ".join(f"{n} string" for n in names))
    out = items.withColumn("__j", j).withColumns(
        {
            "community_name": F.coalesce("__j.buildname", "__j.name", F.lit("")),
            "address": F.coalesce("__j.address", "__j.location", "__j.addr", F.lit("")),
            "short_name": F.coalesce("__j.sq_name", "__j.short_name", "__j.sq", F.lit("")),
        }
    ).drop("__j")
    return out.where(~blank("community_name") | ~blank("address"))


def new_items(items: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Items not stored yet, one per key (insert-or-ignore)."""
    return items.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def open_work(keys: DataFrame, steps: Column, step: str, done: DataFrame) -> DataFrame:
    """Work list: every key with every step of the array ``steps``, less what is done."""
    every = keys.withColumn(step, F.explode(steps))
    return every.join(done, [c for c in every.columns if c in done.columns], "left_anti")
