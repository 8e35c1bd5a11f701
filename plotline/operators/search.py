"""Address and keyword search for a whole table of queries at once.

The structured search has six levels, from the exact house to the whole street.
Queries that ask for the same thing at the same level share one key, every
transaction is matched to distinct keys only, and the result is cut to ``limit``
rows per key *before* it is handed to the queries.  So the work follows the
number of transactions and of distinct keys, never their product.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotline.functions import address as A
from plotline.functions.text import blank
from plotline.operators import filters as P, present as R, textjoin as X
from plotline.operators.cells import in_box
from plotline.operators.stats import join_back, top_per
from plotline.session import stage

_SEP = "\u0001"
LEVELS = (1, 2, 3, 4, 5, 6)
# What rows of one house have in common; such rows answer to the same keys.
HOUSE = ("address", "district", "street", "lane", "alley", "number", "sub_number", "floor")


def numbered(rows: DataFrame, id: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct values of the columns with a ``number_of`` each, and (id, ``number_of``) of the rows, both written.

    Numbers are hashes under the first seed by which no two differing values have the same one.
    """
    # NULLs do not enter a hash.
    values = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    every = stage(rows.select(*columns).distinct(), "distinct_values")
    for seed in itertools.count():
        number = F.xxhash64(F.lit(seed), *values).alias("number_of")
        if not every.groupBy(number).count().where("count > 1").limit(1).count():
            break
    return every.select("*", number), stage(rows.select(id, number), "numbers")


def parse_queries(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add ``q_normal`` and the eight parts ``q_*`` of each search text."""
    staged = queries.withColumn("q_normal", A.normalize(F.coalesce(text, F.lit("")), for_query=True))
    staged = staged.withColumn("__p", A.query_pieces("q_normal"))
    parts = A.query_columns(F.col("__p"))
    return staged.withColumns({f"q_{n}": c for n, c in parts.items()}).drop("__p")


def _key(level: int, *parts) -> Column:
    cols = [F.lit(str(level))] + [F.coalesce(F.col(p), F.lit("")) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(_SEP, *cols)


def query_keys(parsed: DataFrame) -> DataFrame:
    """(query_id, level, key): one row per level the query has the parts for."""
    has = {n: ~blank(f"q_{n}") for n in ("district", "street", "lane", "number")}
    q = lambda n: f"q_{n}"
    keyed = [
        (1, has["district"] & has["number"], [q("district"), q("street"), q("lane"), q("alley"), q("number"), q("floor"), q("sub_number")]),
        (2, has["number"], [q("street"), q("lane"), q("alley"), q("number")]),
        (3, has["district"] & has["lane"], [q("district"), q("street"), q("lane"), q("alley")]),
        (4, has["lane"], [q("street"), q("lane")]),
        (5, has["district"], [q("district"), q("street")]),
        (6, F.lit(True), [q("street")]),
    ]
    options = [F.when(ok, F.struct(F.lit(lv).alias("level"), _key(lv, *ps).alias("key"))) for lv, ok, ps in keyed]
    return (
        parsed.where(has["street"])
        .select("query_id", F.explode(F.array_compact(F.array(*options))).alias("k"))
        .select("query_id", "k.level", "k.key")
    )


def _row_keys(levels) -> Column:
    """All keys a transaction answers to; floor, sub number and alley may be left open by a query."""
    none = F.lit("")
    out = []
    if 1 in levels:
        for fl in ("floor", none):
            for sub in ("sub_number", none):
                out.append((1, _key(1, "district", "street", "lane", "alley", "number", fl, sub)))
    if 2 in levels:
        out.append((2, _key(2, "street", "lane", "alley", "number")))
    if 3 in levels:
        out += [(3, _key(3, "district", "street", "lane", al)) for al in ("alley", none)]
    if 4 in levels:
        out.append((4, _key(4, "street", "lane")))
    if 5 in levels:
        out.append((5, _key(5, "district", "street")))
    if 6 in levels:
        out.append((6, _key(6, "street")))
    return F.array_distinct(F.array(*[k for _, k in out]))


def match_keys(tx: DataFrame, keys: DataFrame, levels=LEVELS) -> DataFrame:
    """Transactions with every distinct query key they answer to (column ``key``).

    Rows of streets nobody asks for are dropped before their keys are built.
    """
    # The street is the second part of level 2, 4 and 6 keys, the third of the others.
    at = F.when(F.col("key").rlike("^[135]"), 2).otherwise(1)
    streets = keys.select(F.get(F.split("key", _SEP), at).alias("street")).distinct()
    wanted = keys.select("key").distinct()
    near = tx.where(~blank("address")).join(streets, "street", "left_semi")
    return near.withColumn("key", F.explode(_row_keys(levels))).join(wanted, "key")


def search_level(tx: DataFrame, parsed: DataFrame, level: int) -> DataFrame:
    """(query_id, id) of one level on its own."""
    keys = query_keys(parsed).where(F.col("level") == level)
    hits = match_keys(tx.select("id", "address", *A.ADDRESS_PARTS[1:2], "street", "lane", "alley", "number", "sub_number", "floor"), keys, (level,))
    return keys.select("query_id", "key").join(hits.select("key", "id"), "key").select("query_id", "id")


def search_structured(
    tx: DataFrame,
    parsed: DataFrame,
    filters: P.Filters | None = None,
    sort_by: str = "date",
    limit: int | None = 200,
) -> DataFrame:
    """First non-empty level per query, with ``level``, ``addr_count`` and ``position``.

    ``addr_count`` counts the rows of the level that share the address, before the filters.
    """
    return _structured(tx, parsed, filters, sort_by, limit)[0]


def _structured(tx, parsed, filters, sort_by, limit) -> tuple[DataFrame, DataFrame]:
    """:func:`search_structured`, and the queries that found something (``query_id``, ``level``, ``key``).

    Rows of equal address and parts answer to the same keys, so they are one row until level and key of each query are known.
    """
    keys = stage(query_keys(parsed), "query_keys")
    computed = R.with_computed(tx)
    computed = computed.withColumn("__ok", F.lit(True) if filters is None else P.computed_filters(filters))
    same = list(HOUSE)
    houses = computed.where(~blank("address")).groupBy(*same).agg(F.count("*").alias("__n"), F.max("__ok").alias("__some"))
    matched = stage(match_keys(houses, keys), "matched_houses")
    alive = matched.where("__some").select("key").distinct()
    best = keys.join(alive, "key", "left_semi").groupBy("query_id").agg(
        F.min(F.struct("level", "key")).alias("b")
    ).select("query_id", "b.level", "b.key")
    best = stage(best, "query_levels")
    needed = matched.join(best.select("key").distinct(), "key", "left_semi")
    counts = needed.groupBy("key", "address").agg(F.sum("__n").alias("addr_count"))
    held = needed.where("__some").select("key", *same).join(counts, ["key", "address"])
    passing = computed.where("__ok").drop("__ok")
    if limit is None:
        held = stage(best.join(held, "key").drop("key"), "held_houses")
        return join_back(passing, held, same, "inner"), best
    rows = join_back(passing, stage(held, "held_houses"), same, "inner")
    rows = top_per(rows, ["key"], R.result_order(sort_by), limit, rank="position")
    return best.join(rows, "key").drop("key"), best


def _addresses(tx: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, address, text, addr_count): each address once, named by its smallest row, with the form that is searched."""
    once = tx.where(~blank("address")).groupBy("address").agg(F.min("id").alias("id"), F.count("*").alias("addr_count"))
    return stage(once.withColumn("text", F.col("address") if form is None else form(F.col("address"))), "addresses")


def _by_text(asked, spelled, addresses, tx, filters, sort_by, limit) -> tuple[DataFrame, DataFrame]:
    """Rows of the addresses that hold a spelling of a query's text, and the texts (``ask``) that have some.

    ``asked``: query_id, ask; ``spelled``: ask, phrase.  Addresses are searched once, counted, and only then meet their rows,
    which are filtered, ordered and cut per distinct search text.
    """
    hits = X.contains_join(addresses, spelled, "id", "text", "ask", "phrase").withColumnRenamed("phrase_id", "ask")
    held = stage(hits.join(addresses, "id").select("ask", "address", "addr_count"), "held_addresses")
    each = held if limit is not None else stage(asked.join(held, "ask"), "asked_addresses")
    rows = each.join(R.with_computed(tx), "address")
    if filters is not None:
        rows = rows.where(P.computed_filters(filters))
    if limit is None:
        return rows.drop("ask"), (held if filters is None else rows).select("ask").distinct()
    rows = stage(top_per(rows, ["ask"], R.result_order(sort_by), limit, rank="position"), "text_rows")
    return asked.join(rows, "ask").drop("ask"), rows.select("ask").distinct()


def _phrase(tx, parsed, filters, sort_by, limit) -> tuple[DataFrame, DataFrame]:
    asked = stage(parsed.select("query_id", F.col("q_normal").alias("ask")), "asked")
    spelled = asked.select("ask", F.col("ask").alias("phrase")).distinct()
    rows, found = _by_text(asked, spelled, _addresses(tx, A.normalize), tx, filters, sort_by, limit)
    return rows, asked.join(found, "ask", "left_semi").select("query_id")


def search_phrase(tx, parsed, filters=None, sort_by="date", limit=200) -> DataFrame:
    """Rows whose *normalised* address contains the normalised search text.

    Queries with the same text share one search.
    """
    return _phrase(tx, parsed, filters, sort_by, limit)[0]


def search_variants(
    tx, queries, filters=None, sort_by="date", limit=200, text: str = "query_text", variants: int | None = None
) -> DataFrame:
    """Rows whose raw address contains a spelling of the text (only the first ``variants`` spellings if that is given)."""
    asked = stage(queries.select("query_id", F.col(text).alias("ask")), "asked")
    asks = asked.select("ask").distinct()
    spelled = asks.select("ask", F.explode(A.variants("ask") if variants is None else F.slice(A.variants("ask"), 1, variants)).alias("phrase"))
    return _by_text(asked, spelled, _addresses(tx), tx, filters, sort_by, limit)[0]


def search_addresses(
    tx: DataFrame,
    queries: DataFrame,
    filters: P.Filters | None = None,
    sort_by: str = "date",
    limit: int | None = 200,
    text: str = "query_text",
) -> DataFrame:
    """Structured search; queries without a row try the phrase; the rest try spelling variants.

    ``method`` says which of the three answered.
    """
    parsed = stage(parse_queries(queries, text), "parsed_queries")
    by_parts, answered = _structured(tx, parsed, filters, sort_by, limit)
    by_parts = by_parts.withColumn("method", F.lit("structured"))
    left = stage(parsed.join(answered.select("query_id").distinct(), "query_id", "left_anti"), "unanswered")
    by_phrase, answered = _phrase(tx, left, filters, sort_by, limit)
    by_phrase = by_phrase.withColumn("method", F.lit("phrase"))
    rest = stage(left.join(answered.distinct(), "query_id", "left_anti"), "unanswered")
    by_variant = search_variants(tx, rest, filters, sort_by, limit, text).withColumn("method", F.lit("variants"))
    return by_parts.unionByName(by_phrase, allowMissingColumns=True).unionByName(
        by_variant, allowMissingColumns=True
    )


def search_shortened(tx: DataFrame, queries: DataFrame, text: str = "query_text", limit: int | None = 200) -> DataFrame:
    """Rows containing the longest of the progressively shortened texts that matches anything."""
    cuts = stage(queries.select("query_id", F.posexplode(A.shortened(text)).alias("step", "phrase")), "shortened")
    # Every text is matched once; the rows of the shorter texts of a query are never handed to it.
    addresses = _addresses(tx, A.normalize)
    hits = X.contains_join(addresses, cuts.select("phrase").distinct(), "id", "text", "phrase", "phrase")
    hits = stage(hits.withColumnRenamed("phrase_id", "phrase").join(addresses.select("id", "address"), "id").drop("id"), "shortened_hits")
    first = cuts.join(hits.select("phrase").distinct(), "phrase").groupBy("query_id").agg(F.min(F.struct("step", "phrase")).alias("f"))
    kept = stage(first.select("query_id", "f.step", "f.phrase").join(hits, "phrase").drop("phrase"), "shortened_rows")
    rows = kept.join(tx, "address")
    return rows if limit is None else top_per(rows, ["query_id"], R.result_order("date"), limit)


def search_names(tx: DataFrame, names: DataFrame, filters: P.Filters | None = None, limit: int | None = 500) -> DataFrame:
    """Rows of given building projects, newest first per query; names asked twice are matched once.

    Where ``names`` has ``q_district``, rows outside the named district go before the limit counts.
    """
    asked = [F.col("name").alias("community_name"), *[c for c in ("q_district",) if c in names.columns]]
    wanted = names.select(*asked).distinct()
    key = wanted.columns
    if "q_district" in key:
        wanted = wanted.withColumn("q_district", F.coalesce("q_district", F.lit("")))
        rows = tx.join(wanted.distinct(), "community_name").where(P.in_district(F.col("q_district")))
    else:
        rows = tx.join(wanted, "community_name", "left_semi")
    if filters is not None:
        rows = rows.where(P.raw_filters(filters))
    rows = (
        rows.withColumn("position", F.lit(None).cast("int")) if limit is None
        else top_per(rows, key, R.result_order("date"), limit, rank="position")
    )
    asks = names.select("query_id", *asked)
    if "q_district" in key:
        asks = asks.withColumn("q_district", F.coalesce("q_district", F.lit("")))
    return asks.join(rows, key).drop("q_district")


def search_area(tx: DataFrame, box: tuple[float, float, float, float], filters: P.Filters | None = None, limit: int | None = 500) -> DataFrame:
    """Rows inside (south, north, west, east), newest first; a table laid out by place is read in part."""
    rows = in_box(tx, box)
    if filters is not None:
        rows = rows.where(P.raw_filters(filters))
    return R.search_columns(R.newest(rows, limit))


def merge_paths(paths: list[DataFrame], limit: int | None = 500) -> DataFrame:
    """Ordered union of result paths (query_id, id, position): the first path that has a row keeps it."""
    ranked = [
        p.select("query_id", "id", F.lit(i).alias("path"), F.col("position").alias("at"))
        for i, p in enumerate(paths)
    ]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    once = every.groupBy("query_id", "id").agg(F.min(F.struct("path", "at")).alias("p")).select(
        "query_id", "id", "p.path", "p.at"
    )
    if limit is None:
        return once
    return top_per(once, ["query_id"], [F.col("path"), F.col("at"), F.col("id")], limit, rank="position")


def keyword_search(
    tx: DataFrame,
    queries: DataFrame,
    linked: DataFrame | None = None,
    filters: P.Filters | None = None,
    limit: int = 500,
    text: str = "query_text",
) -> DataFrame:
    """The whole keyword search: named project or linked project, then address search.

    ``queries`` has ``query_id``, the text and optionally ``community`` (path 0).  ``linked``
    (query_id, name) is the best project of the text's address (path B).  Rows keep their first
    path, must agree with a district named in the text, and are cut to ``limit`` per query.
    """
    paths = []
    parsed = stage(parse_queries(queries, text).select("query_id", "q_district"), "districts")
    if "community" in queries.columns:
        named = queries.where(~blank("community")).select("query_id", F.col("community").alias("name"))
        paths.append(stage(search_names(tx, named.join(parsed, "query_id"), filters, limit), "by_name"))
    if linked is not None:
        link = linked
        if paths:
            link = linked.join(queries.where(~blank("community")).select("query_id"), "query_id", "left_anti")
        paths.append(stage(search_names(tx, stage(link.join(parsed, "query_id"), "links"), filters, limit), "by_link"))
    paths.append(search_addresses(tx, queries, filters, "date", limit, text))
    every = stage(merge_paths(paths, None), "paths")
    rows = every.join(R.search_columns(tx), "id").join(parsed, "query_id")
    kept = rows.where(P.in_district(F.col("q_district"))).drop("q_district")
    return top_per(kept, ["query_id"], [F.col("path"), F.col("at"), F.col("id")], limit, rank="position")
