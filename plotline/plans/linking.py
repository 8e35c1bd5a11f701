"""Queries: addresses to building projects and back, fuzzy names."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import address as A, text as T
from plotline.operators import community as C, names as N
from plotline.plans.fixture import frame, table
from plotline.plans.registry import CTES, query
from plotline.session import stage

_NORM = "upper(translate(trim(community_name), 'Ａｂ', 'Ab'))"

# --- address to project ---------------------------------------------------
CTES["link_queries"] = """
SELECT query_id, query_text, district, street, lane, number FROM query_table
UNION ALL SELECT query_id + 1000000, concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, '999號'), district, street, lane, '999' FROM query_table WHERE query_id % 3 = 0
UNION ALL SELECT query_id + 2000000, concat('臺北市', street, number, '號'), '', street, '', number FROM query_table WHERE query_id % 5 = 0"""
_KEYS = "t.street = q.street AND t.lane = q.lane"
CTES["link_hits"] = f"""
SELECT q.query_id, t.community_name, t.district,
  CASE WHEN {_KEYS} AND t.alley = '' AND t.number = q.number THEN 1 WHEN {_KEYS} AND q.lane <> '' THEN 5 ELSE 6 END AS level
FROM link_queries q JOIN tx_addr t ON t.street = q.street AND t.community_name <> ''
  AND (CASE WHEN q.district <> '' THEN t.district = q.district ELSE t.county_city = '台北市' END)"""


def _link_queries(spark, d):
    q = frame(spark, d, "query_table")
    far = q.where("query_id % 3 = 0").select(
        (F.col("query_id") + 1000000).alias("query_id"),
        F.expr("concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, '999號')").alias("query_text"),
    )
    city = q.where("query_id % 5 = 0").select(
        (F.col("query_id") + 2000000).alias("query_id"), F.expr("concat('臺北市', street, number, '號')").alias("query_text")
    )
    return q.select("query_id", "query_text").unionByName(far).unionByName(city)


_BEST = """
SELECT query_id, community_name, count(*) AS n, level FROM (SELECT *, min(level) OVER (PARTITION BY query_id) AS best FROM link_hits) x
WHERE level = best GROUP BY query_id, community_name, level"""


@query(
    "j8_address_to_community",
    f"""SELECT query_id, community_name, CAST(CASE level WHEN 1 THEN 98 WHEN 5 THEN 72 ELSE 40 END AS INT) AS confidence, n AS count, CAST(rn AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, community_name) AS rn FROM ({_BEST}) b) r WHERE rn <= 5""",
)
def _(spark, d):
    out = C.address_to_community(frame(spark, d, "tx_addr"), _link_queries(spark, d))
    return out.select("query_id", "community_name", "confidence", "count", "rank")


@query(
    "a8_w5_leading_project",
    f"SELECT query_id, community_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, community_name) AS rn FROM ({_BEST}) b) r WHERE rn = 1",
)
def _(spark, d):
    return C.best_link(C.address_to_community(frame(spark, d, "tx_addr"), _link_queries(spark, d), top_n=1))


@query(
    "j8_sub_number_ignored",
    "SELECT query_id, CAST(CASE min(level) WHEN 1 THEN 98 WHEN 5 THEN 72 ELSE 40 END AS INT) AS confidence FROM link_hits GROUP BY query_id",
)
def _(spark, d):
    # Stored houses carry a 之 part that the query does not name.
    stored_rows = frame(spark, d, "tx_addr").withColumn("address", F.expr("replace(address, '號', '之9號')"))
    return C.address_to_community(stored_rows, _link_queries(spark, d), top_n=1).select("query_id", "confidence")


@query(
    "n12_n14_link_forms",
    "SELECT id, district, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number, '號') AS form, CASE WHEN lane <> '' THEN concat(street, lane, '巷') ELSE '' END AS lane_form, street AS road FROM tx_addr",
)
def _(spark, d):
    f = frame(spark, d, "tx_addr").withColumn("form", A.link_form("address"))
    return f.select(
        "id", A.extract_district("address").alias("district"), "form",
        A.up_to_lane("form").alias("lane_form"), A.road_in("form").alias("road"),
    )


# --- project to addresses -------------------------------------------------
def _manual(spark, d):
    return frame(spark, d, "tx_addr").where("id % 40 = 0").select(
        F.concat("address", F.lit("旁")).alias("address"), "community_name", "district", F.lit("").alias("remark")
    )


def _keywords(spark, d):
    """Project names as users type them: whole, lower case, and one character short."""
    names = frame(spark, d, "tx_addr").where("community_name <> ''").groupBy("community_name").agg(F.min("id").alias("id"))
    whole = names.select(F.col("id").alias("query_id"), F.lower("community_name").alias("keyword"))
    cut = names.select((F.col("id") + 1000000).alias("query_id"), F.expr("substr(community_name, 1, length(community_name) - 1)").alias("keyword"))
    odd = names.select((F.col("id") + 2000000).alias("query_id"), F.expr("concat(substr(community_name, 2), '新')").alias("keyword"))
    long_ = names.select((F.col("id") + 3000000).alias("query_id"), F.expr("concat('台北', community_name, '二期')").alias("keyword"))
    return whole.unionByName(cut).unionByName(odd).unionByName(long_)


CTES["keywords"] = """
SELECT min(id) AS query_id, lower(community_name) AS keyword FROM tx_addr WHERE community_name <> '' GROUP BY community_name
UNION ALL SELECT min(id) + 1000000, substr(community_name, 1, length(community_name) - 1) FROM tx_addr WHERE community_name <> '' GROUP BY community_name
UNION ALL SELECT min(id) + 2000000, concat(substr(community_name, 2), '新') FROM tx_addr WHERE community_name <> '' GROUP BY community_name
UNION ALL SELECT min(id) + 3000000, concat('台北', community_name, '二期') FROM tx_addr WHERE community_name <> '' GROUP BY community_name"""
CTES["name_index"] = f"""
SELECT DISTINCT {_NORM} AS norm, trim(address) AS address FROM tx_addr WHERE community_name <> ''
UNION SELECT {_NORM}, concat(address, '旁') FROM tx_addr WHERE id % 40 = 0 AND community_name <> ''"""
_KW = "upper(translate(keyword, 'Ａａｂ', 'Aab'))"


@query("j9_u2_community_addresses", f"SELECT k.query_id, n.norm, n.address FROM keywords k JOIN name_index n ON n.norm = {_KW}")
def _(spark, d):
    index = C.community_index(frame(spark, d, "tx_addr"), _manual(spark, d))
    return C.community_addresses(index, _keywords(spark, d))


_DISTINCT = lambda c: f"list_distinct(string_split({c}, ''))"
CTES["compact_names"] = """
SELECT replace(upper(translate(trim(c.community_name), 'Ａｂ', 'Ab')), ' ', '') AS norm, c.community_name AS name, c.tx_count FROM catalogue c"""
_SUBSEQ = "regexp_matches(norm, concat('^.*', array_to_string(string_split(kw, ''), '.*'), '.*$'))"
# The oracle's levenshtein counts bytes, so each name character gets a one-byte stand-in there.
_ASCII = lambda c: f"translate({c}, '健安新城遠雄幸福都廳大院信義星池仁愛帝寶加館區台北二期', 'abcdefghijklmnopqrstuvwxyz!')"
CTES["name_scores"] = f"""
SELECT query_id, name, tx_count, kw, norm, greatest(1, length(kw) // 3) AS allowed, levenshtein({_ASCII('kw')}, {_ASCII('norm')}) AS dist,
  len(list_intersect({_DISTINCT('kw')}, {_DISTINCT('norm')}))::DOUBLE / greatest(len({_DISTINCT('kw')}), len({_DISTINCT('norm')})) AS shared
FROM (SELECT query_id, replace({_KW}, ' ', '') AS kw FROM keywords) k CROSS JOIN compact_names"""


@query(
    "j10_o4_fuzzy_names",
    f"""SELECT query_id, name, match_type, score, tx_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_count DESC, name) AS rn FROM (
    SELECT query_id, name, tx_count,
      CASE WHEN kw = norm THEN '精確' WHEN contains(norm, kw) OR contains(kw, norm) THEN '包含' WHEN length(kw) >= 2 AND {_SUBSEQ} THEN '子序列' WHEN dist <= allowed THEN '模糊' WHEN shared >= 0.6 AND length(kw) >= 2 THEN '相似' END AS match_type,
      round(CASE WHEN kw = norm THEN 1000 + tx_count WHEN contains(norm, kw) THEN length(kw)::DOUBLE / length(norm) * 200 + 500 + least(tx_count, 200) * 0.5E0
        WHEN contains(kw, norm) THEN length(norm)::DOUBLE / length(kw) * 200 + 400 + least(tx_count, 200) * 0.5E0 WHEN length(kw) >= 2 AND {_SUBSEQ} THEN length(kw)::DOUBLE / length(norm) * 200 + 200 + least(tx_count, 50)
        WHEN dist <= allowed THEN 100.0E0 - dist * 20 + least(tx_count, 30) WHEN shared >= 0.6 AND length(kw) >= 2 THEN shared * 80 + 50 + least(tx_count, 20) END, 1) AS score
    FROM name_scores) s WHERE score > 0) r WHERE rn <= 15""",
)
def _(spark, d):
    out = N.match_names(N.name_catalogue(frame(spark, d, "tx_addr")), _keywords(spark, d), 15)
    return out.select("query_id", "name", "match_type", "score", "tx_count")


CTES["overlap_scores"] = f"""
SELECT query_id, norm, tx_count, kw, (SELECT CAST(sum(least(length(kw) - length(replace(kw, c, '')), length(norm) - length(replace(norm, c, '')))) AS DOUBLE) FROM (SELECT unnest({_DISTINCT('kw')}) AS c) u) / length(kw) AS overlap
FROM (SELECT query_id, {_KW} AS kw FROM keywords) k, (SELECT {_NORM} AS norm, count(*) AS tx_count FROM tx_addr WHERE community_name <> '' GROUP BY 1) n"""


@query(
    "j11_overlap_names",
    """SELECT query_id, norm, score, tx_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_count DESC, norm) AS rn FROM (
    SELECT query_id, norm, tx_count, CAST(CASE WHEN kw = norm THEN 100 WHEN contains(norm, kw) THEN floor(length(kw)::DOUBLE / length(norm) * 15 + 70) WHEN contains(kw, norm) THEN floor(length(norm)::DOUBLE / length(kw) * 10 + 60)
      WHEN overlap >= 0.55 THEN floor(overlap * 55) ELSE 0 END AS INT) AS score FROM overlap_scores) s WHERE score > 0) r WHERE rn <= 10""",
)
def _(spark, d):
    info = C.community_info(C.community_index(frame(spark, d, "tx_addr")))
    return N.match_names_by_overlap(info, _keywords(spark, d), 10).select("query_id", "norm", "score", "tx_count")


@query("j11_accepted_match", "SELECT query_id, norm FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_count DESC, norm) AS rn FROM (SELECT query_id, norm, tx_count, CAST(CASE WHEN kw = norm THEN 100 WHEN contains(norm, kw) THEN floor(length(kw)::DOUBLE / length(norm) * 15 + 70) WHEN contains(kw, norm) THEN floor(length(norm)::DOUBLE / length(kw) * 10 + 60) WHEN overlap >= 0.55 THEN floor(overlap * 55) ELSE 0 END AS INT) AS score FROM overlap_scores) s WHERE score > 0) r WHERE rn = 1 AND score >= 50")
def _(spark, d):
    info = C.community_info(C.community_index(frame(spark, d, "tx_addr")))
    return N.match_names_by_overlap(info, _keywords(spark, d), 1).where("score >= 50").select("query_id", "norm")


# --- part names (Latin script) as a second catalogue ----------------------
CTES["part_items"] = "SELECT min(p_partkey) AS item_id, p_name AS name FROM part GROUP BY p_name"
CTES["part_queries"] = "SELECT min(p_partkey) AS query_id, concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS keyword FROM part GROUP BY p_name"


def _parts(spark, d):
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    q = p.groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select(
        "query_id", F.expr("concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))").alias("keyword")
    )
    return items, q


@query(
    "j20_best_item_by_name",
    f"""SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM (
    SELECT q.query_id, i.item_id, CAST(CASE WHEN name = keyword THEN 100 WHEN contains(name, keyword) THEN 80 + 2 * length(keyword) WHEN contains(keyword, name) THEN 70
      ELSE floor(len(list_filter(string_split(keyword, ''), lambda c: contains(name, c)))::DOUBLE / length(keyword) * 40) END AS INT) AS score FROM part_queries q CROSS JOIN part_items i) s WHERE score >= 20) r WHERE rn = 1""",
)
def _(spark, d):
    items, q = _parts(spark, d)
    return N.best_by_name(items, q).select("query_id", "item_id", "score")


@query(
    "j11_part_names",
    """SELECT query_id, norm, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_count DESC, norm) AS rn FROM (
    SELECT query_id, norm, tx_count, CAST(CASE WHEN kw = norm THEN 100 WHEN contains(norm, kw) THEN floor(length(kw)::DOUBLE / length(norm) * 15 + 70) WHEN contains(kw, norm) THEN floor(length(norm)::DOUBLE / length(kw) * 10 + 60)
      WHEN overlap >= 0.55 THEN floor(overlap * 55) ELSE 0 END AS INT) AS score FROM (
        SELECT q.query_id, n.norm, n.tx_count, upper(keyword) AS kw, (SELECT CAST(sum(least(length(upper(keyword)) - length(replace(upper(keyword), c, '')), length(norm) - length(replace(norm, c, '')))) AS DOUBLE) FROM (SELECT unnest(list_distinct(string_split(upper(keyword), ''))) AS c) u) / length(keyword) AS overlap
        FROM part_queries q, (SELECT upper(p_name) AS norm, count(*) AS tx_count FROM part GROUP BY 1) n) o) s WHERE score > 0) r WHERE rn <= 3""",
)
def _(spark, d):
    p = table(spark, d, "part")
    names = p.groupBy(T.community_name("p_name").alias("norm")).agg(
        F.count("*").alias("tx_count"), F.min("p_name").alias("name"), F.lit("").alias("district")
    )
    _, q = _parts(spark, d)
    return N.match_names_by_overlap(names, q, 3).select("query_id", "norm", "score")


# --- names of documents: a catalogue and keywords that grow with the data ---
# One letter short, words swapped, one letter wrong.
CTES["title_queries"] = """
SELECT 3 * item_id AS query_id, concat(substr(name, 1, 4), substr(name, 6)) AS keyword FROM titles
UNION ALL SELECT 3 * item_id + 1, concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) FROM titles
UNION ALL SELECT 3 * item_id + 2, concat(substr(name, 1, 2), 'q', substr(name, 4)) FROM titles"""


def _titles(spark, d):
    t = frame(spark, d, "titles")
    forms = ("concat(substr(name, 1, 4), substr(name, 6))", "concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1))", "concat(substr(name, 1, 2), 'q', substr(name, 4))")
    asks = t.select("item_id", F.posexplode(F.array(*[F.expr(f) for f in forms])).alias("k", "keyword"))
    return t, asks.select((3 * F.col("item_id") + F.col("k")).alias("query_id"), "keyword")


CTES["title_pairs"] = """
SELECT query_id, kw, norm, tx_count, greatest(1, length(kw) // 3) AS allowed, list_sort(list_distinct(string_split(kw, ''))) AS a, list_sort(list_distinct(string_split(norm, ''))) AS b
FROM (SELECT query_id, replace(upper(keyword), ' ', '') AS kw FROM title_queries) q CROSS JOIN (SELECT replace(upper(name), ' ', '') AS norm, CAST(sum(tx_count) AS BIGINT) AS tx_count FROM titles GROUP BY 1) n"""
CTES["title_scores"] = """
SELECT query_id, norm, tx_count, CASE WHEN kw = norm THEN 1000.0E0 + tx_count WHEN contains(norm, kw) THEN length(kw)::DOUBLE / length(norm) * 200 + 500 + least(tx_count, 200) * 0.5E0
  WHEN contains(kw, norm) THEN length(norm)::DOUBLE / length(kw) * 200 + 400 + least(tx_count, 200) * 0.5E0
  WHEN length(kw) >= 2 AND norm LIKE concat('%', array_to_string(string_split(kw, ''), '%'), '%') THEN length(kw)::DOUBLE / length(norm) * 200 + 200 + least(tx_count, 50)
  WHEN abs(length(kw) - length(norm)) <= allowed AND levenshtein(kw, norm) <= allowed THEN 100.0E0 - levenshtein(kw, norm) * 20 + least(tx_count, 30)
  WHEN length(kw) >= 2 AND len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) >= 0.6 THEN len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) * 80 + 50 + least(tx_count, 20) ELSE 0 END AS score
FROM title_pairs"""


@query(
    "j10_title_names",
    """SELECT query_id, norm, round(score, 1) AS score, tx_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, tx_count DESC, norm) AS rn FROM title_scores WHERE score > 0) r WHERE rn <= 3""",
)
def _(spark, d):
    t, asks = _titles(spark, d)
    names = t.groupBy(T.community_name("name", spaces="remove").alias("norm")).agg(F.sum("tx_count").alias("tx_count"))
    none = F.lit(None).cast("double")
    names = names.select("norm", "tx_count", F.col("norm").alias("name"), none.alias("avg_price"), none.alias("avg_unit_price"), F.lit("").alias("district"))
    return N.match_names(names, asks, 3).select("query_id", F.col("name").alias("norm"), "score", "tx_count")


# Letters of a name in order, as one number for each letter and place among its equals.
_TOKENS = lambda c: f"list_transform(range(1, length({c}) + 1), lambda i: concat({c}[i], length({c}[1:i]) - length(replace({c}[1:i], {c}[i], ''))))"


@query(
    "j11_title_names",
    f"""SELECT query_id, norm, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_count DESC, norm) AS rn FROM (
    SELECT query_id, norm, tx_count, CAST(CASE WHEN kw = norm THEN 100 WHEN contains(norm, kw) THEN floor(length(kw)::DOUBLE / length(norm) * 15 + 70) WHEN contains(kw, norm) THEN floor(length(norm)::DOUBLE / length(kw) * 10 + 60)
      WHEN overlap >= 0.55 THEN floor(overlap * 55) ELSE 0 END AS INT) AS score FROM (
        SELECT *, len(list_intersect(a, b))::DOUBLE / length(kw) AS overlap
        FROM (SELECT query_id, upper(keyword) AS kw, {_TOKENS('upper(keyword)')} AS a FROM title_queries) q, (SELECT upper(name) AS norm, tx_count, {_TOKENS('upper(name)')} AS b FROM titles) n) o) s WHERE score > 0) r WHERE rn <= 3""",
)
def _(spark, d):
    t, asks = _titles(spark, d)
    names = t.select(T.community_name("name").alias("norm"), "tx_count", "name", F.lit("").alias("district"))
    return N.match_names_by_overlap(names, asks, 3).select("query_id", "norm", "score")


@query(
    "j20_title_items",
    """SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM (
    SELECT q.query_id, i.item_id, CAST(CASE WHEN name = keyword THEN 100 WHEN contains(name, keyword) THEN 80 + 2 * length(keyword) WHEN contains(keyword, name) THEN 70
      ELSE floor((length(keyword) - length(translate(keyword, name, '')))::DOUBLE / length(keyword) * 40) END AS INT) AS score FROM title_queries q CROSS JOIN titles i) s WHERE score >= 20) r WHERE rn = 1""",
)
def _(spark, d):
    t, asks = _titles(spark, d)
    return N.best_by_name(t, asks).select("query_id", "item_id", "score")


# --- candidate scoring by address -----------------------------------------
CTES["address_items"] = """
SELECT id AS item_id, street AS road, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN lane <> '' AND alley <> '' THEN concat(alley, '弄') ELSE '' END) AS lane_road, CAST(number AS INT) AS num FROM tx_addr"""


@query(
    "j19_best_item_by_address",
    """SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM (
    SELECT q.query_id, i.item_id, CAST(10 + CASE WHEN i.lane_road = concat(q.street, CASE WHEN q.lane <> '' THEN concat(q.lane, '巷') ELSE '' END) THEN 10 ELSE 0 END
      + CASE WHEN abs(i.num - CAST(q.number AS INT)) = 0 THEN 20 WHEN abs(i.num - CAST(q.number AS INT)) <= 2 THEN 15 WHEN abs(i.num - CAST(q.number AS INT)) <= 5 THEN 10 WHEN abs(i.num - CAST(q.number AS INT)) <= 20 THEN 5 WHEN abs(i.num - CAST(q.number AS INT)) <= 50 THEN 2 ELSE 0 END AS INT) AS score
    FROM query_table q JOIN address_items i ON i.road = q.street) s WHERE score >= 15) r WHERE rn = 1""",
)
def _(spark, d):
    # Each address is taken apart once; its first row stands for it, as for items that score alike.  Written, as a
    # condition on the parts would otherwise be moved in front of the grouping and evaluated for every row.
    first = stage(frame(spark, d, "tx_addr").groupBy("address").agg(F.min("id").alias("item_id")), "addresses")
    items = first.select(
        "item_id", A.road("address").alias("road"), A.road_and_lane("address").alias("lane_road"), A.house_number("address").alias("num")
    )
    q = frame(spark, d, "query_table").select(
        "query_id", A.road("query_text").alias("road"), A.road_and_lane("query_text").alias("lane_road"),
        A.house_number("query_text").alias("q_num"),
    )
    return N.best_by_address(items, q)


# --- siblings -------------------------------------------------------------
@query(
    "j12_sibling_numbers",
    """SELECT DISTINCT q.query_id AS address_id, concat(q.street, CASE WHEN q.lane <> '' THEN concat(q.lane, '巷') ELSE '' END) AS road, CAST(t.number AS INT) AS number
    FROM query_table q JOIN (SELECT district, street, lane, number, arg_min(total_floors, id) AS total_floors, arg_min(build_date, id) AS build_date FROM tx_addr GROUP BY ALL) r
      ON r.district = q.district AND r.street = q.street AND r.lane = q.lane AND r.number = q.number
    JOIN tx_addr t ON t.district = q.district AND t.street = q.street AND t.lane = q.lane AND t.total_floors = r.total_floors AND t.build_date = r.build_date""",
)
def _(spark, d):
    a = frame(spark, d, "query_table").select(F.col("query_id").alias("address_id"), "district", "street", "lane", "number")
    return C.sibling_numbers(frame(spark, d, "tx_addr"), a)
