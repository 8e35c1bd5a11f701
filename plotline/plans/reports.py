"""Queries: summaries, trends, building projects, coverage, map aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import address as A, dates as D
from plotline.operators import community as C, filters as P, geo, present as R, report as Q
from plotline.plans.fixture import frame
from plotline.plans.registry import CTES, query, variants
from plotline.plans.rows import AS_OF, display

# Averages of values with a fixed number of decimals, summed as whole numbers.
def _fixed(c: str, stored: int, digits: int) -> str:
    used = f"CASE WHEN {c} > 0 THEN CAST(round({c} * {10**stored}) AS BIGINT) END"
    return f"coalesce(round(sum({used})::DOUBLE / (count({used}) * {10**(stored - digits)})) / {10**digits}.0E0, 0)"


_POS = lambda f, c: f"{f}(CASE WHEN {c} > 0 THEN {c} END)"


def _cents(df, *cols, scale=100):
    """Averages are compared with two digits; the small addend keeps sums added in another order equal."""
    return df.withColumns({c: F.floor(F.col(c) * scale + 0.0001) / scale for c in cols})


_CENTS = lambda c, scale=100: f"floor({c} * {scale} + 0.0001E0) / {scale}.0E0"


# --- summaries ------------------------------------------------------------
SUMMARY = f"""
count(*) AS total, CAST(coalesce(round({_POS('avg', 'price')}), 0) AS BIGINT) AS avg_price,
coalesce({_POS('min', 'price')}, 0) AS min_price, coalesce({_POS('max', 'price')}, 0) AS max_price,
{_fixed('area_ping', 2, 2)} AS avg_ping, {_fixed('unit_price_ping', 2, 2)} AS avg_unit_price_ping,
coalesce(round({_POS('min', 'unit_price_ping')}, 2), 0) AS min_unit_price_ping, coalesce(round({_POS('max', 'unit_price_ping')}, 2), 0) AS max_unit_price_ping,
{_fixed('public_ratio', 1, 1)} AS avg_ratio"""


@query("a1_result_summary", f"SELECT {SUMMARY} FROM display")
def _(spark, d):
    return Q.summary(display(spark, d))


@query("a1_summary_of_nothing", f"SELECT {SUMMARY} FROM display WHERE price < 0")
def _(spark, d):
    return Q.summary(display(spark, d).where("price < 0"))


def community_sql(avg, rows: str = "display") -> str:
    return f"""SELECT community_name, count(*) AS count, CAST(coalesce(round({_POS('avg', 'price')}), 0) AS BIGINT) AS avg_price,
    {avg('unit_price_ping', 2)} AS avg_unit_price_ping, {avg('area_ping', 1)} AS avg_ping, {avg('public_ratio', 1)} AS avg_ratio
    FROM {rows} WHERE community_name <> '' GROUP BY community_name"""


def rounded_avg(c: str, n: int) -> str:
    return _fixed(c, 1 if c == "public_ratio" else 2, n)


@query("a2_community_summaries", community_sql(rounded_avg))
def _(spark, d):
    return Q.community_summaries(display(spark, d))


@query("a26_group_stats", community_sql(lambda c, n: _CENTS(f"coalesce({_POS('avg', c)}, 0)")))
def _(spark, d):
    return _cents(Q.community_summaries(display(spark, d), rounded=False), "avg_unit_price_ping", "avg_ping", "avg_ratio")


_MID = lambda c: f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))[CAST(count({c}) // 2 AS INT) + 1]"


@query(
    "a21_result_spread",
    f"""SELECT count(*) AS total, round(avg(price), 2) AS avg_price, {_MID('price')} AS median_price, min(price) AS min_price, max(price) AS max_price,
    {_fixed('unit', 1, 1)} AS avg_unit, {_MID('unit')} AS median_unit, min(unit) AS min_unit, max(unit) AS max_unit,
    {_fixed('ping', 1, 1)} AS avg_ping, min(ping) AS min_ping, max(ping) AS max_ping,
    {_fixed('ratio', 1, 1)} AS avg_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio
    FROM (SELECT CASE WHEN total_price > 0 THEN total_price END AS price, unit_price_per_ping AS unit, ping, CASE WHEN public_ratio > 0 THEN public_ratio END AS ratio FROM computed) s""",
)
def _(spark, d):
    out = Q.spread(R.with_computed(frame(spark, d, "tx_addr")))
    return out.withColumn("avg_price", F.round("avg_price", 2))


# --- trend ----------------------------------------------------------------
_LABELS = {
    "monthly": "concat(CAST(roc_year AS VARCHAR), '/', substr(date_key, 4, 2))",
    "quarterly": "concat(CAST(roc_year AS VARCHAR), 'Q', CAST((CAST(substr(date_key, 4, 2) AS INT) - 1) // 3 + 1 AS VARCHAR))",
    "yearly": "CAST(roc_year AS VARCHAR)",
}
_TREND = f"""
label, count(*) AS count, CAST(round(avg(total_price)) AS BIGINT) AS avg_price, {_MID('total_price')} AS median_price,
min(total_price) AS min_price, max(total_price) AS max_price, CAST(coalesce(round({_POS('avg', 'unit_price')}), 0) AS BIGINT) AS avg_unit_price"""


@variants(
    "a3_price_trend_{}",
    lambda n: f"""SELECT {_TREND} FROM (SELECT *, {_LABELS[n]} AS label FROM computed
    WHERE (contains(community_name, '新城') OR contains(address, '三民路')) AND total_price > 0) x GROUP BY label""",
    list(_LABELS),
)
def _(spark, d, n):
    tx = frame(spark, d, "tx_addr")
    keyword = P.mentions("新城") | P.mentions("三民路")
    return Q.price_trend(tx.where(keyword), n)


@query(
    "a3_price_trend_look_back",
    f"""SELECT {_TREND} FROM (SELECT *, {_LABELS['monthly']} AS label FROM computed
    WHERE total_price > 0 AND date_key >= '1040100' AND date_key < '1070100') x GROUP BY label""",
)
def _(spark, d):
    return Q.price_trend(frame(spark, d, "tx_addr"), "monthly", months_back=36, as_of="1061231")


# --- building projects ----------------------------------------------------
@query("a4_community_centroids", "SELECT community_name, round(avg_lat, 9) AS avg_lat, round(avg_lng, 9) AS avg_lng FROM centroids")
def _(spark, d):
    c = Q.community_centroids(frame(spark, d, "tx_addr"))
    return c.select("community_name", F.round("avg_lat", 9).alias("avg_lat"), F.round("avg_lng", 9).alias("avg_lng"))


CTES["catalogue"] = """
SELECT community_name, count(*) AS tx_count, coalesce(round(avg(total_price)), 0) AS avg_price, coalesce(round(avg(unit_price), 2), 0) AS avg_unit_price
FROM tx_addr WHERE community_name <> '' GROUP BY community_name"""
CTES["named_district"] = """
SELECT community_name, district FROM (SELECT community_name, district, row_number() OVER (PARTITION BY community_name ORDER BY count(*) DESC, district DESC) AS rn
FROM tx_addr WHERE community_name <> '' GROUP BY community_name, district) x WHERE rn = 1"""


@query(
    "a5_community_catalogue",
    "SELECT c.*, n.district FROM catalogue c JOIN named_district n ON n.community_name = c.community_name",
)
def _(spark, d):
    return Q.catalogue(frame(spark, d, "tx_addr"))


_NORM = "upper(translate(trim(community_name), 'Ａｂ', 'Ab'))"


@query(
    "a6_community_addresses",
    f"""SELECT {_NORM} AS norm, trim(community_name) AS name, address, district, county_city, count(*) AS n, 'db' AS origin FROM tx_addr
    WHERE community_name <> '' GROUP BY ALL""",
)
def _(spark, d):
    return C.community_index(frame(spark, d, "tx_addr"))


@query(
    "a6_community_info",
    f"""SELECT {_NORM} AS norm, min(trim(community_name)) AS name, count(*) AS tx_count, count(DISTINCT address) AS addresses,
    arg_min(district, concat(trim(community_name), address)) AS district, arg_min(county_city, concat(trim(community_name), address)) AS county_city
    FROM tx_addr WHERE community_name <> '' GROUP BY 1""",
)
def _(spark, d):
    return C.community_info(C.community_index(frame(spark, d, "tx_addr")))


@query(
    "a23_community_counts",
    "SELECT count(*) AS total_records, count(DISTINCT community_name) AS unique_communities FROM tx_addr WHERE community_name <> ''",
)
def _(spark, d):
    return Q.community_counts(frame(spark, d, "tx_addr"))


def _manual(spark, d):
    """A manual mapping taken from the transactions: some known, some new projects."""
    return frame(spark, d, "tx_addr").where("id % 40 = 0").select(
        "address", F.expr("concat('手動', district)").alias("community_name"), "district", F.lit("").alias("remark")
    )


@query(
    "a23_origin_counts",
    f"""SELECT 'db' AS origin, count(DISTINCT {_NORM}) AS communities, count(*) AS rows FROM tx_addr WHERE community_name <> ''
    UNION ALL SELECT 'manual', count(DISTINCT district), 0 FROM tx_addr WHERE id % 40 = 0""",
)
def _(spark, d):
    return C.origin_counts(C.community_index(frame(spark, d, "tx_addr"), _manual(spark, d)))


# --- coverage and audits --------------------------------------------------
_SHARE = lambda c: f"round(CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) / count(*) * 100, 1)"
_HAS = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"


@query(
    "a9_coverage",
    f"""SELECT count(*) AS total, {_HAS("county_city <> ''")} AS has_city, {_SHARE("county_city <> ''")} AS city_pct,
    {_HAS("street <> ''")} AS has_street, {_SHARE("street <> ''")} AS street_pct, {_HAS('lat <> 0')} AS has_geo, {_SHARE('lat <> 0')} AS geo_pct,
    {_HAS("community_name <> ''")} AS has_community, {_SHARE("community_name <> ''")} AS community_pct FROM tx_addr""",
)
def _(spark, d):
    return Q.coverage(frame(spark, d, "tx_addr"))


@query(
    "a10_duplicate_keys",
    "SELECT expected_key AS dedup_key, count(*) AS cnt FROM arrivals WHERE expected_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1 ORDER BY cnt DESC, dedup_key LIMIT 20",
)
def _(spark, d):
    a = frame(spark, d, "arrivals")
    keyed = a.where(P.reject_reason("address").isNull()).withColumn(
        "dedup_key", A.dedup_key("transaction_date", "address", "total_price")
    )
    return Q.duplicate_keys(keyed)


@query(
    "a25_address_stats",
    f"""SELECT address, count(*) AS tx_count, {_CENTS('avg(total_price)')} AS avg_price, min(total_price) AS min_price, max(total_price) AS max_price,
    {_CENTS('avg(building_area)')} AS avg_area, count(DISTINCT district) AS district_count FROM tx_addr GROUP BY address""",
)
def _(spark, d):
    return _cents(Q.address_stats(frame(spark, d, "tx_addr")), "avg_price", "avg_area")


# --- geocoding reports ----------------------------------------------------
@query(
    "a12_geocode_status",
    "SELECT count(*) AS total_rows, count(DISTINCT address) AS valid_addresses, CAST(sum(CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS geocoded_rows FROM tx_addr",
)
def _(spark, d):
    return geo.geocode_status(frame(spark, d, "tx_addr"))


@query(
    "a12_district_addresses",
    "SELECT district, count(DISTINCT address) AS addresses FROM tx_addr GROUP BY district ORDER BY addresses DESC, district LIMIT 20",
)
def _(spark, d):
    return geo.district_addresses(frame(spark, d, "tx_addr"))


_ROAD = "concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END)"


@query(
    "a13_road_workload",
    f"SELECT concat(replace(county_city, '台', '臺'), district, {_ROAD}) AS road_key, count(DISTINCT address) AS addresses, min(district) AS district FROM tx_addr GROUP BY 1",
)
def _(spark, d):
    return geo.road_workload(frame(spark, d, "tx_addr"))


@query("a14_cache_stats", "SELECT level, source, count(*) AS rows FROM cache GROUP BY GROUPING SETS ((level), (source), ())")
def _(spark, d):
    return geo.cache_stats(frame(spark, d, "cache"))


@query("a14_event_stats", "SELECT event_type AS level, CAST(user_id % 7 AS VARCHAR) AS source, count(*) AS rows FROM events GROUP BY GROUPING SETS ((1), (2), ())")
def _(spark, d):
    from plotline.plans.fixture import table

    e = table(spark, d, "events").select(
        F.col("event_type").alias("level"), (F.col("user_id") % 7).cast("string").alias("source")
    )
    return geo.cache_stats(e)


@query("a15_city_points", "SELECT city, count(*) AS points FROM points GROUP BY city ORDER BY points DESC, city LIMIT 5")
def _(spark, d):
    return geo.city_points(frame(spark, d, "points"))


@query(
    "a16_road_centres",
    """SELECT concat(replace(city, '台', '臺'), district, street) AS road_key, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng, count(*) AS points
    FROM points GROUP BY 1""",
)
def _(spark, d):
    r = geo.road_centres(frame(spark, d, "points"))
    return r.select("road_key", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "points")


# --- map ------------------------------------------------------------------
CTES["markers"] = f"""
SELECT *, CASE WHEN community_name <> '' THEN concat('c:', community_name, '@', district) ELSE concat('a:', address_raw) END AS key,
  CASE WHEN community_name <> '' THEN community_name ELSE address END AS label,
  (NOT is_special AND CAST(date_raw AS BIGINT) >= {(AS_OF - 2) * 10000}) AS recent
FROM display WHERE lat <> 0 AND lng <> 0"""
_RPOS = lambda f, c: f"{f}(CASE WHEN recent AND {c} > 0 THEN {c} END)"
CTES["groups"] = f"""
SELECT key, min(label) AS label, count(*) AS count, coalesce({_POS('avg', 'price')}, 0) AS avg_price, coalesce({_POS('avg', 'unit_price_ping')}, 0) AS avg_unit_price,
  CAST(sum(CASE WHEN recent THEN 1 ELSE 0 END) AS BIGINT) AS recent_count, coalesce({_RPOS('avg', 'price')}, 0) AS recent_avg_price, coalesce({_RPOS('avg', 'unit_price_ping')}, 0) AS recent_avg_unit_price,
  {_MID('lat')} AS lat, {_MID('lng')} AS lng,
  coalesce(list_sort(list(unit_price_ping) FILTER (WHERE recent AND unit_price_ping > 0))[CAST((count(*) FILTER (WHERE recent AND unit_price_ping > 0)) // 2 AS INT) + 1], 0) AS recent_median_unit_price
FROM markers GROUP BY key"""
_GROUP_AVG = ("avg_price", "avg_unit_price", "recent_avg_price", "recent_avg_unit_price")


@query(
    "a17_map_groups",
    "SELECT key, label, count, recent_count, lat, lng, recent_median_unit_price, "
    + ", ".join(f"{_CENTS(c)} AS {c}" for c in _GROUP_AVG) + " FROM groups",
)
def _(spark, d):
    return _cents(Q.map_groups(display(spark, d), AS_OF), *_GROUP_AVG)


_CELL = (
    "CAST(floor((lng + 180.0E0) / 360.0E0 * 4096.0E0) AS BIGINT) AS cell_x, "
    "CAST(floor((1.0E0 - ln(tan(radians(lat)) + 1.0E0 / cos(radians(lat))) / 3.141592653589793E0) / 2.0E0 * 4096.0E0) AS BIGINT) AS cell_y"
)


@query(
    "a18_map_cells",
    f"""SELECT {_CELL}, CAST(sum(count) AS BIGINT) AS total_count,
    {_CENTS('coalesce(sum(CASE WHEN avg_price > 0 THEN avg_price * count END) / sum(CASE WHEN avg_price > 0 THEN count END), 0)', 10)} AS avg_price,
    {_CENTS('coalesce(sum(CASE WHEN avg_unit_price > 0 THEN avg_unit_price * count END) / sum(CASE WHEN avg_unit_price > 0 THEN count END), 0)', 10)} AS avg_unit_price,
    count(DISTINCT label) AS labels, min(label) AS first_label FROM groups GROUP BY 1, 2""",
)
def _(spark, d):
    cells = Q.map_cells(Q.map_groups(display(spark, d), AS_OF), 12)
    return _cents(cells, "avg_price", "avg_unit_price", scale=10)


@query(
    "a19_group_profile",
    """SELECT key, min(CASE WHEN length(date_raw) >= 7 THEN CAST(substr(date_raw, 1, length(date_raw) - 4) AS INT) END) AS first_year,
    max(CASE WHEN length(date_raw) >= 7 THEN CAST(substr(date_raw, 1, length(date_raw) - 4) AS INT) END) AS last_year,
    max(CAST(total_floors AS INT)) AS max_floor, CAST(round(avg(CASE WHEN area_ping > 0 THEN area_ping END)) AS BIGINT) AS avg_ping,
    min(completion_date) AS completion_date, array_to_string(list_sort(list_distinct(list(building_type)))[1:2], '/') AS building_type
    FROM markers GROUP BY key""",
)
def _(spark, d):
    return Q.group_profile(Q.map_rows(display(spark, d)))


@query(
    "a20_overlap_list",
    "SELECT CASE WHEN community_name = '' THEN '未知建案' ELSE community_name END AS community_name, count(*) AS count FROM display GROUP BY 1",
)
def _(spark, d):
    return Q.overlap_list(display(spark, d))


@query(
    "a27_nested_results",
    """SELECT id, community_name, CASE WHEN community_name <> '' THEN first_value(id) OVER (PARTITION BY community_name ORDER BY lpad(date_raw, 7, '0') DESC, id DESC) END AS first_id,
    CASE WHEN community_name <> '' THEN count(*) OVER (PARTITION BY community_name) END AS group_size FROM display""",
)
def _(spark, d):
    # Any ordered value can be the place of a row: here newest date, then largest id.
    place = F.struct((-D.sort_key("date_raw").cast("long")).alias("date"), (-F.col("id")).alias("id"))
    rows = display(spark, d).withColumn("position", place)
    out = Q.nested_order(rows)
    return out.select("id", "community_name", (-F.col("group_first.id")).alias("first_id"), "group_size")


@query("a28_map_extent", "SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM groups")
def _(spark, d):
    return Q.map_extent(Q.map_groups(display(spark, d), AS_OF))


@query(
    "m4_marker_bands",
    "SELECT key, CAST(CASE WHEN avg_unit_price / 10000 < 20 THEN 0 WHEN avg_unit_price / 10000 < 40 THEN 1 WHEN avg_unit_price / 10000 < 70 THEN 2 ELSE 3 END AS INT) AS unit_band, "
    "CAST(CASE WHEN avg_price / 10000 < 500 THEN 0 WHEN avg_price / 10000 < 1500 THEN 1 WHEN avg_price / 10000 < 3000 THEN 2 ELSE 3 END AS INT) AS total_band FROM groups",
)
def _(spark, d):
    return Q.marker_colours(Q.map_groups(display(spark, d), AS_OF)).select("key", "unit_band", "total_band")


@query(
    "a22_address_ranges",
    """SELECT norm, road, count, first, last, CASE WHEN count <= 10 THEN concat(road, array_to_string(nums, '、'), '號') ELSE concat(road, first, '～', last, '號（共', count, '個門牌）') END AS formatted
    FROM (SELECT upper(translate(trim(community_name), 'Ａｂ', 'Ab')) AS norm, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN lane <> '' AND alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road,
      count(DISTINCT number) AS count, min(CAST(number AS INT)) AS first, max(CAST(number AS INT)) AS last,
      list_sort(list_distinct(list(CAST(number AS INT)))) AS nums FROM tx_addr WHERE community_name <> '' GROUP BY ALL) x""",
)
def _(spark, d):
    index = C.community_index(frame(spark, d, "tx_addr"))
    return C.address_ranges(index)


@query(
    "a22_range_summary",
    """SELECT norm, count(*) AS roads, CAST(sum(n) AS BIGINT) AS numbers FROM (SELECT upper(translate(trim(community_name), 'Ａｂ', 'Ab')) AS norm, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN lane <> '' AND alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road,
      count(DISTINCT number) AS n FROM tx_addr WHERE community_name <> '' GROUP BY ALL) x GROUP BY norm""",
)
def _(spark, d):
    ranges = C.address_ranges(C.community_index(frame(spark, d, "tx_addr")))
    return C.range_summary(ranges).select("norm", "roads", "numbers")


@query(
    "c3_range_texts",
    """SELECT norm, concat(string_agg(formatted, '；' ORDER BY rn) FILTER (WHERE rn <= 5), CASE WHEN count(*) > 5 THEN concat('；...還有 ', count(*) - 5, ' 條路段') ELSE '' END) AS summary
    FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY count DESC, road) AS rn, CASE WHEN count <= 10 THEN concat(road, array_to_string(nums, '、'), '號') ELSE concat(road, first, '～', last, '號（共', count, '個門牌）') END AS formatted
    FROM (SELECT upper(translate(trim(community_name), 'Ａｂ', 'Ab')) AS norm, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN lane <> '' AND alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road,
      count(DISTINCT number) AS count, min(CAST(number AS INT)) AS first, max(CAST(number AS INT)) AS last,
      list_sort(list_distinct(list(CAST(number AS INT)))) AS nums FROM tx_addr WHERE community_name <> '' GROUP BY ALL) x) y GROUP BY norm""",
)
def _(spark, d):
    ranges = C.address_ranges(C.community_index(frame(spark, d, "tx_addr")))
    return C.range_summary(ranges).select("norm", "summary")
