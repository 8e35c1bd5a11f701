"""Queries: projections, filters, presentation, sort orders, scalar functions inside table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import constants as K
from plotline.functions import address as A, dates as D, money as M, text as T, values as V
from plotline.operators import cells as X, filters as P, gazetteer as G, geo, present as R, standardise as Z
from plotline.operators.filters import Filters
from plotline.operators.stats import upper_median, with_count
from plotline.plans.fixture import frame, stored, table
from plotline.plans.registry import CTES, query, variants

AS_OF = 112  # calendar year the "recent" queries look back from

# --- shared oracle pieces -------------------------------------------------
CTES["computed"] = """
SELECT tx_addr.*,
  CASE WHEN building_area > 0 THEN round(building_area / 3.30579E0, 1) END AS ping,
  CASE WHEN building_area > 0 AND main_area > 0 AND building_area > main_area
       THEN round((building_area - main_area - coalesce(attached_area, 0) - coalesce(balcony_area, 0)) / building_area * 100, 1) END AS public_ratio,
  CASE WHEN building_area > 0 AND total_price > 0
       THEN round(total_price / 10000.0E0 / (building_area / 3.30579E0), 1) END AS unit_price_per_ping,
  CAST(substr(transaction_date, 1, length(transaction_date) - 4) AS INT) AS roc_year,
  lpad(transaction_date, 7, '0') AS date_key
FROM tx_addr"""
_SPECIAL = " OR ".join(f"contains(note, '{w}')" for w in K.SPECIAL_NOTE_WORDS)
CTES["display"] = f"""
SELECT id,
  substr(address, length(county_city) + 1) AS address,
  address AS address_raw, district,
  CASE WHEN length(transaction_date) >= 7 THEN concat(CAST(CAST(substr(transaction_date, 1, 3) AS INT) + 1911 AS VARCHAR), '/', substr(transaction_date, 4, 2), '/', substr(transaction_date, 6, 2))
       ELSE transaction_date END AS date,
  transaction_date AS date_raw,
  coalesce(total_price, 0) AS price,
  round(unit_price, 2) AS unit_price_sqm,
  round(unit_price * 3.30579E0, 2) AS unit_price_ping,
  round(building_area, 2) AS area_sqm,
  round(building_area / 3.30579E0, 2) AS area_ping,
  round(coalesce(main_area, 0), 2) AS main_area_sqm,
  CASE WHEN building_area > 0 AND main_area > 0
       THEN greatest(round((building_area - main_area - coalesce(attached_area, 0) - coalesce(balcony_area, 0)) / building_area * 100, 1), 0.0E0)
       ELSE 0.0E0 END AS public_ratio,
  total_floors, rooms, building_type, build_date AS completion_date, note,
  coalesce(community_name, '') AS community_name,
  ({_SPECIAL}) AS is_special,
  CASE WHEN lat <> 0 AND lng <> 0 THEN lat END AS lat,
  CASE WHEN lat <> 0 AND lng <> 0 THEN lng END AS lng,
  CASE WHEN lat <> 0 AND lng <> 0 THEN 'db' ELSE 'none' END AS coord_source
FROM tx_addr"""
_SHOWN = (
    "id address address_raw district date date_raw price unit_price_sqm unit_price_ping area_sqm area_ping "
    "main_area_sqm public_ratio total_floors rooms building_type completion_date note community_name "
    "is_special lat lng coord_source"
).split()


def display(spark, d):
    """Display rows of all transactions (coordinates as stored)."""
    return R.display_rows(R.search_columns(frame(spark, d, "tx_addr")), mode="stored").select(*_SHOWN)


@query("fixture_tx", "SELECT * FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr")


# --- projections ----------------------------------------------------------
@query(
    "p1_search_columns",
    """SELECT id, district, address, transaction_date, total_price, unit_price, building_area AS building_area_sqm,
    main_area AS main_building_area, attached_area, balcony_area, rooms, total_floors, building_type,
    build_date AS completion_date, note, lat, lng, community_name FROM tx_addr""",
)
def _(spark, d):
    return R.search_columns(frame(spark, d, "tx_addr"))


@query("p2_computed_columns", "SELECT id, ping, public_ratio, unit_price_per_ping, roc_year FROM computed")
def _(spark, d):
    return R.with_computed(frame(spark, d, "tx_addr")).select(
        "id", "ping", "public_ratio", "unit_price_per_ping", "roc_year"
    )


@query("p3_display_rows", f"SELECT {', '.join(_SHOWN)} FROM display")
def _(spark, d):
    return display(spark, d)


_CENTROIDS = """
SELECT community_name, avg(lat) AS avg_lat, avg(lng) AS avg_lng FROM tx_addr
WHERE community_name IS NOT NULL AND community_name <> '' AND lat <> 0 AND lng <> 0 GROUP BY community_name"""
CTES["centroids"] = _CENTROIDS
_POINT_JOIN = """
FROM tx_addr t
LEFT JOIN (SELECT district, street, housenumber, min(lat) AS lat, min(lng) AS lng FROM points GROUP BY ALL) e
  ON e.district = t.district AND e.housenumber = t.number AND e.street = concat(t.street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END)
LEFT JOIN (SELECT street, housenumber, arg_min(lat, point_id) AS lat, arg_min(lng, point_id) AS lng FROM points GROUP BY ALL) s
  ON s.housenumber = t.number AND s.street = concat(t.street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END)
"""


@query(
    "p4_coords_osm",
    f"""
SELECT t.id, CASE WHEN e.lat IS NOT NULL OR s.lat IS NOT NULL THEN 'osm' WHEN t.lat <> 0 AND t.lng <> 0 THEN 'db' ELSE 'none' END AS coord_source,
  coalesce(e.lat, s.lat, CASE WHEN t.lat <> 0 AND t.lng <> 0 THEN t.lat END) AS lat,
  coalesce(e.lng, s.lng, CASE WHEN t.lat <> 0 AND t.lng <> 0 THEN t.lng END) AS lng {_POINT_JOIN}""",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    looked = geo.lookup_points(geo.with_geo_keys(tx), frame(spark, d, "points"))
    return R.choose_coords(looked, "osm").select("id", "coord_source", "lat", "lng")


@query(
    "p4_coords_db",
    """
SELECT t.id, CASE WHEN t.lat <> 0 AND t.lng <> 0 THEN 'db' WHEN c.avg_lat IS NOT NULL THEN 'community' ELSE 'none' END AS coord_source,
  round(CASE WHEN t.lat <> 0 AND t.lng <> 0 THEN t.lat ELSE c.avg_lat END, 6) AS lat,
  round(CASE WHEN t.lat <> 0 AND t.lng <> 0 THEN t.lng ELSE c.avg_lng END, 6) AS lng
FROM tx_addr t LEFT JOIN centroids c ON c.community_name = t.community_name""",
)
def _(spark, d):
    from plotline.operators.report import community_centroids

    tx = frame(spark, d, "tx_addr")
    placed = R.choose_coords(R.with_name_coords(tx, community_centroids(tx)), "db")
    return placed.select("id", "coord_source", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    "p5_scrub_numbers",
    """SELECT id, CASE WHEN building_area = 0 THEN 0 ELSE unit_price / building_area END AS a,
    CASE WHEN unit_price = 0 THEN 0 ELSE unit_price END AS b FROM tx_addr""",
)
def _(spark, d):
    # 0/0 as NaN and x/0 as infinity are what the scrub removes.
    tx = frame(spark, d, "tx_addr")
    broken = tx.select(
        "id",
        F.when(F.col("building_area") == 0, F.lit(float("nan"))).otherwise(F.col("unit_price") / F.col("building_area")).alias("a"),
        F.when(F.col("unit_price") == 0, F.lit(float("inf"))).otherwise(F.col("unit_price")).alias("b"),
    )
    return R.scrub_numbers(broken)


@query(
    "p6_clean_address",
    """SELECT id, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END,
    number, '號', floor, 'F', CASE WHEN sub_number <> '' THEN concat('之', sub_number) ELSE '' END) AS clean FROM tx_addr""",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", R.clean_address().alias("clean"))


# --- filters --------------------------------------------------------------
_RANGES = "CASE CAST(id % 6 AS INT) WHEN 0 THEN concat(number, '-', floor) WHEN 1 THEN concat('-', number) WHEN 2 THEN concat(number, '-') WHEN 3 THEN number WHEN 4 THEN 'a-b' ELSE 'x' END"


@query(
    "f1_parse_range",
    """SELECT id, CAST(CASE id % 6 WHEN 0 THEN number WHEN 2 THEN number WHEN 3 THEN number END AS DOUBLE) AS lo,
    CAST(CASE id % 6 WHEN 0 THEN floor WHEN 1 THEN number WHEN 3 THEN number END AS DOUBLE) AS hi FROM tx_addr""",
)
def _(spark, d):
    r = frame(spark, d, "tx_addr").select("id", V.parse_range(F.expr(_RANGES)).alias("r"))
    return r.select("id", "r.lo", "r.hi")


_ARGS = {"building_type": "大樓,公寓", "rooms": "2,3", "ping": "10-40", "price": "100-3000", "year": "102-2018"}


@query(
    "f2_filter_settings",
    """SELECT id FROM tx_addr WHERE (contains(building_type, '大樓') OR contains(building_type, '公寓')) AND rooms IN (2, 3)
    AND building_area >= 10 * 3.30579E0 AND building_area <= 40 * 3.30579E0 AND total_price >= 1000000 AND total_price <= 30000000
    AND CAST(substr(transaction_date, 1, length(transaction_date) - 4) AS INT) BETWEEN 102 AND 107""",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").where(P.raw_filters(Filters.from_args(_ARGS))).select("id")


_BOUNDS = {
    "types": Filters(building_types=("公寓", "透天")),
    "rooms": Filters(rooms=(1, 4)),
    "ratio": Filters(public_ratio=(40.0, 48.0)),
    "year": Filters(year=(103, 107)),
    "ping": Filters(ping=(8.0, 30.0)),
    "unit_price": Filters(unit_price=(20.0, 60.0)),
    "price": Filters(price=(500.0, 2000.0)),
}
_RAW_SQL = {
    "types": "contains(building_type, '公寓') OR contains(building_type, '透天')",
    "rooms": "rooms IN (1, 4)",
    "ratio": "building_area > 0 AND main_area > 0 AND (building_area - main_area - coalesce(attached_area, 0) - coalesce(balcony_area, 0)) * 100.0E0 / building_area BETWEEN 40 AND 48",
    "year": "roc_year BETWEEN 103 AND 107",
    "ping": "building_area BETWEEN 8 * 3.30579E0 AND 30 * 3.30579E0",
    "unit_price": "unit_price BETWEEN 20 * 10000 / 3.30579E0 AND 60 * 10000 / 3.30579E0",
    "price": "total_price BETWEEN 5000000 AND 20000000",
}
_COMPUTED_SQL = _RAW_SQL | {
    "ratio": "public_ratio BETWEEN 40 AND 48",
    "ping": "ping BETWEEN 8 AND 30",
    "unit_price": "unit_price_per_ping BETWEEN 20 AND 60",
}


@variants("f3_raw_{}", lambda n: f"SELECT id FROM computed WHERE {_RAW_SQL[n]}", list(_RAW_SQL))
def _(spark, d, n):
    return frame(spark, d, "tx_addr").where(P.raw_filters(_BOUNDS[n])).select("id")


@variants("f4_computed_{}", lambda n: f"SELECT id FROM computed WHERE {_COMPUTED_SQL[n]}", list(_COMPUTED_SQL))
def _(spark, d, n):
    return R.with_computed(frame(spark, d, "tx_addr")).where(P.computed_filters(_BOUNDS[n])).select("id")


_BOX = (22.5, 23.5, 120.4, 121.2)


@query(
    "f5_bounding_box",
    "SELECT id, lat, lng FROM computed WHERE lat BETWEEN 22.5 AND 23.5 AND lng BETWEEN 120.4 AND 121.2",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").where(P.in_box(*_BOX)).select("id", "lat", "lng")


def by_place(spark, d):
    """The transactions as a table laid out by place."""
    path = stored(spark, d, "by_place", lambda p: X.write_by_place(frame(spark, d, "tx_addr"), p))
    return spark.read.parquet(path)


@query(
    "f5_box_of_stored_table",
    "SELECT id, lat, lng FROM computed WHERE lat BETWEEN 22.5 AND 23.5 AND lng BETWEEN 120.4 AND 121.2",
)
def _(spark, d):
    return X.in_box(by_place(spark, d), _BOX).select("id", "lat", "lng")


@query(
    "f7_district_of_text",
    "SELECT q.query_id, t.id FROM query_table q JOIN tx_addr t ON t.street = q.street AND t.number = q.number WHERE t.district = q.district",
)
def _(spark, d):
    from plotline.operators import search as S

    q = S.parse_queries(frame(spark, d, "query_table").select("query_id", "query_text", "street", "number"))
    rows = q.join(frame(spark, d, "tx_addr"), ["street", "number"])
    return rows.where(P.in_district(F.col("q_district"))).select("query_id", "id")


@query("f8_special_notes", "SELECT id, is_special FROM display")
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", P.is_special("note").alias("is_special"))


@query("f9_exclude_special", "SELECT id FROM display WHERE NOT is_special")
def _(spark, d):
    return frame(spark, d, "tx_addr").where(~P.is_special("note")).select("id")


_MESSY = "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 13 = 1 THEN '' WHEN id % 13 = 2 THEN replace(address, '號', '') ELSE address END"


@query(
    "f10_reject_reasons",
    "SELECT coalesce(CASE WHEN id % 13 <= 1 THEN 'no_address' WHEN id % 13 = 2 THEN 'no_number' END, '') AS reason, count(*) AS rows FROM tx_addr GROUP BY ALL",
)
def _(spark, d):
    a = frame(spark, d, "tx_addr").select(F.expr(_MESSY).alias("address"))
    return a.groupBy(F.coalesce(P.reject_reason("address"), F.lit("")).alias("reason")).agg(F.count("*").alias("rows"))


@query("f11_territory", "SELECT id FROM tx_addr WHERE lat > 20 AND lat < 27 AND lng > 118 AND lng < 123")
def _(spark, d):
    return frame(spark, d, "tx_addr").where(P.in_territory("lat", "lng")).select("id")


@query(
    "f12_geocodable",
    "SELECT id FROM tx_addr WHERE id % 13 > 2",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").withColumn("address", F.expr(_MESSY)).where(P.geocodable("address")).select("id")


@query("f13_lot_addresses", "SELECT id, (id % 9 = 4 OR id % 9 = 5) AS lot FROM tx_addr")
def _(spark, d):
    a = F.expr(
        "CASE id % 9 WHEN 4 THEN concat(district, '平安段', number, '地號') WHEN 5 THEN concat('平安段二小段 ', number, '段', number, '地號') ELSE address END"
    )
    return frame(spark, d, "tx_addr").select("id", P.is_lot(a).alias("lot"))


@query(
    "f14_trend_rows",
    "SELECT id FROM tx_addr WHERE (contains(community_name, '新城') OR contains(address, '新城')) AND total_price > 0 AND transaction_date IS NOT NULL",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").where(P.mentions("新城")).select("id")


@query(
    "f15_recent_regular",
    f"""SELECT id, roc_year BETWEEN {AS_OF - 1} AND {AS_OF} AS last_year, (NOT ({_SPECIAL}) AND CAST(transaction_date AS BIGINT) >= {(AS_OF - 2) * 10000}) AS recent FROM computed""",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", P.recent_years(AS_OF, 1).alias("last_year"), P.recent_regular(AS_OF).alias("recent")
    )


@query("f16_district_addresses", "SELECT DISTINCT district, address FROM tx_addr WHERE district = '松山區'")
def _(spark, d):
    return P.distinct_addresses(frame(spark, d, "tx_addr"), "松山區")


@query("f17_trusted_levels", "SELECT id FROM tx_addr WHERE id % 4 IN (0, 1)")
def _(spark, d):
    level = F.expr("CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'road' WHEN 2 THEN 'district' END")
    return frame(spark, d, "tx_addr").withColumn("level", level).where(P.trusted_level()).select("id")


# --- windows and orders ---------------------------------------------------
@query("w1_address_count", "SELECT id, count(*) OVER (PARTITION BY address) AS addr_count FROM tx_addr")
def _(spark, d):
    return with_count(frame(spark, d, "tx_addr").select("id", "address"), ["address"], "addr_count").drop("address")


_ORDERS = {
    "date": "date_key DESC, id DESC",
    "price": "total_price DESC NULLS LAST, date_key DESC, id DESC",
    "count": "addr_count DESC, date_key DESC, id DESC",
    "unit_price": "unit_price_per_ping DESC NULLS LAST, date_key DESC, id DESC",
    "ping": "ping DESC NULLS LAST, date_key DESC, id DESC",
    "public_ratio": "public_ratio ASC NULLS LAST, date_key DESC, id DESC",
}


@variants(
    "o1_order_by_{}",
    lambda n: f"SELECT id, address FROM (SELECT *, count(*) OVER (PARTITION BY address) AS addr_count FROM computed) ORDER BY {_ORDERS[n]} LIMIT 200",
    list(_ORDERS),
)
def _(spark, d, n):
    rows = R.with_computed(frame(spark, d, "tx_addr"))
    if n == "count":
        rows = R.with_address_count(rows)
    return rows.orderBy(*R.result_order(n)).select("id", "address").limit(200)


_LISTS = {
    "date": "lpad(date_raw, 7, '0') DESC, id", "price": "price DESC, id", "unit_price": "unit_price_ping DESC, id",
    "ping": "area_ping DESC, id", "public_ratio": "CASE WHEN public_ratio = 0 THEN 999 ELSE public_ratio END, id",
    "community": "CASE WHEN community_name = '' THEN 1 ELSE 0 END, community_name, lpad(date_raw, 7, '0') DESC, id",
}


@variants("o3_list_by_{}", lambda n: f"SELECT id FROM display ORDER BY {_LISTS[n]} LIMIT 150", list(_LISTS))
def _(spark, d, n):
    return display(spark, d).orderBy(*R.list_order(n, "asc")).select("id").limit(150)


@query("o5_ordered_addresses", "SELECT DISTINCT district, address FROM tx_addr ORDER BY district, address LIMIT 300")
def _(spark, d):
    return P.distinct_addresses(frame(spark, d, "tx_addr"), limit=300)


@query("o6_variant_limit")
def _(spark, d):
    q = frame(spark, d, "query_table").select("query_id", "query_text")
    return Z.expand_variants(q, limit=8).select("query_id", "variant")


@query("u5_distinct_numbers", "SELECT DISTINCT district, street, CAST(number AS INT) AS number FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr").select("district", "street", F.col("number").try_cast("int").alias("number")).distinct()


# --- address functions inside the standardisation job --------------------
_PARTS = "county_city, district, street, lane, alley, number, floor, sub_number"


@query(
    "z1_standardise",
    f"""SELECT id, address_half AS normalized, {_PARTS},
    concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number) AS base_address,
    concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number, '號') AS road_number,
    concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road,
    concat(replace(county_city, '台', '臺'), district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road_key,
    concat(substr(transaction_date, 1, 7), '|', substr(address_half, 4), '|', coalesce(total_price, 0)) AS dedup_key
    FROM tx_addr""",
)
def _(spark, d):
    raw = frame(spark, d, "tx_addr").select("id", "address", "transaction_date", "total_price")
    out = Z.standardise(raw, date="transaction_date", price="total_price")
    return out.select(
        "id", "normalized", *_PARTS.split(", "), "base_address", "road_number", "road", "road_key", "dedup_key"
    )


@query(
    "z2_parse_quality",
    """SELECT district, count(*) AS rows, CAST(sum(CASE WHEN id % 13 > 2 OR id % 13 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS with_street,
    CAST(sum(CASE WHEN id % 13 >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS with_city, CAST(sum(CASE WHEN id % 13 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS with_number,
    round(avg(CASE WHEN id % 13 >= 2 THEN 100.0E0 ELSE 0 END), 1) AS street_pct, round(avg(CASE WHEN id % 13 >= 2 THEN 100.0E0 ELSE 0 END), 1) AS city_pct
    FROM tx_addr GROUP BY district""",
)
def _(spark, d):
    raw = frame(spark, d, "tx_addr").select("id", F.col("district").alias("town"), F.expr(_MESSY).alias("address"))
    parsed = Z.add_parts(raw).drop("district").withColumnRenamed("town", "district")
    return Z.parse_quality(parsed, ["district"])


@query(
    "n1_half_width",
    "SELECT id, replace(address_half, '台', '臺') AS half FROM tx_addr WHERE county_city LIKE '台%' AND district <> '' UNION ALL SELECT id, address_half AS half FROM tx_addr WHERE county_city NOT LIKE '台%'",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", T.half_width("address").alias("half"))


@query("n2_full_width", "SELECT id, translate(address_half, '0123456789', '０１２３４５６７８９') AS full FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", T.full_width_digits("address_half").alias("full"))


@query(
    "n3_numeral_values",
    "SELECT id, CAST(id % 9999 + 1 AS BIGINT) AS value FROM tx_addr",
)
def _(spark, d):
    # Every number is written in Chinese by N4 and read back; all its forms must agree.
    named = frame(spark, d, "tx_addr").select("id", T.numeral_names(F.expr("id % 9999 + 1")).alias("names"))
    read = named.select("id", F.explode("names").alias("name")).withColumn("value", T.numeral_value("name"))
    return read.groupBy("id").agg(F.min("value").alias("value")).where("value is not null")


_D = "substr('零一二三四五六七八九', CAST({} AS INT) + 1, 1)"
_NAMED = (
    "CASE WHEN n >= 100 THEN concat(" + _D.format("n // 100") + ", '百', CASE WHEN n % 100 = 0 THEN '' WHEN n % 100 < 10 THEN concat('零', " + _D.format("n % 10") + ") ELSE concat("
    + _D.format("n // 10 % 10") + ", '十', CASE WHEN n % 10 > 0 THEN " + _D.format("n % 10") + " ELSE '' END) END)"
    " WHEN n >= 20 THEN concat(" + _D.format("n // 10") + ", '十', CASE WHEN n % 10 > 0 THEN " + _D.format("n % 10") + " ELSE '' END)"
    " WHEN n >= 10 THEN concat('十', CASE WHEN n % 10 > 0 THEN " + _D.format("n % 10") + " ELSE '' END) ELSE " + _D.format("n") + " END"
)


@query(
    "n4_numeral_names",
    f"SELECT id, {_NAMED} AS name FROM (SELECT id, id % 999 + 1 AS n FROM tx_addr)",
)
def _(spark, d):
    n = F.expr("id % 999 + 1")
    # The standard form is the one that is neither positional nor 一十x (they coincide below ten).
    names = frame(spark, d, "tx_addr").select("id", n.alias("n"), T.numeral_names(n).alias("names"))
    positional = F.translate(F.col("n").cast("string"), "0123456789", K.PLAIN_DIGITS)
    standard = F.filter("names", lambda x: (F.size("names") == 1) | ((x != positional) & ~x.startswith("一十")))
    return names.select("id", F.get(standard, F.lit(0)).alias("name"))


@query(
    "n5_number_variants",
    f"""SELECT id, n, list_sort(list_distinct(list_filter([CAST(n AS VARCHAR), translate(CAST(n AS VARCHAR), '0123456789', '０１２３４５６７８９'),
    translate(CAST(n AS VARCHAR), '0123456789', '零一二三四五六七八九'), {_NAMED},
    CASE WHEN n BETWEEN 10 AND 19 THEN concat('一十', CASE WHEN n % 10 > 0 THEN {_D.format('n % 10')} ELSE '' END) END,
    CASE WHEN n BETWEEN 20 AND 29 THEN concat('廿', CASE WHEN n % 10 > 0 THEN {_D.format('n % 10')} ELSE '' END) END], lambda x: x IS NOT NULL))) AS v
    FROM (SELECT id, id % 999 + 1 AS n FROM tx_addr)""",
)
def _(spark, d):
    n = F.expr("id % 999 + 1")
    return frame(spark, d, "tx_addr").select("id", n.alias("n"), T.number_variants(n.cast("string")).alias("v"))


@query("n6_address_tokens")
def _(spark, d):
    q = frame(spark, d, "query_table").select("query_id", F.posexplode(A.tokens("query_text")).alias("at", "t"))
    return q.select("query_id", "at", "t.type", "t.val", "t.arabic")


@query("n7_address_variants")
def _(spark, d):
    return Z.expand_variants(frame(spark, d, "query_table").select("query_id", "query_text")).select("query_id", "variant")


@query("n8_normalise", "SELECT id, address_half AS normalized FROM tx_addr")
def _(spark, d):
    # The house number is spelled in Chinese before it is normalised.
    tx = frame(spark, d, "tx_addr")
    n = F.col("number").cast("int")
    names = T.numeral_names(n)
    written = F.get(names, F.size(names) - 1)
    head = F.substring("address", F.lit(1), F.instr("address", "號") - F.length("number") - 1)
    tail = F.substring("address", F.instr("address", "號"), F.length("address"))
    return tx.select("id", A.normalize(F.concat(head, written, tail)).alias("normalized"))


@query(
    "n8_section_names",
    "SELECT id, concat('三民路', substr('一二三四五六七八九十', CAST(id % 10 + 1 AS INT), 1), '段', number, '號') AS normalized FROM tx_addr",
)
def _(spark, d):
    a = F.expr("concat('三民路', cast(id % 10 + 1 as string), '段', number, '號')")
    return frame(spark, d, "tx_addr").select("id", A.normalize(a).alias("normalized"))


@query("n9_parse_address", f"SELECT id, '王行里' AS village, '5鄰' AS neighborhood, {_PARTS} FROM tx_addr")
def _(spark, d):
    # City doubled, then village and neighbourhood, then the rest of the composed address.
    raw = frame(spark, d, "tx_addr").select(
        "id", F.expr("concat(county_city, county_city, district, '王行里５鄰', substr(address, length(county_city) + length(district) + 1))").alias("address")
    )
    return Z.add_parts(raw).select("id", "village", "neighborhood", *_PARTS.split(", "))


@query("n10_parse_query", f"SELECT id, {_PARTS} FROM tx_addr")
def _(spark, d):
    from plotline.operators.search import parse_queries

    q = frame(spark, d, "tx_addr").select("id", F.expr("concat(' ', replace(address, '樓', 'F'), ' ')").alias("query_text"))
    p = parse_queries(q)
    return p.select("id", *[F.col(f"q_{c}").alias(c) for c in _PARTS.split(", ")])


@query("n11_city_and_district", "SELECT id, county_city AS city, district FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", A.extract_city("address").alias("city"), A.extract_district("address").alias("district")
    )


@query(
    "n13_strip_city_district",
    "SELECT id, substr(address_half, length(county_city) + length(district) + 1) AS rest FROM tx_addr",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", A.strip_city_district("address").alias("rest"))


@query(
    "n15_roads",
    """SELECT id, street AS road, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN lane <> '' AND alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road_lane,
    concat(county_city, district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number, '號') AS to_number FROM tx_addr""",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", A.road("address").alias("road"), A.road_and_lane("address").alias("road_lane"),
        A.up_to_number("address_half").alias("to_number"),
    )


@query("n16_house_number", "SELECT id, CAST(CASE WHEN id % 13 <= 2 THEN -1 ELSE CAST(number AS INT) END AS INT) AS num FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr").select("id", A.house_number(F.coalesce(F.expr(_MESSY), F.lit(""))).alias("num"))


@query(
    "n17_community_names",
    """SELECT id, upper(translate(trim(coalesce(community_name, '')), 'Ａｂ', 'Ab')) AS name,
    replace(upper(translate(trim(coalesce(community_name, '')), 'Ａｂ', 'Ab')), ' ', '') AS compact FROM tx_addr""",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", T.community_name("community_name").alias("name"), T.community_name("community_name", "remove").alias("compact")
    )


CTES["name_pairs"] = """
SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT community_name AS n FROM tx_addr WHERE community_name <> '') a
JOIN (SELECT DISTINCT community_name AS n FROM tx_addr WHERE community_name <> '') b ON a.n[1] = b.n[1]"""


def _name_pairs(spark, d):
    n = frame(spark, d, "tx_addr").where("community_name <> ''").select(F.col("community_name").alias("a")).distinct()
    left = n.withColumn("k", F.substring("a", 1, 1))
    return left.join(left.withColumnRenamed("a", "b"), "k").drop("k")


@query(
    "n18_n20_similarity",
    """SELECT a, b, CAST(least(levenshtein(translate(a, '健安新城遠雄幸福都廳大院信義星池仁愛帝寶加館區', 'abcdefghijklmnopqrstuvw'), translate(b, '健安新城遠雄幸福都廳大院信義星池仁愛帝寶加館區', 'abcdefghijklmnopqrstuvw')), 2) AS INT) AS distance,
    round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / greatest(len(list_distinct(string_split(a, ''))), len(list_distinct(string_split(b, '')))), 6) AS shared
    FROM name_pairs""",
)
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select(
        "a", "b", T.edit_distance(a, b, 1).alias("distance"), F.round(T.shared_char_ratio(a, b), 6).alias("shared")
    )


@query("n19_subsequence", "SELECT id, true AS yes, false AS no FROM tx_addr")
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", T.is_subsequence(F.concat("street", "number"), F.col("address_half")).alias("yes"),
        T.is_subsequence(F.concat(F.lit("號"), F.col("street")), F.col("address_half")).alias("no"),
    )


@query(
    "n21_overlap",
    """SELECT a, b, round(CAST((SELECT sum(least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, '')))) FROM (SELECT unnest(list_distinct(string_split(a, ''))) AS c)) AS DOUBLE) / len(a), 6) AS overlap
    FROM name_pairs""",
)
def _(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.round(T.overlap_ratio(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(
    "n22_shown_address",
    "SELECT id, concat(district, substr(address, length(county_city) + length(district) + 1)) AS shown FROM tx_addr",
)
def _(spark, d):
    doubled = F.expr("concat(county_city, district, district, substr(address, length(county_city) + length(district) + 1))")
    return frame(spark, d, "tx_addr").select("id", A.strip_city_shown(doubled).alias("shown"))


@query(
    "n23_n24_base_address",
    """SELECT id, substr(address_half, length(county_city) + 1) AS no_city,
    concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number) AS base FROM tx_addr""",
)
def _(spark, d):
    c = A.strip_city_for_key(A.compact_form("address"))
    return frame(spark, d, "tx_addr").select("id", c.alias("no_city"), A.strip_floor(c).alias("base"))


@query("n25_after_hash", "SELECT id, substr(address, 5) AS clean FROM api")
def _(spark, d):
    return frame(spark, d, "api").select("id", A.after_hash("address").alias("clean"))


@query(
    "n26_floor_info",
    f"SELECT id, CAST(n AS VARCHAR) AS floor, CASE WHEN t <= 30 THEN CAST(t AS VARCHAR) ELSE concat({_NAMED.replace('n ', 't ').replace('(n ', '(t ').replace('n %', 't %')}, '層') END AS total FROM (SELECT id, id % 30 + 1 AS n, id % 40 + 1 AS t FROM tx_addr)",
)
def _(spark, d):
    name = lambda e: F.when(
        F.expr(e) < 10, F.get(T.numeral_names(F.expr(e)), F.lit(0))
    ).when(F.expr(e) < 20, F.concat(F.lit("十"), F.when(F.expr(e) > 10, F.get(T.numeral_names(F.expr(f"{e} - 10")), F.lit(0))).otherwise(""))).otherwise(
        F.concat(F.get(T.numeral_names(F.expr(f"cast(floor(({e}) / 10) as bigint)")), F.lit(0)), F.lit("十"),
                 F.when(F.expr(f"({e}) % 10") > 0, F.get(T.numeral_names(F.expr(f"({e}) % 10")), F.lit(0))).otherwise(""))
    )
    text = F.concat(name("id % 30 + 1"), F.lit("層/"), name("id % 40 + 1"), F.lit("層"))
    f = frame(spark, d, "tx_addr").select("id", A.floor_info(text).alias("f"))
    return f.select("id", "f.floor", "f.total")


@query(
    "n27_safe_numbers",
    """SELECT id, CASE id % 5 WHEN 0 THEN total_price WHEN 1 THEN id WHEN 2 THEN NULL WHEN 3 THEN -(id // 10) ELSE NULL END AS n,
    CASE id % 5 WHEN 0 THEN CAST(total_price AS DOUBLE) WHEN 1 THEN id + 0.5 WHEN 2 THEN NULL WHEN 3 THEN -(id / 10.0E0) ELSE NULL END AS x,
    CASE id % 5 WHEN 0 THEN total_price ELSE NULL END AS p FROM tx_addr""",
)
def _(spark, d):
    s = F.expr(
        "CASE id % 5 WHEN 0 THEN format_number(total_price, 0) WHEN 1 THEN concat(id, '.5') WHEN 2 THEN 'NaN' "
        "WHEN 3 THEN concat('-', floor(id / 10), '.', id % 10) ELSE 'n/a' END"
    )
    return frame(spark, d, "tx_addr").select("id", V.to_long(s).alias("n"), V.to_double(s).alias("x"), V.to_price(s).alias("p"))


_GEO = "concat(replace(county_city, '台', '臺'), district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number, '號')"


@query("n28_geo_form", f"SELECT id, {_GEO} AS geo FROM tx_addr")
def _(spark, d):
    # Noise of every kind the geocoding form removes.
    noisy = F.expr(
        "CASE id % 4 WHEN 0 THEN concat('null', address) WHEN 1 THEN concat(county_city, address_half) "
        "WHEN 2 THEN concat(' ', county_city, ' &#21414; ', substr(address, length(county_city) + 1), '等共用部分') "
        "ELSE concat(county_city, district, '十興里３鄰', substr(address, length(county_city) + length(district) + 1)) END"
    )
    return frame(spark, d, "tx_addr").select("id", A.geo_normalize(noisy).alias("geo"))


@query(
    "n28_county_upgrade",
    "SELECT id, concat(new, '中壢區', street, number, '號') AS geo FROM tx_addr JOIN (VALUES (0, '桃園市'), (1, '新北市'), (2, '臺中市'), (3, '臺南市'), (4, '高雄市')) AS u(i, new) ON id % 5 = u.i",
)
def _(spark, d):
    old = F.expr(
        "concat(element_at(array('桃園縣', '台北縣', '臺中縣', '台南縣', '高雄縣'), cast(id % 5 + 1 as int)), "
        "element_at(array('中壢市', '中壢鎮', '中壢鄉'), cast(id % 3 + 1 as int)), street, number, '號')"
    )
    return frame(spark, d, "tx_addr").select("id", A.geo_normalize(old).alias("geo"))


@query(
    "n29_geo_bases",
    f"""SELECT id, {_GEO} AS base, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' AND lane <> '' THEN concat(alley, '弄') WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END) AS road, street AS road_base FROM tx_addr""",
)
def _(spark, d):
    g = frame(spark, d, "tx_addr").withColumn("g", A.geo_normalize("address"))
    return g.select("id", A.geo_base("g").alias("base"), A.geo_road("g").alias("road"), A.geo_road_base("g").alias("road_base"))


@query(
    "n30_complete_address",
    "SELECT t.id, concat(replace(CASE t.district WHEN '中正區' THEN '台北市' ELSE county_city END, '台', '臺'), substr(address_half, 4)) AS full_address FROM tx_addr t",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    bare = tx.select("id", "district", F.expr("substr(address_half, length(county_city) + 1)").alias("a"))
    gaz = G.derive_gazetteer(tx)
    named = G.resolve_city(bare.withColumn("city", F.lit("")), gaz, "district", "city")
    return named.select("id", A.geo_complete("a", "district", A.point_city("city")).alias("full_address"))


@query(
    "n31_point_key",
    """SELECT id, district, concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END) AS street, number AS housenumber FROM tx_addr""",
)
def _(spark, d):
    k = frame(spark, d, "tx_addr").select("id", A.point_key(A.geo_normalize("address")).alias("k"))
    return k.select("id", "k.district", "k.street", "k.housenumber")


@query(
    "n32_point_spelling",
    "SELECT id, concat(number, '之', floor) AS housenumber, replace(county_city, '台', '臺') AS city FROM tx_addr",
)
def _(spark, d):
    n = F.expr("concat(translate(number, '0123456789', '０１２３４５６７８９'), '-', floor, '號')")
    return frame(spark, d, "tx_addr").select(
        "id", A.point_number(n).alias("housenumber"), A.point_city("county_city").alias("city")
    )


# --- district and city dimension -----------------------------------------
@query("j16_city_by_hint", "SELECT id, county_city FROM tx_addr")
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    bare = tx.select("id", F.col("county_city").alias("hint"), F.expr("substr(address, length(county_city) + 1)").alias("address"))
    parsed = Z.add_parts(bare)
    return G.resolve_city(parsed, G.derive_gazetteer(tx), hint=F.col("hint")).select("id", "county_city")


@query(
    "j16_city_without_hint",
    "SELECT id, CASE district WHEN '中正區' THEN '台北市' ELSE county_city END AS county_city FROM tx_addr",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    parsed = Z.add_parts(tx.select("id", F.expr("substr(address, length(county_city) + 1)").alias("address")))
    return G.resolve_city(parsed, G.derive_gazetteer(tx)).select("id", "county_city")


@query(
    "j17_city_by_stem",
    "SELECT id, county_city AS city FROM tx_addr",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    rows = tx.select("id", F.when(F.expr("id % 2 = 0"), F.expr("substr(district, 1, length(district) - 1)")).otherwise(F.col("district")).alias("town"))
    return G.city_of_district(rows, G.derive_gazetteer(tx), "town", "city").select("id", "city")


@query(
    "j18_city_codes",
    """SELECT id, CASE city WHEN 'C' THEN '基隆市' WHEN 'A' THEN '台北市' ELSE '新北市' END AS city_name,
    CASE city WHEN 'C' THEN 2 WHEN 'A' THEN 1 ELSE 3 END AS region FROM api""",
)
def _(spark, d):
    rows = frame(spark, d, "api").select("id", A.city_from_code("city").alias("city_name"))
    return rows.withColumn("region", F.get(A.listing_regions("city_name"), F.lit(0)))


# --- dates, money, colours, coordinates -----------------------------------
@query(
    "d1_d5_dates",
    """SELECT id, CASE WHEN length(transaction_date) >= 7 THEN concat(CAST(CAST(substr(transaction_date, 1, 3) AS INT) + 1911 AS VARCHAR), '/', substr(transaction_date, 4, 2), '/', substr(transaction_date, 6, 2)) END AS gregorian,
    transaction_date AS compact, roc_year AS year, CAST(substr(transaction_date, 1, 3) AS INT) AS raw_year,
    CASE WHEN length(transaction_date) >= 7 THEN concat(CAST(roc_year AS VARCHAR), '/', substr(transaction_date, 4, 2), '/', substr(transaction_date, 6, 2)) ELSE transaction_date END AS shown,
    concat(CAST(CAST(substr(build_date, 1, 3) AS INT) AS VARCHAR), '/', substr(build_date, 4, 2)) AS built FROM computed""",
)
def _(spark, d):
    slashed = F.expr("concat(substr(transaction_date, 1, length(transaction_date) - 4), '/', substr(transaction_date, length(transaction_date) - 3, 2), '/', substr(transaction_date, length(transaction_date) - 1, 2))")
    return frame(spark, d, "tx_addr").select(
        "id", D.gregorian_text("transaction_date").alias("gregorian"), D.compact(slashed).alias("compact"),
        D.roc_year(slashed).alias("year"), D.roc_year("transaction_date", exact=False).alias("raw_year"),
        D.display("transaction_date").alias("shown"), D.display_build("build_date").alias("built"),
    )


_LABEL = {
    "monthly": "concat(CAST(roc_year AS VARCHAR), '/', substr(date_key, 4, 2))",
    "quarterly": "concat(CAST(roc_year AS VARCHAR), 'Q', CAST((CAST(substr(date_key, 4, 2) AS INT) - 1) // 3 + 1 AS VARCHAR))",
    "yearly": "CAST(roc_year AS VARCHAR)",
}


@variants("d3_label_{}", lambda n: f"SELECT id, CASE WHEN id % 17 = 0 THEN '未知' ELSE {_LABEL[n]} END AS label FROM computed", list(_LABEL))
def _(spark, d, n):
    t = F.expr("CASE WHEN id % 17 = 0 THEN 'bad date' ELSE transaction_date END")
    return frame(spark, d, "tx_addr").select("id", D.period_label(t, n).alias("label"))


@variants(
    "d6_periods_{}",
    lambda n: f"""SELECT s AS first_day, CAST(unnest(generate_series(s, e, INTERVAL {3 if n == 'quarter' else 1} MONTH)) AS DATE) AS from_date
    FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS s, DATE '1998-08-01' AS e FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-01')""",
    ["month", "quarter"],
)
def _(spark, d, n):
    starts = table(spark, d, "orders").where("o_orderdate < timestamp'1998-08-01'").select(
        F.trunc("o_orderdate", "month").alias("first_day")
    ).distinct()
    step = 3 if n == "quarter" else 1
    p = starts.select("first_day", F.explode(D.periods(F.col("first_day"), F.lit("1998-08-01").cast("date"), step)).alias("p"))
    return p.select("first_day", "p.from_date")


@query(
    "m1_units",
    "SELECT id, round(building_area / 3.30579E0, 2) AS ping, round(building_area / 3.30579E0 * 3.30579E0, 6) AS back, round(unit_price * 3.30579E0, 2) AS per_ping FROM tx_addr",
)
def _(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", M.ping("building_area").alias("ping"), F.round(M.sqm(M.ping("building_area", None)), 6).alias("back"),
        M.price_per_ping("unit_price").alias("per_ping"),
    )


@query(
    "m2_public_ratios",
    """SELECT c.id, dd.public_ratio AS shown, c.public_ratio AS computed,
    round(CASE WHEN building_area > 0 AND main_area > 0 THEN (building_area - main_area - coalesce(attached_area, 0) - coalesce(balcony_area, 0)) * 100.0E0 / building_area END, 6) AS raw
    FROM computed c JOIN display dd ON c.id = dd.id""",
)
def _(spark, d):
    cols = ("building_area", "main_area", "attached_area", "balcony_area")
    return frame(spark, d, "tx_addr").select(
        "id", M.public_ratio_shown(*cols).alias("shown"), M.public_ratio_computed(*cols).alias("computed"),
        F.round(M.public_ratio_raw(*cols), 6).alias("raw"),
    )


_W = "total_price / 10000.0E0"
_HUE = lambda lo, at_hi, expr: f"CASE WHEN {_W} <= 0 THEN NULL WHEN {_W} <= 500 THEN {lo} WHEN {_W} >= 3000 THEN {at_hi} ELSE CAST(floor({expr} + 0.5E0) AS INT) END"
_RATIO = f"(({_W} - 500) / 2500)"


@query(
    "m4_price_colours",
    f"""SELECT id, CAST({_HUE(120, 0, f'120 - {_RATIO} * 120')} AS INT) AS hue, CAST({_HUE(70, 75, f'70 + {_RATIO} * 5')} AS INT) AS sat,
    CAST({_HUE(35, 45, f'35 + {_RATIO} * 10')} AS INT) AS light,
    CAST(CASE WHEN {_W} < 500 THEN 0 WHEN {_W} < 1500 THEN 1 WHEN {_W} < 3000 THEN 2 ELSE 3 END AS INT) AS band,
    CAST(CASE WHEN total_price > 40000000 THEN 3 WHEN total_price > 20000000 THEN 2 WHEN total_price > 0 THEN 1 ELSE 0 END AS INT) AS legacy
    FROM tx_addr WHERE total_price IS NOT NULL""",
)
def _(spark, d):
    w = F.col("total_price") / 10000
    c = frame(spark, d, "tx_addr").where("total_price is not null").select(
        "id", M.price_hue(w, 500, 3000).alias("c"), M.price_band(w, 500, 1500, 3000).alias("band"),
        M.legacy_band(F.col("total_price")).alias("legacy"),
    )
    return c.select("id", "c.*", "band", "legacy")


def _tm2_sql() -> str:
    """Another way to the same positions: the forward series solved by fixed-point steps, then the
    isometric latitude in its exponential form."""
    f = 1 / 298.257222101
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    scale = 0.9999 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    x = lambda v: f"({v!r}::DOUBLE)"
    cosh = lambda v: f"((exp({v}) + exp(-({v}))) / 2)"
    sinh = lambda v: f"((exp({v}) - exp(-({v}))) / 2)"
    sql = f"""SELECT id, (2500000.0::DOUBLE + id % 3000 * 90) / {x(scale)} AS y0,
        (150000.0::DOUBLE + id % 2000 * 100 - 250000.0::DOUBLE) / {x(scale)} AS x0, y0 AS yy, x0 AS xx FROM tx_addr"""
    for _ in range(7):
        dy = " + ".join(f"{x(a)} * sin({2 * k} * yy) * {cosh(f'{2 * k} * xx')}" for k, a in enumerate(alpha, 1))
        dx = " + ".join(f"{x(a)} * cos({2 * k} * yy) * {sinh(f'{2 * k} * xx')}" for k, a in enumerate(alpha, 1))
        sql = f"SELECT id, y0, x0, y0 - ({dy}) AS yy, x0 - ({dx}) AS xx FROM ({sql})"
    sql = f"""SELECT id, degrees(atan2({sinh('xx')}, cos(yy))) + 121.0::DOUBLE AS lng,
        sqrt((1 + sin(yy) / {cosh('xx')}) / (1 - sin(yy) / {cosh('xx')})) AS q, 2 * atan(q) - pi() / 2 AS phi FROM ({sql})"""
    for _ in range(7):
        sql = f"""SELECT id, lng, q, 2 * atan(q * pow((1 + {x(e)} * sin(phi)) / (1 - {x(e)} * sin(phi)), {x(e / 2)})) - pi() / 2 AS phi FROM ({sql})"""
    return f"SELECT id, round(degrees(phi), 7) AS lat, round(lng, 7) AS lng FROM ({sql})"


@query("m5_projected_coords", _tm2_sql())
def _(spark, d):
    # Positions are laid out in metres around the zone's centre.
    lat, lng = M.tm2_to_wgs84(F.expr("150000E0 + id % 2000 * 100"), F.expr("2500000E0 + id % 3000 * 90"))
    return frame(spark, d, "tx_addr").select("id", F.round(lat, 7).alias("lat"), F.round(lng, 7).alias("lng"))


@query(
    "m6_distance_points",
    "SELECT id, CASE WHEN x = 0 THEN 20 WHEN x <= 2 THEN 15 WHEN x <= 5 THEN 10 WHEN x <= 20 THEN 5 WHEN x <= 50 THEN 2 ELSE 0 END AS points FROM (SELECT id, abs(CAST(number AS INT) - CAST(floor AS INT)) AS x FROM tx_addr)",
)
def _(spark, d):
    diff = F.abs(F.col("number").cast("int") - F.col("floor").cast("int"))
    return frame(spark, d, "tx_addr").select("id", M.distance_points(diff).alias("points"))


# --- JSON and maps --------------------------------------------------------
@query(
    "c1_event_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(spark, d):
    j = table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("j"))
    return j.select("event_id", V.to_long("j.k").alias("k"))


@query(
    "c2_item_fields",
    "SELECT id, CASE WHEN id % 4 = 3 THEN '' ELSE coalesce(community_name, '') END AS community_name, CASE WHEN id % 3 = 2 THEN '' ELSE address END AS address, CAST(id AS VARCHAR) AS short_name FROM tx_addr WHERE NOT ((id % 4 = 3 OR coalesce(community_name, '') = '') AND id % 3 = 2)",
)
def _(spark, d):
    from plotline.operators.community import crawl_items

    raw = F.expr(
        "to_json(map_concat(map('sq', cast(id as string)), "
        "CASE id % 4 WHEN 0 THEN map('buildname', coalesce(community_name, '')) WHEN 3 THEN map('x', 'y') ELSE map('name', coalesce(community_name, '')) END, "
        "CASE id % 3 WHEN 0 THEN map('location', address) WHEN 1 THEN map('addr', address) ELSE map('z', '') END))"
    )
    items = frame(spark, d, "tx_addr").select("id", raw.alias("raw_data"))
    return crawl_items(items).select("id", "community_name", "address", "short_name")


@query(
    "c4_changed_fields",
    "SELECT id, CASE WHEN coalesce(community_name, '') = '' THEN '新社區' END AS community, CASE WHEN coalesce(lat, 0) = 0 THEN '25.5' END AS lat FROM tx_addr",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    both = tx.select(
        "id", F.struct("community_name", "lat", "note").alias("old"),
        F.struct(F.lit("新社區").alias("community_name"), F.lit(25.5).alias("lat"), F.lit("").alias("note")).alias("new"),
    )
    m = both.select("id", V.changed_fields("old", "new", {"community_name": "text", "lat": "number", "note": "text"}).alias("m"))
    return m.select("id", F.col("m")["community_name"].alias("community"), F.col("m")["lat"].alias("lat"))


# --- user surface ---------------------------------------------------------
@query("x2_user_normaliser", f"SELECT id, {_PARTS} FROM tx_addr")
def _(spark, d):
    raw = frame(spark, d, "tx_addr").select("id", F.expr("replace(address, '路', '@路')").alias("address"))
    own = lambda c: A.normalize(F.replace(c, F.lit("@"), F.lit("")))
    return Z.add_parts(raw, normaliser=own).select("id", *_PARTS.split(", "))


@query(
    "x3_sql_functions",
    "SELECT id, round(building_area / 3.30579E0, 2) AS ping, CAST(number AS INT) AS num, roc_year AS year FROM computed",
)
def _(spark, d):
    Z.register_sql_functions(spark)
    frame(spark, d, "tx_addr").createOrReplaceTempView("tx_for_functions")
    return spark.sql(
        "SELECT id, to_ping(building_area) AS ping, house_number_of(address_half) AS num, roc_year_of(transaction_date) AS year FROM tx_for_functions"
    )


@query("upper_median_by_district", "SELECT district, list_sort(list(total_price))[CAST(count(total_price) // 2 AS INT) + 1] AS mid FROM tx_addr WHERE total_price IS NOT NULL GROUP BY district")
def _(spark, d):
    return upper_median(frame(spark, d, "tx_addr"), ["district"], "total_price", "mid")
