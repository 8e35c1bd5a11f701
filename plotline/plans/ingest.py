"""Queries: sources, sinks, import with enrichment, streaming import."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import schema
from plotline.operators import community as C, geo, ingest as I, present as R, report as Q
from plotline.plans.fixture import frame, stored
from plotline.plans.registry import CTES, query
from plotline.session import scratch_folder
from plotline.sources import readers as IN, writers as OUT
from plotline.streaming import ingest as ST

_KEY = "concat(substr(transaction_date, 1, 7), '|', substr(address_half, 4), '|', coalesce(total_price, 0))"
_PARTS = "county_city, district, street, lane, alley, number, floor, sub_number"
_PART_LIST = _PARTS.split(", ")


# --- sources --------------------------------------------------------------
def _registry_file(spark, d):
    """The transactions as a 33-column registry file with its two header rows."""
    given = {
        "raw_district": "district", "address": "address", "transaction_date": "transaction_date",
        "building_type": "building_type", "build_date": "build_date", "building_area": "building_area",
        "rooms": "rooms", "unit_price": "unit_price", "note": "note", "main_area": "main_area",
        "attached_area": "attached_area", "balcony_area": "balcony_area",
    }
    tx = frame(spark, d, "tx_addr")
    rows = tx.select(*[
        (
            F.col(given[n]).cast("string") if n in given
            else F.format_number("total_price", 0) if n == "total_price"
            else F.concat("floor", F.lit("層")) if n == "floor_level"
            else F.concat(F.lit("R"), F.col("id").cast("string")) if n == "serial_no"
            else F.lit("")
        ).alias(n)
        for n in schema.REGISTRY_COLUMNS
    ])
    english = spark.range(1).select(*[F.lit(f"The {n}").alias(n) for n in schema.REGISTRY_COLUMNS])
    return stored(spark, d, "registry", lambda path: rows.unionByName(english).write.option("header", True).csv(path))


@query(
    "s1_registry_csv",
    f"""SELECT concat('R', CAST(id AS VARCHAR)) AS serial_no, address, {_PARTS}, transaction_date, total_price, building_area, main_area, rooms,
    concat(floor, '層') AS floor_level, {_KEY} AS dedup_key FROM tx_addr""",
)
def _(spark, d):
    rows = IN.read_registry_csv(spark, _registry_file(spark, d))
    return rows.select(
        "serial_no", "address", *_PART_LIST, "transaction_date", "total_price", "building_area", "main_area",
        "rooms", "floor_level", "dedup_key",
    )


@query(
    "s2_generic_csv",
    f"""SELECT address, {_PARTS.replace('county_city', "'測試市' AS county_city")}, transaction_date, total_price, building_area,
    CASE WHEN lat IS NOT NULL THEN lat END AS lat, CASE WHEN id % 2 = 0 THEN lng ELSE 121.0E0 END AS lng FROM tx_addr""",
)
def _(spark, d):
    # Headers in any order, an unknown one, and two that both mean the longitude.
    tx = frame(spark, d, "tx_addr")
    path = scratch_folder(spark, "generic")
    tx.select(
        F.lit("測試市").alias("縣市"), F.format_number("total_price", 0).alias("總價"), F.col("address").alias("地址"),
        F.col("transaction_date").alias("交易日期"), F.col("building_area").cast("string").alias("建物面積"),
        F.lit("x").alias("其他"), F.col("lat").cast("string").alias("緯度"), F.lit("121.0").alias("經度"),
        F.when(F.expr("id % 2 = 0"), F.coalesce(F.col("lng").cast("string"), F.lit(""))).otherwise("").alias("lon"),
    ).where("lng is not null or id % 2 = 1").unionByName(
        tx.where("lng is null and id % 2 = 0").select(
            F.lit("測試市").alias("縣市"), F.format_number("total_price", 0).alias("總價"), F.col("address").alias("地址"),
            F.col("transaction_date").alias("交易日期"), F.col("building_area").cast("string").alias("建物面積"),
            F.lit("x").alias("其他"), F.col("lat").cast("string").alias("緯度"), F.lit("").alias("經度"), F.lit("").alias("lon"),
        )
    ).write.option("header", True).csv(path)
    rows = IN.read_generic_csv(spark, path)
    return rows.select("address", *_PART_LIST, "transaction_date", "total_price", "building_area", "lat", "lng")


_API_SQL = f"""
SELECT concat('api_sq', CAST(id AS VARCHAR)) AS serial_no, address_half AS address, {_PARTS}, transaction_date, total_price, rooms,
  CASE WHEN building_area > 0 THEN building_area * 3.305785E0 END AS building_area, concat(floor, '層') AS floor_level, concat(total_floors, '層') AS total_floors,
  coalesce(community_name, '') AS community_name, CASE WHEN lat <> 0 THEN lat END AS lat, CASE WHEN lng <> 0 THEN lng END AS lng, {_KEY} AS dedup_key
FROM tx_addr WHERE id % 2 = 0"""
_API_COLS = (
    "serial_no", "address", *_PART_LIST, "transaction_date", "total_price", "rooms", "building_area", "floor_level",
    "total_floors", "community_name", "lat", "lng", "dedup_key",
)


@query("s3_api_rows", _API_SQL)
def _(spark, d):
    path = scratch_folder(spark, "api")
    frame(spark, d, "api").write.parquet(path)
    return IN.read_api(spark, path).select(*_API_COLS)


@query(
    "s4_u3_canonical_union",
    "SELECT id, address, total_price, lat FROM tx_addr UNION ALL SELECT id, address, total_price, CAST(NULL AS DOUBLE) AS lat FROM tx_addr WHERE id % 7 = 0",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    path, older = scratch_folder(spark, "stored"), scratch_folder(spark, "older")
    IN.canonical(tx).write.parquet(path)
    tx.where("id % 7 = 0").select("id", "address", "total_price").write.parquet(older)
    both = IN.read_transactions(spark, path).unionByName(IN.read_transactions(spark, older))
    return both.select("id", "address", "total_price", "lat")


@query(
    "s6_point_file",
    """SELECT replace(city, '台', '臺') AS city, district, street, concat(housenumber, '之2') AS housenumber, lat, lng FROM points WHERE point_id % 5 <> 0""",
)
def _(spark, d):
    path = scratch_folder(spark, "points")
    frame(spark, d, "points").select(
        F.when(F.expr("point_id % 5 = 0"), "91.5").otherwise(F.col("lat").cast("string")).alias("@lat"),
        F.col("lng").cast("string").alias("@lon"), F.col("city").alias("addr:city"), "district", "street",
        F.concat("housenumber", F.lit("-2號")).alias("housenumber"),
    ).write.option("header", True).csv(path)
    return IN.read_points_csv(spark, path).select("city", "district", "street", "housenumber", "lat", "lng")


@query(
    "s7_manual_mapping",
    "SELECT address, concat('手動', district) AS community_name, district, '' AS remark FROM tx_addr WHERE id % 40 = 0 AND id % 80 <> 0",
)
def _(spark, d):
    path = scratch_folder(spark, "manual")
    frame(spark, d, "tx_addr").where("id % 40 = 0").select(
        F.concat(F.lit(" "), "address").alias("地址"),
        F.when(F.expr("id % 80 = 0"), " ").otherwise(F.expr("concat('手動', district)")).alias("社區名稱"),
        F.col("district").alias("鄉鎮市區"), F.lit("").alias("備註"),
    ).write.option("header", True).csv(path)
    m = IN.read_manual_csv(spark, path)
    return m.withColumn("remark", F.coalesce("remark", F.lit("")))


@query("s8_json_cache", "SELECT address_key, lat, lng, 'exact' AS level FROM cache")
def _(spark, d):
    # One JSON object per row of text, as many small exports of the cache.
    path = scratch_folder(spark, "json")
    text = F.to_json(F.map_from_arrays(F.array("address_key"), F.array(F.array("lat", "lng"))))
    frame(spark, d, "cache").select(text.alias("value")).write.text(path)
    return IN.read_json_cache(spark, path, per_line=True).select("address_key", "lat", "lng", "level")


@query("s9_address_list", "SELECT DISTINCT query_text FROM query_table")
def _(spark, d):
    path = scratch_folder(spark, "list")
    q = frame(spark, d, "query_table").select(F.concat(F.lit("  "), "query_text").alias("value"))
    q.unionByName(q.select(F.lit("   ").alias("value"))).write.text(path)
    return IN.read_address_list(spark, path).select("query_text")


@query(
    "s10_many_files",
    "SELECT 1 AS source_rank, count(*) AS rows FROM tx_addr UNION ALL SELECT 2, count(*) FROM api",
)
def _(spark, d):
    api = scratch_folder(spark, "api")
    frame(spark, d, "api").write.parquet(api)
    rows = IN.read_many(spark, [(_registry_file(spark, d), "registry_csv"), (api, "api")])
    return rows.groupBy("source_rank").agg(F.count("*").alias("rows"))


# --- import ---------------------------------------------------------------
def arrivals(spark, d):
    """Accepted rows of the three sources with their dedup key."""
    accepted, _ = I.split_rejects(frame(spark, d, "arrivals"))
    return I.with_dedup_key(accepted).drop("expected_key")


CTES["accepted"] = """
SELECT *, concat(CAST(source_rank AS VARCHAR), '#', ingest_seq) AS ord FROM arrivals WHERE expected_key IS NOT NULL"""


@query("e2_dedup_key", "SELECT serial_no, expected_key AS dedup_key FROM accepted")
def _(spark, d):
    return arrivals(spark, d).select("serial_no", "dedup_key")


_FILL = lambda c, empty: f"coalesce(arg_min({c}, ord) FILTER (WHERE NOT ({empty})), list({c} ORDER BY ord)[1]) AS {c}"
_MERGED = f"""
SELECT expected_key AS dedup_key, list(serial_no ORDER BY ord)[1] AS serial_no, list(address ORDER BY ord)[1] AS address,
  {_FILL('building_type', "building_type = '' OR building_type IS NULL")}, {_FILL('community_name', "community_name IS NULL OR community_name = ''")},
  {_FILL('rooms', 'rooms IS NULL')}, {_FILL('note', "note = ''")}, {_FILL('lat', 'lat IS NULL OR lat = 0')}, {_FILL('lng', 'lng IS NULL OR lng = 0')},
  {_FILL('building_area', 'building_area = 0')}
FROM accepted GROUP BY expected_key"""
CTES["merged"] = _MERGED
_MERGED_COLS = ("dedup_key", "serial_no", "address", "building_type", "community_name", "rooms", "note", "lat", "lng", "building_area")


@query("e1_merge_and_enrich", "SELECT * FROM merged")
def _(spark, d):
    return I.merge_duplicates(arrivals(spark, d)).select(*_MERGED_COLS)


@query("w2_first_per_key", "SELECT expected_key AS dedup_key, list(serial_no ORDER BY ord)[1] AS serial_no FROM accepted GROUP BY 1")
def _(spark, d):
    return I.first_by_key(arrivals(spark, d)).select("dedup_key", "serial_no")


_EMPTIES = {
    "building_type": "building_type = ''", "community_name": "community_name IS NULL OR community_name = ''", "rooms": "rooms IS NULL",
    "note": "note = ''", "lat": "lat IS NULL OR lat = 0", "lng": "lng IS NULL OR lng = 0", "building_area": "building_area = 0",
}
CTES["fillers"] = "SELECT expected_key, min(ord) AS first_ord, " + ", ".join(
    f"min(ord) FILTER (WHERE NOT ({e})) AS f_{c}" for c, e in _EMPTIES.items()
) + " FROM accepted GROUP BY expected_key"
CTES["classified"] = (
    "SELECT a.serial_no, CASE WHEN a.ord = f.first_ord THEN 'inserted' WHEN "
    + " OR ".join(f"coalesce(a.ord = f.f_{c}, false)" for c in _EMPTIES)
    + " THEN 'enriched' ELSE 'duplicated' END AS outcome, '' AS reason FROM accepted a JOIN fillers f ON f.expected_key = a.expected_key "
    "UNION ALL SELECT serial_no, 'discarded', CASE WHEN address = '' THEN 'no_address' ELSE 'no_number' END FROM arrivals WHERE expected_key IS NULL"
)


def _classified(spark, d):
    return I.outcomes(I.with_dedup_key(frame(spark, d, "arrivals")))


@query("e3_outcomes", "SELECT * FROM classified")
def _(spark, d):
    return _classified(spark, d).select("serial_no", "outcome", F.coalesce("reject_reason", F.lit("")).alias("reason"))


@query("a11_outcome_counts", "SELECT outcome, reason, count(*) AS rows FROM classified GROUP BY ALL")
def _(spark, d):
    return I.outcome_counts(_classified(spark, d))


@query(
    "j1_known_keys",
    "SELECT a.serial_no, EXISTS (SELECT 1 FROM accepted b WHERE b.source_rank = 1 AND b.expected_key = a.expected_key) AS is_known FROM accepted a WHERE a.source_rank > 1",
)
def _(spark, d):
    rows = arrivals(spark, d)
    return I.probe_existing(rows.where("source_rank > 1"), rows.where("source_rank = 1")).select("serial_no", "is_known")


_BASE = "concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number)"
CTES["votes"] = f"""
SELECT base_address, community, votes FROM (
  SELECT base_address, community, votes, row_number() OVER (PARTITION BY base_address ORDER BY votes DESC, community) AS rn FROM (
    SELECT {_BASE} AS base_address, community_name AS community, count(*) AS votes FROM tx_addr WHERE id % 2 = 0 AND community_name <> '' GROUP BY 1, 2) v) r WHERE rn = 1"""


@query("a7_community_votes", "SELECT base_address, community, votes FROM votes")
def _(spark, d):
    return I.vote_communities(frame(spark, d, "api"))


@query(
    "j2_backfill_community",
    f"""SELECT t.id, CASE WHEN t.name IS NULL OR t.name = '' THEN coalesce(v.community, t.name) ELSE t.name END AS community_name
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE community_name END AS name FROM tx_addr) t LEFT JOIN votes v ON v.base_address = {_BASE}""",
)
def _(spark, d):
    gaps = frame(spark, d, "tx_addr").withColumn("community_name", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE community_name END"))
    return I.backfill_community(gaps, I.vote_communities(frame(spark, d, "api"))).select("id", "community_name")


def _import(spark, d):
    api_path = scratch_folder(spark, "api")
    frame(spark, d, "api").write.parquet(api_path)
    registry = IN.read_registry_csv(spark, _registry_file(spark, d))
    api = IN.read_api(spark, api_path)
    votes = frame(spark, d, "api").select("address", "community")
    return I.import_rows([registry, api], api_rows=votes)


@query(
    "e4_import",
    f"""SELECT k.dedup_key, CASE WHEN k.community = '' THEN coalesce(v.community, '') ELSE k.community END AS community_name
    FROM (SELECT {_KEY} AS dedup_key, coalesce(max(CASE WHEN id % 2 = 0 THEN community_name END), '') AS community, max({_BASE}) AS base FROM tx_addr GROUP BY 1) k
    LEFT JOIN votes v ON v.base_address = k.base""",
)
def _(spark, d):
    return _import(spark, d).select("dedup_key", F.coalesce("community_name", F.lit("")).alias("community_name"))


@query(
    "e4_import_coverage",
    f"""SELECT count(DISTINCT {_KEY}) AS total, count(DISTINCT {_KEY}) AS has_street FROM tx_addr""",
)
def _(spark, d):
    return Q.coverage(_import(spark, d)).select("total", "has_street")


# --- sinks ----------------------------------------------------------------
@query(
    "k1_export_csv",
    "SELECT id, address, transaction_date, total_price FROM computed ORDER BY date_key DESC, id DESC LIMIT 400",
)
def _(spark, d):
    path = scratch_folder(spark, "export")
    rows = R.newest(frame(spark, d, "tx_addr"), 400).select("id", "address", "transaction_date", "total_price")
    OUT.export_csv(rows, path)
    return spark.read.schema("id long, address string, transaction_date string, total_price long").option("header", True).csv(path)


@query("k1_export_cache", "SELECT address_key, lat, lng, level FROM cache")
def _(spark, d):
    path = scratch_folder(spark, "export")
    OUT.export_csv(frame(spark, d, "cache").select("address_key", "lat", "lng", "level"), path, newest_by="address_key")
    return spark.read.schema("address_key string, lat double, lng double, level string").option("header", True).csv(path)


@query("k2_canonical_sink", "SELECT id, address, transaction_date, total_price, community_name FROM tx_addr")
def _(spark, d):
    path = scratch_folder(spark, "table")
    OUT.write_transactions(IN.canonical(frame(spark, d, "tx_addr")), path)
    return OUT.read_transactions(spark, path).select("id", "address", "transaction_date", "total_price", "community_name")


@query("k2_incremental_upsert", "SELECT * FROM merged")
def _(spark, d):
    path = scratch_folder(spark, "table")
    rows = arrivals(spark, d)
    # The sources arrive one after the other; the table must equal one import of all.
    for rank in (1, 2, 3):
        OUT.upsert_transactions(spark, rows.where(F.col("source_rank") == rank), path, buckets=2)
    return OUT.read_transactions(spark, path).select(*_MERGED_COLS)


@query(
    "k3_learned_mappings",
    "SELECT DISTINCT address, community_name, district FROM tx_addr WHERE community_name <> '' AND NOT EXISTS (SELECT 1 FROM tx_addr o WHERE o.id % 40 = 0 AND o.address = tx_addr.address AND o.community_name = tx_addr.community_name)",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    mapped = tx.where("id % 40 = 0").select("address", "community_name")
    return OUT.learned_mappings(tx, mapped).select("address", "community_name", "district")


@query("k4_insert_or_ignore", "SELECT sq, CAST(max(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS INT) AS was_there FROM api GROUP BY sq")
def _(spark, d):
    api = frame(spark, d, "api").select("id", "sq")
    path = scratch_folder(spark, "raw")
    first = api.where("id % 3 = 0").withColumn("was_there", F.lit(1))
    OUT.append_new(first, None, ["sq"], path)
    again = api.unionByName(api).withColumn("was_there", F.lit(0))
    OUT.append_new(again, spark.read.parquet(path), ["sq"], path)
    return spark.read.parquet(path).select("sq", "was_there")


_GEO_BASE = "concat(replace(county_city, '台', '臺'), district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END, number, '號')"
_GEO_ROAD = "concat(replace(county_city, '台', '臺'), district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END)"
CTES["both_caches"] = """
SELECT address_key, lat, lng, level, source FROM cache
UNION ALL SELECT concat(replace(city, '台', '臺'), district, street), avg(lat), avg(lng), 'road', 'road_centre' FROM points GROUP BY 1"""


def _caches(spark, d):
    roads = geo.road_centres(frame(spark, d, "points")).select(
        F.col("road_key").alias("address_key"), "lat", "lng", F.lit("road").alias("level"), F.lit("road_centre").alias("source")
    )
    return frame(spark, d, "cache").unionByName(roads)


@query(
    "k5_j6_write_back",
    f"""SELECT t.id, round(coalesce(t.lat, b.lat, r.lat), 6) AS lat, round(CASE WHEN t.lat IS NULL THEN coalesce(b.lng, r.lng) ELSE t.lng END, 6) AS lng,
    CASE WHEN t.lat IS NULL THEN CASE WHEN b.lat IS NOT NULL THEN b.level WHEN r.lat IS NOT NULL THEN 'road' END END AS geocode_level
    FROM tx_addr t LEFT JOIN both_caches b ON b.address_key = {_GEO_BASE} LEFT JOIN both_caches r ON r.address_key = {_GEO_ROAD}""",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr").select("id", "district", "address", "lat", "lng")
    out = geo.write_back(tx, _caches(spark, d))
    return out.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "geocode_level")


@query(
    "k6_replace_city_points",
    "SELECT city, CAST(sum(CASE WHEN city = '台北市' THEN 2 ELSE 1 END) AS BIGINT) AS mark, count(*) AS points FROM points GROUP BY city",
)
def _(spark, d):
    path = scratch_folder(spark, "points")
    p = frame(spark, d, "points")
    OUT.replace_city_points(p.withColumn("mark", F.lit(1)), path)
    OUT.replace_city_points(p.where("city = '台北市'").withColumn("mark", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("city").agg(F.sum("mark").alias("mark"), F.count("*").alias("points"))


# --- crawl bookkeeping ----------------------------------------------------
@query(
    "j15_open_work",
    """SELECT c.city, p.period FROM (SELECT DISTINCT city FROM api) c, (SELECT unnest(['114-01', '114-02', '114-03']) AS period) p
    WHERE NOT EXISTS (SELECT 1 FROM api a WHERE a.city = c.city AND a.id % 7 = 0 AND p.period = '114-02')""",
)
def _(spark, d):
    api = frame(spark, d, "api")
    done = api.where("id % 7 = 0").select("city", F.lit("114-02").alias("period")).distinct()
    steps = F.array(*[F.lit(p) for p in ("114-01", "114-02", "114-03")])
    return C.open_work(api.select("city").distinct(), steps, "period", done)


# --- streaming ------------------------------------------------------------
# Files of an arrival; a micro-batch takes as many.
_FILES = 16


def _landing(spark, d, df, parts: int = 3):
    """Rows written as several files in a landing folder."""
    path = scratch_folder(spark, "landing")
    df.repartition(parts, "id").write.parquet(path)
    return path


@query("t1_resumable_ingest", "SELECT sq FROM api")
def _(spark, d):
    api = frame(spark, d, "api").select("id", "city", "sq", "date_str")
    path = _landing(spark, d, api.where("id % 4 = 0"))
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    for part in (None, api.where("id % 4 <> 0")):
        if part is not None:  # files that arrive before the second run
            part.repartition(2).write.mode("append").parquet(path)
        ST.append_stream(ST.read_landing(spark, path, api.schema, 1), out, mark).awaitTermination()
    return spark.read.parquet(out).select("sq")


@query(
    "t1_progress",
    "SELECT city, concat(split_part(date_str, '/', 1), '-', split_part(date_str, '/', 2)) AS period, count(*) AS count FROM api GROUP BY ALL",
)
def _(spark, d):
    return ST.progress(frame(spark, d, "api"))


@query("t2_stream_unique", "SELECT DISTINCT sq FROM api")
def _(spark, d):
    api = frame(spark, d, "api").select("id", "sq")
    path = _landing(spark, d, api.unionByName(api.where("id % 3 = 0")), 4)
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    stream = ST.unique_rows(ST.read_landing(spark, path, api.schema, 2), "sq")
    ST.append_stream(stream, out, mark).awaitTermination()
    return spark.read.parquet(out).select("sq")


@query("t3_stream_upsert", "SELECT * FROM merged")
def _(spark, d):
    rows = arrivals(spark, d)
    path, mark = scratch_folder(spark, "table"), scratch_folder(spark, "mark")
    # One landing folder per source, in order of precedence; two micro-batches inside each, of several files, so no task has half a source.
    for rank in (1, 2, 3):
        part = rows.where(F.col("source_rank") == rank)
        landing = scratch_folder(spark, f"landing{rank}")
        part.repartition(2 * _FILES, "dedup_key").write.parquet(landing)
        stream = ST.read_landing(spark, landing, part.schema, _FILES)
        ST.upsert_stream(stream, path, f"{mark}-{rank}", rank).awaitTermination()
    return OUT.read_transactions(spark, path).select(*_MERGED_COLS)


@query(
    "t4_stream_trend",
    """SELECT concat(CAST(roc_year AS VARCHAR), '/', substr(date_key, 4, 2)) AS label, count(*) AS count, CAST(round(avg(total_price)) AS BIGINT) AS avg_price,
    min(total_price) AS min_price, max(total_price) AS max_price FROM computed WHERE total_price > 0 GROUP BY 1""",
)
def _(spark, d):
    rows = frame(spark, d, "tx_addr").select("id", "transaction_date", "total_price")
    path = _landing(spark, d, rows)
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    stream = ST.monthly_trend(ST.read_landing(spark, path, rows.schema, 1))
    ST.table_stream(stream, out, mark).awaitTermination()
    return spark.read.parquet(out)


@query(
    "t4_stream_daily_trend",
    """SELECT strftime(day, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS count, CAST(round(sum(s) / sum(n)) AS BIGINT) AS avg_price, min(lo) AS min_price, max(hi) AS max_price
    FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS s, min(CAST(floor(o_totalprice) AS BIGINT)) AS lo, max(CAST(floor(o_totalprice) AS BIGINT)) AS hi FROM orders GROUP BY 1) x
    GROUP BY 1""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("tx_time"), F.floor("o_totalprice").alias("total_price")
    )
    path = _landing(spark, d, rows, 1)
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    daily = ST.daily_trend(ST.read_landing(spark, path, rows.schema))
    ST.table_stream(daily, out, mark).awaitTermination()
    return ST.roll_up_months(spark.read.parquet(out))


# --- streams behind a watermark ---------------------------------------------
def _by_date(spark, d):
    """Orders in three parts, the oldest first."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("tx_time"), F.floor("o_totalprice").alias("total_price")
    )
    year = F.year("tx_time")
    first, last = rows.agg(F.min(year), F.max(year)).first()
    third = (last - first + 1) / 3
    part = F.least(F.floor((year - first) / third), F.lit(2))
    return [rows.where(part == k) for k in range(3)]


def _arriving(spark, parts, run):
    """Parts that arrive one after the other, each as several files; the stream stops after the second and goes on from its checkpoint.

    Files are dealt by ``id``, so no task writes or reads a whole part and copies share a file.
    """
    landing = scratch_folder(spark, "landing")
    for k, part in enumerate(parts):
        part.repartition(_FILES, "id").write.mode("append").parquet(landing)
        if k:
            run(ST.read_landing(spark, landing, part.schema, _FILES)).awaitTermination()


@query("t2_unique_within_watermark", "SELECT o_orderkey AS id FROM orders")
def _(spark, d):
    old, mid, new = _by_date(spark, d)
    # Copies in the same file, and copies that come when their time is over.
    parts = [old.unionByName(old.where("id % 3 = 0")), mid, new.unionByName(new.where("id % 5 = 0")).unionByName(old)]
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    _arriving(spark, parts, lambda s: ST.append_stream(ST.unique_rows(s, "id", "tx_time", "30 days"), out, mark))
    return spark.read.parquet(out).select("id")


@query(
    "t4_append_daily_trend",
    """SELECT day, count(*) AS count, CAST(sum(price) AS BIGINT) AS sum_price, min(price) AS min_price, max(price) AS max_price
    FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderdate AS DATE) AS born, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) o
    WHERE born + 8 <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY day""",
)
def _(spark, d):
    old, mid, new = _by_date(spark, d)
    # The first year once more, after its days were reported.
    late = old.where(F.year("tx_time") == old.agg(F.min(F.year("tx_time"))).first()[0]).withColumn("total_price", F.lit(1).cast("long"))
    out, mark = scratch_folder(spark, "out"), scratch_folder(spark, "mark")
    _arriving(spark, [old, mid, new.unionByName(late)], lambda s: ST.append_stream(ST.daily_trend(s), out, mark))
    days = spark.read.parquet(out)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count", "sum_price", "min_price", "max_price")
