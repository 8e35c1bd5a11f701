"""Queries: point look-ups, cache, road centres, multi-level geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import filters as P, gazetteer as G, geo, present as R, report as Q
from plotline.plans.fixture import frame
from plotline.plans.ingest import _GEO_BASE, _GEO_ROAD
from plotline.plans.registry import CTES, query
from plotline.session import stage

_STREET = "concat(t.street, CASE WHEN t.lane <> '' THEN concat(t.lane, '巷') ELSE '' END, CASE WHEN t.alley <> '' THEN concat(t.alley, '弄') ELSE '' END)"
CTES["exact_points"] = "SELECT district, street, housenumber, min(point_id) AS point_id, arg_min(lat, point_id) AS lat, arg_min(lng, point_id) AS lng FROM points GROUP BY district, street, housenumber"
CTES["loose_points"] = "SELECT street, housenumber, arg_min(lat, point_id) AS lat, arg_min(lng, point_id) AS lng FROM points GROUP BY street, housenumber"
CTES["road_points"] = "SELECT concat(replace(city, '台', '臺'), district, street) AS road_key, avg(lat) AS lat, avg(lng) AS lng FROM points GROUP BY 1"
CTES["located"] = f"""
SELECT t.id, t.address, {_GEO_BASE.replace('county_city', 't.county_city').replace('district', 't.district').replace('street', 't.street').replace('lane', 't.lane').replace('alley', 't.alley').replace('number', 't.number')} AS geo_base,
  e.lat AS e_lat, e.lng AS e_lng, l.lat AS l_lat, l.lng AS l_lng, c.lat AS c_lat, c.lng AS c_lng, c.level AS c_level, c.source AS c_source, r.lat AS r_lat, r.lng AS r_lng
FROM tx_addr t
LEFT JOIN exact_points e ON e.district = t.district AND e.street = {_STREET} AND e.housenumber = t.number
LEFT JOIN loose_points l ON l.street = {_STREET} AND l.housenumber = t.number
LEFT JOIN cache c ON c.address_key = concat(replace(t.county_city, '台', '臺'), t.district, {_STREET}, t.number, '號')
LEFT JOIN road_points r ON r.road_key = concat(replace(t.county_city, '台', '臺'), t.district, {_STREET})"""


@query("j3_w4_point_lookup", "SELECT id, coalesce(e_lat, l_lat) AS lat, coalesce(e_lng, l_lng) AS lng FROM located")
def _(spark, d):
    out = geo.lookup_points(geo.with_geo_keys(frame(spark, d, "tx_addr")), frame(spark, d, "points"))
    return out.select("id", F.col("point_lat").alias("lat"), F.col("point_lng").alias("lng"))


@query("j4_cache_lookup", "SELECT id, geo_base, c_lat AS lat, c_lng AS lng, c_level AS level, c_source AS source FROM located")
def _(spark, d):
    out = geo.lookup_cache(geo.with_geo_keys(frame(spark, d, "tx_addr")), frame(spark, d, "cache"))
    return out.select("id", "geo_base", "cached.lat", "cached.lng", "cached.level", "cached.source")


_LEVELS = """CASE WHEN c_lat IS NOT NULL THEN c_level WHEN e_lat IS NOT NULL OR l_lat IS NOT NULL THEN 'exact' WHEN r_lat IS NOT NULL THEN 'road' END"""


def _geocoded(spark, d, **kw):
    points = frame(spark, d, "points")
    return geo.geocode(frame(spark, d, "tx_addr"), points, frame(spark, d, "cache"), geo.road_centres(points), **kw)


@query(
    "j5_geocode",
    f"""SELECT id, round(coalesce(c_lat, e_lat, l_lat, r_lat), 6) AS lat, round(coalesce(c_lng, e_lng, l_lng, r_lng), 6) AS lng, {_LEVELS} AS level,
    CASE WHEN c_lat IS NOT NULL THEN c_source WHEN e_lat IS NOT NULL OR l_lat IS NOT NULL THEN 'osm_index' WHEN r_lat IS NOT NULL THEN 'road_centre' END AS source FROM located""",
)
def _(spark, d):
    g = _geocoded(spark, d)
    return g.select("id", F.round("geo_lat", 6).alias("lat"), F.round("geo_lng", 6).alias("lng"), "level", "source")


@query(
    "j5_geocode_index_first",
    """SELECT id, round(coalesce(e_lat, l_lat, c_lat, r_lat), 6) AS lat, CASE WHEN coalesce(e_lat, l_lat) IS NOT NULL THEN 'exact' WHEN c_lat IS NOT NULL THEN c_level WHEN r_lat IS NOT NULL THEN 'road' END AS level FROM located""",
)
def _(spark, d):
    g = _geocoded(spark, d, precedence=("index", "cache", "road"))
    return g.select("id", F.round("geo_lat", 6).alias("lat"), "level")


@query(
    "a24_geocode_levels",
    f"SELECT level, rows, round(rows / sum(rows) OVER () * 100, 1) AS pct FROM (SELECT coalesce({_LEVELS}, 'none') AS level, count(*) AS rows FROM located GROUP BY 1) x",
)
def _(spark, d):
    return geo.level_counts(_geocoded(spark, d))


CTES["leveled"] = "SELECT id, CASE WHEN id % 3 = 0 THEN 'road' WHEN id % 3 = 1 THEN 'exact' END AS old_level FROM tx_addr"


def _leveled(spark, d):
    return frame(spark, d, "tx_addr").select(
        "id", "district", "address", "lat", "lng",
        F.expr("CASE WHEN id % 3 = 0 THEN 'road' WHEN id % 3 = 1 THEN 'exact' END").alias("geocode_level"),
    )


@query(
    "j7_upgrade_roads",
    """SELECT t.id, CASE WHEN o.old_level = 'road' AND coalesce(e_lat, l_lat) IS NOT NULL THEN 'exact' ELSE o.old_level END AS geocode_level,
    CASE WHEN o.old_level = 'road' THEN coalesce(e_lat, l_lat, t.lat) ELSE t.lat END AS lat FROM tx_addr t JOIN leveled o ON o.id = t.id JOIN located l ON l.id = t.id""",
)
def _(spark, d):
    return geo.upgrade_roads(_leveled(spark, d), frame(spark, d, "points")).select("id", "geocode_level", "lat")


@query(
    "j7_upgrade_count",
    "SELECT count(*) AS rows, count(coalesce(e_lat, l_lat)) AS upgradable FROM located JOIN leveled ON leveled.id = located.id WHERE old_level = 'road'",
)
def _(spark, d):
    return geo.upgrade_count(_leveled(spark, d), frame(spark, d, "points"))


@query(
    "j13_community_coords",
    "SELECT t.id, round(c.avg_lat, 6) AS name_lat, round(c.avg_lng, 6) AS name_lng FROM tx_addr t LEFT JOIN centroids c ON c.community_name = t.community_name",
)
def _(spark, d):
    tx = frame(spark, d, "tx_addr")
    out = R.with_name_coords(tx, Q.community_centroids(tx))
    return out.select("id", F.round("name_lat", 6).alias("name_lat"), F.round("name_lng", 6).alias("name_lng"))


def _address_keys(spark, d):
    """Geocoding keys of the distinct addresses, written so that no condition on a key is evaluated for every row."""
    return geo.with_geo_keys(stage(frame(spark, d, "tx_addr").select("district", "address").distinct(), "addresses"))


@query("u4_uncovered", "SELECT DISTINCT geo_base FROM located WHERE c_lat IS NULL AND e_lat IS NULL AND l_lat IS NULL")
def _(spark, d):
    return geo.uncovered(_address_keys(spark, d), frame(spark, d, "cache"), frame(spark, d, "points")).select("geo_base")


@query(
    "a16_road_groups",
    f"""SELECT {_GEO_ROAD} AS road_key, count(DISTINCT l.geo_base) AS addresses FROM tx_addr t JOIN located l ON l.id = t.id
    WHERE c_lat IS NULL AND e_lat IS NULL AND l_lat IS NULL GROUP BY 1""",
)
def _(spark, d):
    return geo.road_groups(geo.uncovered(_address_keys(spark, d), frame(spark, d, "cache"), frame(spark, d, "points")))


@query(
    "u6_merge_caches",
    "SELECT address_key, coalesce(max(CASE WHEN source = 'api' THEN 'api' END), 'osm_index') AS source FROM (SELECT address_key, source FROM cache UNION ALL SELECT address_key, 'api' FROM cache WHERE level = 'road') x GROUP BY address_key",
)
def _(spark, d):
    c = frame(spark, d, "cache")
    newer = c.where("level = 'road'").withColumn("source", F.lit("api"))
    return geo.merge_cache(c, newer).select("address_key", "source")


@query("w6_first_original", "SELECT geo_base, arg_min(address, id) AS address FROM located GROUP BY geo_base")
def _(spark, d):
    keyed = geo.with_geo_keys(frame(spark, d, "tx_addr"))
    return keyed.groupBy("geo_base").agg(F.min_by("address", "id").alias("address"))


@query("j17_geocode_bare", "SELECT id, concat(replace(CASE district WHEN '中正區' THEN '台北市' ELSE county_city END, '台', '臺')) AS city FROM tx_addr")
def _(spark, d):
    # Addresses without their city; the district's city comes from the gazetteer.
    tx = frame(spark, d, "tx_addr")
    bare = tx.select("id", "district", F.expr("substr(address, length(county_city) + 1)").alias("address"))
    gaz = G.derive_gazetteer(tx)
    merged = gaz.withColumn("cities", F.when(F.col("district") == "中正區", F.array(F.lit("台北市"))).otherwise(F.col("cities")))
    keyed = geo.with_geo_keys(bare, gazetteer=merged)
    return keyed.select("id", F.substring("geo_base", 1, 3).alias("city"))


@query("f11_points_in_territory", "SELECT point_id FROM points WHERE lat > 20 AND lat < 27 AND lng > 118 AND lng < 123")
def _(spark, d):
    return frame(spark, d, "points").where(P.in_territory("lat", "lng")).select("point_id")
