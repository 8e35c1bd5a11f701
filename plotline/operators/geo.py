"""Geocoding by joins to address points, a cache and road centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline.functions import address as A
from plotline.functions import money as M
from plotline.functions.text import blank
from plotline.operators import filters as P
from plotline.operators.gazetteer import city_of_district
from plotline.operators.stats import first_per


def clean_points(raw: DataFrame, city_key: str = "") -> DataFrame:
    """Address points from the text columns of a point file; unusable rows are dropped."""
    num = lambda c: F.col(c).try_cast("double")
    rows = raw.select(
        F.coalesce(F.nullif(A.point_city(F.trim("city")), F.lit("")), F.lit(city_key)).alias("city"),
        F.coalesce(F.trim("district"), F.lit("")).alias("district"),
        F.trim("street").alias("street"),
        A.point_number("housenumber").alias("housenumber"),
        num("lat").alias("lat"),
        num("lng").alias("lng"),
    )
    return rows.where(~blank("street") & ~blank("housenumber") & P.in_territory("lat", "lng"))


def _unique(points: DataFrame, keys: list[str]) -> DataFrame:
    """One point per key; the smallest point decides, whatever the arrival order."""
    return points.where(~blank("street") & ~blank("housenumber")).groupBy(*keys).agg(
        F.min(F.struct("point_id", "lat", "lng")).alias("p")
    ).select(*keys, "p.lat", "p.lng")


def with_geo_keys(
    df: DataFrame, address: str = "address", district: str = "district", gazetteer: DataFrame | None = None
) -> DataFrame:
    """Add ``geo_base`` (complete, up to the number), ``road_key`` and the point key parts ``k_*``."""
    out = df.withColumn("__g", A.geo_normalize(F.col(address)))
    if gazetteer is None:
        out = out.withColumn("__city", A.city_of_shared_district(F.col(district)))
    else:
        out = city_of_district(out, gazetteer, district, "__city")
    spelled = A.point_city(F.coalesce("__city", F.lit("")))
    out = out.withColumn("__full", A.geo_complete("__g", F.col(district), spelled))
    out = out.withColumn("geo_base", A.geo_base("__full"))
    out = out.withColumns({"road_key": A.road_key("geo_base"), "__pk": A.point_key("geo_base")})
    return out.withColumns(
        {
            "k_district": F.col("__pk.district"), "k_street": F.col("__pk.street"),
            "k_number": F.col("__pk.housenumber"),
        }
    ).drop("__g", "__city", "__full", "__pk")


def lookup_points(keyed: DataFrame, points: DataFrame) -> DataFrame:
    """Add ``point_lat/point_lng``: by district, street and number, else by street and number."""
    exact = _unique(points, ["district", "street", "housenumber"]).select(
        F.col("district").alias("k_district"), F.col("street").alias("k_street"),
        F.col("housenumber").alias("k_number"), F.struct("lat", "lng").alias("__exact"),
    )
    loose = _unique(points, ["street", "housenumber"]).select(
        F.col("street").alias("k_street"), F.col("housenumber").alias("k_number"),
        F.struct("lat", "lng").alias("__loose"),
    )
    out = keyed.join(exact, ["k_district", "k_street", "k_number"], "left").join(
        loose, ["k_street", "k_number"], "left"
    )
    hit = F.coalesce("__exact", "__loose")
    return out.withColumns({"point_lat": hit["lat"], "point_lng": hit["lng"]}).drop("__exact", "__loose")


def point_road_key(points: DataFrame) -> Column:
    """Road key of an address point, by the same rule as for addresses."""
    full = F.concat(A.point_city("city"), F.coalesce("district", F.lit("")), "street")
    return A.road_key(A.geo_normalize(full))


def road_centres(points: DataFrame) -> DataFrame:
    """(road_key, lat, lng, points): mean position of the points of a road."""
    return (
        points.withColumn("road_key", point_road_key(points)).where(~blank("road_key"))
        .groupBy("road_key").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("points"))
    )


def lookup_cache(keyed: DataFrame, cache: DataFrame, key: str = "geo_base") -> DataFrame:
    """Add the cached position of a key as ``cached`` struct(lat, lng, level, source)."""
    c = first_per(cache.select("address_key", "lat", "lng", "level", "source"), ["address_key"], ["level", "source", "lat", "lng"])
    c = c.select(F.col("address_key").alias("__k"), F.struct("lat", "lng", "level", "source").alias("cached"))
    return keyed.join(c, F.col(key) == F.col("__k"), "left").drop("__k")


def geocode(
    df: DataFrame,
    points: DataFrame,
    cache: DataFrame | None = None,
    roads: DataFrame | None = None,
    address: str = "address",
    district: str = "district",
    gazetteer: DataFrame | None = None,
    precedence: tuple[str, ...] = ("cache", "index", "road"),
) -> DataFrame:
    """Add ``geo_lat, geo_lng, level, source, geo_base``: the first of ``precedence`` that knows the address.

    Every row that shares a base address gets its position.
    """
    out = lookup_points(with_geo_keys(df, address, district, gazetteer), points)
    found = {
        "index": F.when(
            F.col("point_lat").isNotNull(),
            F.struct(F.col("point_lat").alias("lat"), F.col("point_lng").alias("lng"),
                     F.lit("exact").alias("level"), F.lit("osm_index").alias("source")),
        )
    }
    if cache is not None:
        out = lookup_cache(out, cache)
        found["cache"] = F.col("cached")
    if roads is not None:
        r = roads.select(
            "road_key",
            F.struct("lat", "lng", F.lit("road").alias("level"), F.lit("road_centre").alias("source")).alias("__road"),
        )
        out = out.join(r, "road_key", "left")
        found["road"] = F.col("__road")
    pick = F.coalesce(*[found[p] for p in precedence if p in found])
    out = out.withColumn("__hit", pick).withColumns(
        {"geo_lat": F.col("__hit.lat"), "geo_lng": F.col("__hit.lng"),
         "level": F.col("__hit.level"), "source": F.col("__hit.source")}
    )
    return out.drop("__hit", "__road", "cached", "point_lat", "point_lng", "k_district", "k_street", "k_number")


def merge_cache(*parts: DataFrame) -> DataFrame:
    """Key-wise merge of cache tables; a later table wins."""
    every = None
    for i, p in enumerate(parts):
        one = p.withColumn("__rank", F.lit(-i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return first_per(every, ["address_key"], ["__rank", "lat", "lng", "level", "source"]).drop("__rank")


def uncovered(keys: DataFrame, cache: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct base addresses neither cached nor among the points."""
    bases = keys.select("geo_base", "road_key", "k_district", "k_street", "k_number").where(~blank("geo_base")).distinct()
    missing = bases.join(cache.select(F.col("address_key").alias("geo_base")).distinct(), "geo_base", "left_anti")
    return lookup_points(missing, points).where(F.col("point_lat").isNull()).select("geo_base", "road_key")


def road_groups(missing: DataFrame) -> DataFrame:
    """Addresses without a position per road, most first."""
    return (
        missing.where(~blank("road_key")).groupBy("road_key").agg(F.countDistinct("geo_base").alias("addresses"))
        .orderBy(F.desc("addresses"), "road_key")
    )


def road_workload(tx: DataFrame, gazetteer: DataFrame | None = None, district: str | None = None) -> DataFrame:
    """Distinct geocodable addresses per road key, most first."""
    rows = tx.where(P.geocodable("address"))
    if district is not None:
        rows = rows.where(F.col("district") == district)
    keyed = with_geo_keys(rows.select("district", "address").distinct(), gazetteer=gazetteer)
    return (
        keyed.where(~blank("road_key")).groupBy("road_key")
        .agg(F.count("*").alias("addresses"), F.min("district").alias("district"))
        .orderBy(F.desc("addresses"), "road_key")
    )


def write_back(tx: DataFrame, cache: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Rows with ``geocode_level``: a missing position is filled by base address, else by road."""
    todo = P.geocodable("address") & F.col("lat").isNull()
    done = tx.where(~todo).withColumn("geocode_level", F.lit(None).cast("string"))
    keyed = with_geo_keys(tx.where(todo), gazetteer=gazetteer)
    hit = lookup_cache(keyed, cache, "geo_base").withColumnRenamed("cached", "__base")
    hit = lookup_cache(hit, cache, "road_key").withColumnRenamed("cached", "__road")
    level = F.when(F.col("__base").isNotNull(), F.coalesce("__base.level", F.lit("exact"))).when(
        F.col("__road").isNotNull(), "road"
    )
    filled = hit.withColumns(
        {
            "lat": F.coalesce("__base.lat", "__road.lat"),
            "lng": F.coalesce("__base.lng", "__road.lng"),
            "geocode_level": level,
        }
    ).select(*tx.columns, "geocode_level")
    return filled.unionByName(done)


def upgrade_roads(tx: DataFrame, points: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Rows at level road move to their point where the point table has one (level exact)."""
    todo = (F.col("geocode_level") == "road") & F.col("address").contains("號") & ~F.col("address").contains("地號")
    todo = F.coalesce(todo, F.lit(False))
    hit = lookup_points(with_geo_keys(tx.where(todo), gazetteer=gazetteer), points)
    better = F.col("point_lat").isNotNull()
    moved = hit.withColumns(
        {
            "lat": F.coalesce("point_lat", "lat"),
            "lng": F.coalesce("point_lng", "lng"),
            "geocode_level": F.when(better, "exact").otherwise(F.col("geocode_level")),
        }
    ).select(*tx.columns)
    return moved.unionByName(tx.where(~todo))


def upgrade_count(tx: DataFrame, points: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Dry run of ``upgrade_roads``: rows at level road, and how many would move."""
    rows = tx.where((F.col("geocode_level") == "road") & F.col("address").contains("號"))
    hit = lookup_points(with_geo_keys(rows, gazetteer=gazetteer), points)
    return hit.agg(F.count("*").alias("rows"), F.count("point_lat").alias("upgradable"))


# --- reports --------------------------------------------------------------
def geocode_status(tx: DataFrame) -> DataFrame:
    ok = P.geocodable("address")
    return tx.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct(F.when(ok, F.col("address"))).alias("valid_addresses"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("geocoded_rows"),
    )


def district_addresses(tx: DataFrame, limit: int = 20) -> DataFrame:
    rows = tx.where(F.col("address").contains("號") & ~F.col("address").contains("地號"))
    return (
        rows.groupBy("district").agg(F.countDistinct("address").alias("addresses"))
        .orderBy(F.desc("addresses"), "district").limit(limit)
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    """Rows by level, by source and in total, in one pass."""
    return cache.groupingSets([["level"], ["source"], []], "level", "source").agg(F.count("*").alias("rows"))


def city_points(points: DataFrame, limit: int | None = 5) -> DataFrame:
    out = points.groupBy("city").agg(F.count("*").alias("points")).orderBy(F.desc("points"), "city")
    return out if limit is None else out.limit(limit)


def level_counts(geocoded: DataFrame) -> DataFrame:
    """Rows per level with their share of all rows, in percent."""
    per = geocoded.groupBy(F.coalesce("level", F.lit("none")).alias("level")).agg(F.count("*").alias("rows"))
    # A handful of levels, so the total over all of them is no burden.
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return per.select("level", "rows", M.rounded(F.col("rows") / total * 100, 1).alias("pct"))
