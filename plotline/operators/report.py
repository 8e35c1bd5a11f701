"""Aggregates: summaries, trends, map groups, profiles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline.functions import address as A, dates as D, money as M
from plotline.functions.text import blank
from plotline.operators import filters as P
from plotline.operators.stats import fixed_avg, join_back, positive_avg, top_per, upper_median, upper_medians, whole_avg


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def _zero(c: Column, kind: str = "double") -> Column:
    return F.coalesce(c, F.lit(0).cast(kind))


# --- summaries of display rows -------------------------------------------
def summary(rows: DataFrame) -> DataFrame:
    """One row over a result set of display rows."""
    return rows.agg(
        F.count("*").alias("total"),
        whole_avg(F.col("price")).alias("avg_price"),
        _zero(F.min(_positive("price")), "long").alias("min_price"),
        _zero(F.max(_positive("price")), "long").alias("max_price"),
        fixed_avg(F.col("area_ping"), 2, 2).alias("avg_ping"),
        fixed_avg(F.col("unit_price_ping"), 2, 2).alias("avg_unit_price_ping"),
        M.rounded(_zero(F.min(_positive("unit_price_ping"))), 2).alias("min_unit_price_ping"),
        M.rounded(_zero(F.max(_positive("unit_price_ping"))), 2).alias("max_unit_price_ping"),
        fixed_avg(F.col("public_ratio"), 1, 1).alias("avg_ratio"),
    )


def community_summaries(rows: DataFrame, rounded: bool = True) -> DataFrame:
    """Per building project over display rows; blank names are left out."""
    r = lambda c, stored, n: fixed_avg(F.col(c), stored, n if rounded else None)
    return (
        rows.where(~blank("community_name"))
        .groupBy("community_name")
        .agg(
            F.count("*").alias("count"),
            whole_avg(F.col("price")).alias("avg_price"),
            r("unit_price_ping", 2, 2).alias("avg_unit_price_ping"),
            r("area_ping", 2, 1).alias("avg_ping"),
            r("public_ratio", 1, 1).alias("avg_ratio"),
        )
    )


def spread(tx: DataFrame) -> DataFrame:
    """Average, upper median and extremes of price and unit price; extremes of area and ratio.

    Expects the computed columns of ``present.with_computed``.
    """
    used = tx.select(
        _positive("total_price").alias("price"),
        F.when(F.col("unit_price_per_ping") != 0, F.col("unit_price_per_ping")).alias("unit"),
        F.when(F.col("ping") != 0, F.col("ping")).alias("ping"),
        _positive("public_ratio").alias("ratio"),
    )
    base = used.agg(
        F.count("*").alias("total"),
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        fixed_avg(F.col("unit"), 1, 1).alias("avg_unit"), F.min("unit").alias("min_unit"), F.max("unit").alias("max_unit"),
        fixed_avg(F.col("ping"), 1, 1).alias("avg_ping"), F.min("ping").alias("min_ping"), F.max("ping").alias("max_ping"),
        fixed_avg(F.col("ratio"), 1, 1).alias("avg_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
    )
    mid = upper_medians(used, [], {"median_price": F.col("price"), "median_unit": F.col("unit")})
    mid = mid.withColumn("median_price", F.col("median_price").cast("long"))
    both = base.unionByName(mid, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- trend ----------------------------------------------------------------
def price_trend(
    tx: DataFrame, period: str = "monthly", months_back: int | None = None, as_of: str | None = None
) -> DataFrame:
    """Per period: count, average, upper median and extremes of price, average unit price.

    ``as_of`` (calendar text) with ``months_back`` keeps only the periods up to that many
    months before it.  Ordered by time; unreadable dates come last under 未知.
    """
    rows = tx.where((F.col("total_price") > 0) & (F.length(F.trim("transaction_date")) >= 5)).select(
        D.period_label("transaction_date", period).alias("label"),
        D.period_index("transaction_date").alias("month"),
        "total_price",
        "unit_price",
    )
    if months_back is not None and as_of is not None:
        last = D.period_index(F.lit(as_of))
        rows = rows.where((F.col("month") > last - months_back) & (F.col("month") <= last))
    base = rows.groupBy("label").agg(
        F.count("*").alias("count"),
        F.round(F.avg("total_price"), 0).cast("long").alias("avg_price"),
        F.min("total_price").alias("min_price"),
        F.max("total_price").alias("max_price"),
        whole_avg(F.col("unit_price")).alias("avg_unit_price"),
        F.min("month").alias("__at"),
    )
    mid = upper_median(rows, ["label"], "total_price", "median_price")
    out = join_back(base, mid, ["label"])
    return out.orderBy(F.col("__at").asc_nulls_last(), "label").select(
        "label", "count", "avg_price", "median_price", "min_price", "max_price", "avg_unit_price"
    )


# --- building projects ----------------------------------------------------
def community_centroids(tx: DataFrame) -> DataFrame:
    ok = ~blank("community_name") & (F.col("lat") != 0) & (F.col("lng") != 0)
    return tx.where(ok).groupBy("community_name").agg(
        F.avg("lat").alias("avg_lat"), F.avg("lng").alias("avg_lng")
    )


def catalogue(tx: DataFrame) -> DataFrame:
    """Per building project: trades, average price and unit price, most frequent district."""
    named = tx.where(~blank("community_name"))
    # Two steps, so that the district vote never holds more than one row per district.
    by_district = named.groupBy("community_name", "district").agg(
        F.count("*").alias("n"),
        F.sum("total_price").alias("p"), F.count("total_price").alias("pn"),
        F.sum("unit_price").alias("u"), F.count("unit_price").alias("un"),
    )
    vote = F.max_by("district", F.struct(F.col("n"), F.coalesce("district", F.lit("")).alias("d")))
    return by_district.groupBy("community_name").agg(
        F.sum("n").alias("tx_count"),
        F.coalesce(F.round(F.sum("p") / F.nullif(F.sum("pn"), F.lit(0)), 0), F.lit(0.0)).alias("avg_price"),
        F.coalesce(M.rounded(F.sum("u") / F.nullif(F.sum("un"), F.lit(0)), 2), F.lit(0.0)).alias("avg_unit_price"),
        F.coalesce(vote, F.lit("")).alias("district"),
    )


def community_counts(tx: DataFrame) -> DataFrame:
    """Rows with a building project, and how many distinct ones."""
    return tx.where(~blank("community_name")).agg(
        F.count("*").alias("total_records"), F.countDistinct("community_name").alias("unique_communities")
    )


# --- coverage -------------------------------------------------------------
def coverage(tx: DataFrame) -> DataFrame:
    """Rows and the share with city, street, coordinates and building project."""
    has = {
        "city": ~blank("county_city"),
        "street": ~blank("street"),
        "geo": F.coalesce(F.col("lat") != 0, F.lit(False)),
        "community": ~blank("community_name"),
    }
    share = lambda c: F.coalesce(M.rounded(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)) * 100, 1), F.lit(0.0))
    cols = [F.count("*").alias("total")]
    for n, c in has.items():
        cols += [F.count_if(c).alias(f"has_{n}"), share(c).alias(f"{n}_pct")]
    return tx.agg(*cols)


def duplicate_keys(tx: DataFrame, limit: int = 20) -> DataFrame:
    """Keys held by more than one row, most frequent first."""
    return (
        tx.where(F.col("dedup_key").isNotNull()).groupBy("dedup_key").agg(F.count("*").alias("cnt"))
        .where("cnt > 1").orderBy(F.desc("cnt"), "dedup_key").limit(limit)
    )


def address_stats(tx: DataFrame) -> DataFrame:
    """The per-address statistics table."""
    return tx.groupBy("address").agg(
        F.count("*").alias("tx_count"),
        F.avg("total_price").alias("avg_price"),
        F.min("total_price").alias("min_price"),
        F.max("total_price").alias("max_price"),
        F.avg("building_area").alias("avg_area"),
        F.countDistinct("district").alias("district_count"),
    )


# --- map ------------------------------------------------------------------
def map_rows(rows: DataFrame, show_lots: bool = False) -> DataFrame:
    """Display rows that can be placed on the map, with their marker key and label."""
    ok = F.coalesce((F.col("lat") != 0) & (F.col("lng") != 0), F.lit(False))
    placed = rows.where(ok if show_lots else ok & ~P.is_lot("address_raw"))
    named = ~blank("community_name")
    base = A.map_base(F.coalesce(F.nullif("address_raw", F.lit("")), "address"))
    return placed.withColumns(
        {
            "key": F.when(named, F.concat(F.lit("c:"), "community_name", F.lit("@"), "district"))
            .otherwise(F.concat(F.lit("a:"), base)),
            "label": F.when(named, F.col("community_name")).otherwise(A.map_base("address")),
        }
    )


def map_groups(rows: DataFrame, as_of_roc_year: int) -> DataFrame:
    """Markers: count, middle position, averages, and the same for recent regular trades."""
    m = map_rows(rows).withColumn("recent", P.recent_regular(as_of_roc_year, "note", "date_raw"))
    rec = lambda c: F.when(F.col("recent"), F.col(c))
    base = m.groupBy("key").agg(
        F.min("label").alias("label"),
        F.count("*").alias("count"),
        positive_avg(F.col("price")).alias("avg_price"),
        fixed_avg(F.col("unit_price_ping"), 2).alias("avg_unit_price"),
        F.count_if("recent").alias("recent_count"),
        positive_avg(rec("price")).alias("recent_avg_price"),
        fixed_avg(rec("unit_price_ping"), 2).alias("recent_avg_unit_price"),
    )
    recent_unit = F.when(rec("unit_price_ping") > 0, F.col("unit_price_ping"))
    mid = upper_medians(
        m, ["key"], {"lat": F.col("lat"), "lng": F.col("lng"), "recent_median_unit_price": recent_unit}
    )
    out = join_back(base, mid, ["key"])
    return out.withColumn("recent_median_unit_price", _zero(F.col("recent_median_unit_price")))


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile column and row of a position."""
    n = 2.0**zoom
    x = F.floor((lng + 180.0) / 360.0 * n)
    rad = F.radians(lat)
    y = F.floor((1.0 - F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / 3.141592653589793) / 2.0 * n)
    return x.cast("long"), y.cast("long")


def map_cells(groups: DataFrame, zoom: int) -> DataFrame:
    """Markers rolled up to map cells, averages weighted by their row counts."""
    x, y = tile(F.col("lat"), F.col("lng"), zoom)
    weighted = lambda c: _zero(
        F.sum(F.when(F.col(c) > 0, F.col(c) * F.col("count")))
        / F.sum(F.when(F.col(c) > 0, F.col("count")))
    )
    return groups.groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(
        F.sum("count").alias("total_count"),
        weighted("avg_price").alias("avg_price"),
        weighted("avg_unit_price").alias("avg_unit_price"),
        F.countDistinct(F.nullif("label", F.lit(""))).alias("labels"),
        F.min(F.nullif("label", F.lit(""))).alias("first_label"),
    )


def map_extent(groups: DataFrame) -> DataFrame:
    """Bounding box of the markers."""
    return groups.agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lng").alias("west"), F.max("lng").alias("east"),
    )


def _smallest_two(rows: DataFrame, key: str, col: str) -> DataFrame:
    """Up to two distinct values per key as ``a/b``; never more than two are gathered."""
    vals = rows.where(~blank(col)).select(key, F.col(col).alias("v")).distinct()
    two = top_per(vals, [key], [F.col("v")], 2)
    return two.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("v")), "/").alias(col))


def group_profile(rows: DataFrame, key: str = "key") -> DataFrame:
    """Per marker: years of trade, highest building, two types/materials/uses, area, completion."""
    year = D.display("date_raw")
    y = F.when(F.length("date_raw") >= 7, F.split(year, "/")[0].try_cast("int"))
    floors = F.col("total_floors").try_cast("int")
    out = rows.groupBy(key).agg(
        F.min(y).alias("first_year"),
        F.max(y).alias("last_year"),
        F.coalesce(F.max(F.when(floors > 0, floors)), F.lit(0)).alias("max_floor"),
        F.round(F.avg(_positive("area_ping")), 0).cast("long").alias("avg_ping"),
        F.min(F.nullif("completion_date", F.lit(""))).alias("completion_date"),
    )
    for col in ("building_type", "main_material", "main_use"):
        if col in rows.columns:
            out = join_back(out, _smallest_two(rows, key, col), [key])
    return out


def overlap_list(rows: DataFrame) -> DataFrame:
    """Rows at one place by building project, largest first."""
    name = F.coalesce(F.nullif("community_name", F.lit("")), F.lit("未知建案"))
    return (
        rows.groupBy(name.alias("community_name")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "community_name")
    )


def nested_order(rows: DataFrame) -> DataFrame:
    """Rows under their building project in order of first appearance, unnamed rows last.

    Flat on purpose: a project's rows are never gathered into one value.  Expects ``position``,
    the row's place in the result; adds ``group_first``, the place of the project's first row.
    """
    named = rows.where(~blank("community_name"))
    firsts = named.groupBy("community_name").agg(
        F.min("position").alias("group_first"), F.count("*").alias("group_size")
    )
    return join_back(rows, firsts, ["community_name"]).orderBy(
        F.col("group_first").asc_nulls_last(), "position"
    )


# --- price colours --------------------------------------------------------
def marker_colours(groups: DataFrame, unit=(20, 40, 70), total=(500, 1500, 3000)) -> DataFrame:
    """Hue and band of each marker by unit price and by price (thresholds in 萬)."""
    u, t = F.col("avg_unit_price") / 10000, F.col("avg_price") / 10000
    return groups.select(
        "key",
        M.price_hue(u, unit[0], unit[2]).alias("unit_colour"),
        M.price_hue(t, total[0], total[2]).alias("total_colour"),
        M.price_band(u, *unit).alias("unit_band"),
        M.price_band(t, *total).alias("total_band"),
    )
