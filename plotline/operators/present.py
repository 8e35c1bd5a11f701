"""Projections for search results: aliases, computed columns, display rows, sort orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotline import constants as K
from plotline.functions import address as A, dates as D, money as M
from plotline.functions.text import blank
from plotline.functions.values import scrub
from plotline.operators.filters import is_special
from plotline.operators.stats import join_back, with_count

_RENAMED = {
    "building_area": "building_area_sqm", "main_area": "main_building_area",
    "build_date": "completion_date", "parking_area": "parking_area_sqm",
}
_SEARCH = (
    "id district address transaction_date total_price unit_price building_area main_area "
    "attached_area balcony_area rooms halls bathrooms floor_level total_floors building_type "
    "main_use main_material build_date elevator has_management parking_type parking_price "
    "parking_area note lat lng community_name"
).split()


def search_columns(tx: DataFrame) -> DataFrame:
    """The columns a search returns, under their public names."""
    return tx.select(*[F.col(c).alias(_RENAMED.get(c, c)) for c in _SEARCH if c in tx.columns])


def with_computed(tx: DataFrame) -> DataFrame:
    """ping, public_ratio, unit_price_per_ping (萬) and roc_year, each NULL where undefined."""
    area, price = F.col("building_area"), F.col("total_price")
    return tx.withColumns(
        {
            "ping": F.when(area > 0, M.rounded(area / K.PING_SQM, 1)),
            "public_ratio": M.public_ratio_computed(
                "building_area", "main_area", "attached_area", "balcony_area"
            ),
            "unit_price_per_ping": F.when(
                (area > 0) & (price > 0), M.rounded(price / 10000.0 / (area / K.PING_SQM), 1)
            ),
            "roc_year": D.roc_year_computed("transaction_date"),
        }
    )


def _has_coords(lat: Column, lng: Column) -> Column:
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


def choose_coords(df: DataFrame, mode: str) -> DataFrame:
    """Replace lat/lng by the mode's choice and name its source.

    Expects the looked-up columns ``point_lat/point_lng`` (mode osm) and
    ``name_lat/name_lng`` (mode db); missing ones count as not found.
    """
    has = lambda n: n in df.columns
    point = F.col("point_lat").isNotNull() if has("point_lat") else F.lit(False)
    named = F.col("name_lat").isNotNull() if has("name_lat") else F.lit(False)
    stored = _has_coords(F.col("lat"), F.col("lng"))
    if mode == "osm":
        source = F.when(point, "osm").when(stored, "db").otherwise("none")
    elif mode == "db":
        source = F.when(stored, "db").when(named, "community").otherwise("none")
    else:
        source = F.when(stored, "db").otherwise("none")
    out = df.withColumn("coord_source", source)
    pick = lambda kind: (
        F.when(F.col("coord_source") == "osm", F.col(f"point_{kind}") if has("point_lat") else None)
        .when(F.col("coord_source") == "db", F.col(kind))
        .when(F.col("coord_source") == "community", F.col(f"name_{kind}") if has("name_lat") else None)
    )
    return out.withColumns({"lat": pick("lat"), "lng": pick("lng")}).drop(
        "point_lat", "point_lng", "name_lat", "name_lng"
    )


def display_rows(
    rows: DataFrame, mode: str = "db", normaliser: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The display row of every search result (columns of ``search_columns`` in, 32 fields out)."""
    cols = set(rows.columns)
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in cols else F.lit("")
    num = lambda n, kind="double": (
        F.coalesce(F.col(n).cast(kind), F.lit(0).cast(kind)) if n in cols else F.lit(0).cast(kind)
    )
    area, unit, main = num("building_area_sqm"), num("unit_price"), num("main_building_area")
    shown = text("address") if normaliser is None else normaliser(text("address"))
    placed = choose_coords(rows, mode)
    return placed.select(
        "id",
        A.strip_city_shown(shown).alias("address"),
        text("address").alias("address_raw"),
        text("district").alias("district"),
        F.coalesce(D.gregorian_text(text("transaction_date")), text("transaction_date")).alias("date"),
        text("transaction_date").alias("date_raw"),
        num("total_price", "long").alias("price"),
        M.rounded(unit, 2).alias("unit_price_sqm"),
        M.price_per_ping(unit).alias("unit_price_ping"),
        M.rounded(area, 2).alias("area_sqm"),
        M.ping(area).alias("area_ping"),
        M.rounded(main, 2).alias("main_area_sqm"),
        M.public_ratio_shown(area, main, num("attached_area"), num("balcony_area")).alias("public_ratio"),
        text("floor_level").alias("floor"),
        text("total_floors").alias("total_floors"),
        num("rooms", "int").alias("rooms"),
        num("halls", "int").alias("halls"),
        num("bathrooms", "int").alias("baths"),
        text("building_type").alias("building_type"),
        text("main_use").alias("main_use"),
        text("main_material").alias("main_material"),
        text("completion_date").alias("completion_date"),
        text("elevator").alias("has_elevator"),
        text("has_management").alias("has_management"),
        text("parking_type").alias("parking_type"),
        num("parking_price", "long").alias("parking_price"),
        num("parking_area_sqm").alias("parking_area_sqm"),
        text("note").alias("note"),
        text("community_name").alias("community_name"),
        is_special(text("note")).alias("is_special"),
        (~text("parking_type").isin("", "無")).alias("has_parking"),
        "lat",
        "lng",
        "coord_source",
    )


def with_name_coords(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``name_lat/name_lng``: mean coordinates of the row's building project."""
    c = centroids.select(
        "community_name", F.col("avg_lat").alias("name_lat"), F.col("avg_lng").alias("name_lng")
    )
    return join_back(rows, c, ["community_name"])


def clean_address(limit: int = 35) -> Column:
    """Address put together from its parts; without a street the first characters of the raw text."""
    part = lambda n, tail, head="": F.when(
        ~blank(n), F.concat(F.lit(head), F.col(n), F.lit(tail))
    ).otherwise("")
    built = F.concat(
        F.col("street"), part("lane", "巷"), part("alley", "弄"), part("number", "號"),
        part("floor", "F"), part("sub_number", "", "之"),
    )
    raw = F.replace(A.half_width(F.coalesce("address", F.lit(""))), F.lit("臺"), F.lit("台"))
    return F.when(~blank("street"), built).otherwise(F.substring(raw, 1, limit))


def scrub_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of every DOUBLE column to 0."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: scrub(n) for n in doubles}) if doubles else df


# --- orders ---------------------------------------------------------------
def result_order(sort_by: str = "date", by_text: bool = False) -> list[Column]:
    """The six result orders, each ending in ``id``.  ``by_text`` compares dates as plain text."""
    date = F.col("transaction_date") if by_text else D.sort_key("transaction_date")
    newest = [date.desc_nulls_last(), F.col("id").desc()]
    heads = {
        "date": [],
        "price": [F.col("total_price").desc_nulls_last()],
        "count": [F.col("addr_count").desc_nulls_last()],
        "unit_price": [F.col("unit_price_per_ping").desc_nulls_last()],
        "ping": [F.col("ping").desc_nulls_last()],
        "public_ratio": [F.col("public_ratio").asc_nulls_last()],
    }
    return heads.get(sort_by, []) + newest


def list_order(sort_by: str, direction: str = "desc") -> list[Column]:
    """Orders of a list of display rows.

    ``asc`` is a list's natural direction (newest, dearest, largest, lowest ratio, names in order
    first) and ``desc`` its reverse; an unknown ratio (0) counts as 999.
    """
    natural = direction == "asc"
    down = lambda c: c.desc() if natural else c.asc()
    up = lambda c: c.asc() if natural else c.desc()
    ratio = F.when(F.coalesce("public_ratio", F.lit(0.0)) == 0, 999.0).otherwise(F.col("public_ratio"))
    date = D.sort_key("date_raw")
    keys = {
        "date": [down(date)],
        "price": [down(F.col("price"))],
        "unit_price": [down(F.col("unit_price_ping"))],
        "ping": [down(F.col("area_ping"))],
        "public_ratio": [up(ratio)],
        "community": [
            F.when(blank("community_name"), 1).otherwise(0).asc(), up(F.col("community_name")), down(date),
        ],
    }
    return keys[sort_by] + [F.col("id").asc()]


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    out = df.orderBy(*result_order("date"))
    return out if limit is None else out.limit(limit)


def with_address_count(df: DataFrame) -> DataFrame:
    """``addr_count``: rows that share the address, before any filter."""
    return with_count(df, ["address"], "addr_count")
