"""Address standardisation of a whole table, and the quality report over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotline.functions import address as A
from plotline.functions import money as M
from plotline.functions.text import blank, strip
from plotline.operators import gazetteer as G

Normaliser = Callable[[Column], Column]


def add_parts(
    df: DataFrame,
    address: str = "address",
    district_col: str | None = None,
    normaliser: Normaliser | None = None,
    known_districts: bool = True,
) -> DataFrame:
    """Add ``normalized`` and the ten parts, in stages so that each step runs once per row.

    ``normaliser`` may be any ``Column -> Column`` callable, a pandas UDF included.
    """
    norm = normaliser or A.normalize
    raw = F.col(address)
    staged = df.withColumn("normalized", norm(strip(F.coalesce(raw, F.lit(""))))).withColumn(
        "__p", A.parts_struct("normalized", known_districts)
    )
    d = F.col(district_col) if district_col else None
    return staged.withColumns(A.part_columns(F.col("__p"), raw, d)).drop("__p")


def standardise(
    df: DataFrame,
    address: str = "address",
    district_col: str | None = None,
    city_hint: Column | None = None,
    gazetteer: DataFrame | None = None,
    date: str | None = None,
    price: str | None = None,
    normaliser: Normaliser | None = None,
) -> DataFrame:
    """Table in, table out: normal form, parts, city, and every derived key."""
    hinted = df if city_hint is None else df.withColumn("__hint", city_hint)
    out = add_parts(hinted, address, district_col, normaliser)
    hint = None if city_hint is None else F.col("__hint")
    out = G.resolve_city(out, gazetteer, hint=hint)
    key_text = F.replace(F.col("normalized"), F.lit(" "), F.lit(""))
    out = out.withColumns(
        {
            "base_address": A.strip_floor(A.strip_city_for_key(key_text)),
            "road_number": A.road_and_number(F.col(address)),
            "__geo": A.geo_normalize(F.col(address)),
        }
    )
    out = out.withColumns(
        {
            "geo_base": A.geo_base("__geo"),
            "road": A.geo_road("__geo"),
            "road_key": A.road_key("__geo"),
            "point_key": A.point_key("__geo"),
        }
    ).drop("__geo", "__hint")
    if date is not None and price is not None:
        out = out.withColumn("dedup_key", A.dedup_key(date, address, price, normal="normalized"))
    return out


def parse_quality(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, and how many have a street, a city, a number, per group."""
    share = lambda c: M.rounded(F.avg(F.when(blank(c), 0.0).otherwise(100.0)), 1)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(~blank("street")).alias("with_street"),
        F.count_if(~blank("county_city")).alias("with_city"),
        F.count_if(~blank("number")).alias("with_number"),
        share("street").alias("street_pct"),
        share("county_city").alias("city_pct"),
    )


def register_sql_functions(spark) -> None:
    """Plain SQL functions over the address text; Spark inlines their bodies into the plan."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION to_ping(area DOUBLE) RETURNS DOUBLE "
        "RETURN round(area / 3.30579D, 2)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION address_after_hash(a STRING) RETURNS STRING "
        "RETURN CASE WHEN contains(a, '#') THEN regexp_replace(a, '^[^#]*#', '') ELSE a END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION house_number_of(a STRING) RETURNS INT "
        "RETURN coalesce(try_cast(regexp_extract(a, '巷([0-9]+)號', 1) AS INT), "
        "try_cast(regexp_extract(a, '([0-9]+)號', 1) AS INT), -1)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION roc_year_of(d STRING) RETURNS INT "
        "RETURN try_cast(left(replace(d, '/', ''), length(replace(d, '/', '')) - 4) AS INT)"
    )


def expand_variants(queries: DataFrame, text: str = "query_text", limit: int | None = None) -> DataFrame:
    """One row per spelling of each search text (the first ``limit`` in sorted order)."""
    v = A.variants(text) if limit is None else F.slice(A.variants(text), 1, limit)
    return queries.withColumn("variant", F.explode(v))
