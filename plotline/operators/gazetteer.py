"""District-to-city dimension: given as a table, or derived from the transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotline import constants as K
from plotline.functions import address as A
from plotline.functions.text import blank
from plotline.sources.order import ingest_sequence


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """``district,city`` CSV (first city of a district first) to (district, cities in the order of the file)."""
    rows = ingest_sequence(spark.read.schema("district string, city string").option("header", True).csv(path))
    once = rows.groupBy("district", "city").agg(F.min("ingest_seq").alias("at"))
    placed = F.sort_array(F.collect_list(F.struct("at", "city")))
    return once.groupBy("district").agg(F.transform(placed, lambda x: x["city"]).alias("cities"))


def shared_districts(spark: SparkSession) -> DataFrame:
    """The closed list of district names used by several cities."""
    return spark.createDataFrame(list(K.SHARED_DISTRICTS.items()), "district string, cities array<string>")


def derive_gazetteer(tx: DataFrame, city: str = "county_city", district: str = "district") -> DataFrame:
    """(district, cities) seen in addresses that name their city, most traded city first.

    The pair counts combine before the shuffle; the result has one row per
    administrative district, whatever the number of transactions.
    """
    pairs = (
        tx.where(~blank(city) & ~blank(district))
        .groupBy(F.col(district).alias("district"), A.rename_city(F.col(city)).alias("city"))
        .agg(F.count("*").alias("n"))
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "city")))
    return pairs.groupBy("district").agg(F.transform(ranked, lambda x: x["city"]).alias("cities"))


def resolve_city(
    df: DataFrame,
    gazetteer: DataFrame | None,
    district: str = "district",
    city: str = "county_city",
    hint: Column | None = None,
) -> DataFrame:
    """Fill a blank city from the district: the hint if it is a candidate, else the first candidate.

    The closed list decides for shared names; the gazetteer (left join, one row
    per district) decides for the rest.
    """
    closed = A.city_of_shared_district(F.col(district), hint)
    if gazetteer is None:
        return df.withColumn(city, F.when(blank(city), closed).otherwise(F.col(city)))
    g = gazetteer.select(F.col("district").alias("__d"), F.col("cities").alias("__cities"))
    h = F.replace(F.coalesce(hint if hint is not None else F.lit(""), F.lit("")), F.lit("臺"), F.lit("台"))
    listed = F.coalesce(
        F.nullif(closed, F.lit("")),
        F.when(F.array_contains("__cities", h), h),
        F.get("__cities", F.lit(0)),
        F.lit(""),
    )
    return (
        df.join(g, F.col(district) == F.col("__d"), "left")
        .withColumn(city, F.when(blank(city), listed).otherwise(F.col(city)))
        .drop("__d", "__cities")
    )


def city_of_district(df: DataFrame, gazetteer: DataFrame, district: str, out: str) -> DataFrame:
    """City by exact district name, else by the name without its 區/鎮/鄉/市 (smallest match)."""
    stem = lambda c: F.regexp_replace(c, "[區鎮鄉市]+$", "")
    g = gazetteer.select(F.col("district").alias("__d"), F.get("cities", F.lit(0)).alias("__c"))
    by_stem = g.groupBy(stem(F.col("__d")).alias("__s")).agg(F.min_by("__c", "__d").alias("__c2"))
    return (
        df.join(g, F.col(district) == F.col("__d"), "left")
        .join(by_stem, stem(F.col(district)) == F.col("__s"), "left")
        .withColumn(out, F.coalesce("__c", "__c2"))
        .drop("__d", "__c", "__s", "__c2")
    )
