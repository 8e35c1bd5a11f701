"""Sinks: canonical table, CSV exports, insert-or-ignore appends, city partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotline.functions import dates as D
from plotline.functions.text import blank
from plotline.operators.ingest import merge_duplicates
from plotline.session import stage
from plotline.sources.snapshots import BUCKET, MONTH, Snapshot, add_files, publish, read, snapshot

# Key buckets of a month in a new table: a batch rewrites those of its keys, not whole months.  Months of many
# gigabytes want as many buckets as files of a reasonable size; small ones want no more files.
BUCKETS = 1


def _month() -> Column:
    """Month of a transaction's date, ``none`` without a calendar month.  A dedup key holds the date, so all
    copies of one transaction share it."""
    d = F.substring(D.compact(F.coalesce("transaction_date", F.lit(""))), 1, 7)
    # The letter keeps the folder name text when Spark infers partition types.
    return F.when(
        d.rlike("^[0-9]{1,3}(0[1-9]|1[0-2])[0-9]{2}$"), F.concat(F.lit("m"), F.substring(d, F.lit(1), F.length(d) - 2))
    ).otherwise("none")


def _bucket(df: DataFrame, buckets: int) -> Column:
    """Bucket of a row's key; rows without one go by their address, so equal rows share a bucket."""
    parts = [c for c in ("dedup_key", "address") if c in df.columns]
    return F.pmod(F.xxhash64(F.coalesce(*parts, F.lit(""))), F.lit(buckets)).cast("int")


def _grouped(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumns({MONTH: _month(), BUCKET: _bucket(df, buckets)})


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows by group; inside a file sorted for address look-ups, so that row groups can be skipped.

    The rebalance lets adaptive execution split a group that holds a large share of the rows and
    put small ones together.
    """
    order = [c for c in ("district", "street", "number") if c in df.columns]
    return df.hint("rebalance", MONTH, BUCKET).sortWithinPartitions(MONTH, BUCKET, *order)


def write_transactions(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The canonical table; a table that is there is replaced by the next version."""
    spark = df.sparkSession
    old = snapshot(spark, path)
    groups = add_files(_laid_out(_grouped(df, buckets)), path)
    publish(spark, path, Snapshot(old.version + 1 if old else 1, buckets, df.schema, groups))


def read_transactions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's newest version, or an older one; ``tx_month`` and ``tx_bucket`` are its folders."""
    snap = snapshot(spark, path, version)
    if snap is None:
        raise FileNotFoundError(f"{path} has no published version")
    return read(spark, path, snap)


def _larger_multiset(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each distinct row as often as the side that holds it more often; counted before the shuffle."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "__new"]
    n = both.groupBy(*cols).agg(F.sum(1 - F.col("__new")).alias("__a"), F.sum("__new").alias("__b"))
    return n.withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest("__a", "__b")))).select(*cols)


def upsert_transactions(spark: SparkSession, batch: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merge a batch into the stored table, rewriting only the groups (month and key bucket) it touches.

    Stored rows precede the batch.  Running the same batch again changes nothing: rows without a
    key count as the same row as far as their whole content occurs equally often.  New files are written beside the
    old ones and become the table in one step; until then, and after a failure, readers find the version before.
    """
    old = snapshot(spark, path)
    if old is None:
        write_transactions(merge_duplicates(batch).drop("source_rank", "ingest_seq"), path, buckets)
        return
    batch = stage(_grouped(batch, old.buckets), "batch")
    # Calendar months by buckets.
    touched = [(r[0], r[1]) for r in batch.select(MONTH, BUCKET).distinct().collect()]
    stored = read(spark, path, old, touched).drop(MONTH, BUCKET)
    batch = batch.drop(MONTH, BUCKET)
    # Stored rows are already merged, one per key; content decides among rows without a key.
    before = stored.withColumns({"source_rank": F.lit(0), "ingest_seq": F.lit("")})
    new = batch.withColumn("source_rank", F.col("source_rank") + 1)
    keyless = F.col("dedup_key").isNull()
    merged = merge_duplicates(
        before.where(~keyless).unionByName(new.where(~keyless), allowMissingColumns=True)
    ).drop("source_rank", "ingest_seq")
    loose = _larger_multiset(
        before.where(keyless).drop("source_rank", "ingest_seq"), new.where(keyless).drop("source_rank", "ingest_seq")
    )
    rows = merged.unionByName(loose)
    groups = add_files(_laid_out(_grouped(rows, old.buckets)), path)
    publish(spark, path, Snapshot(old.version + 1, old.buckets, rows.schema, old.groups | groups))


def export_csv(df: DataFrame, path: str, newest_by: str | None = None, limit: int | None = None) -> None:
    """CSV with a header, newest first, optionally only the first ``limit`` rows."""
    out = df
    if newest_by is not None:
        out = out.orderBy(F.col(newest_by).desc_nulls_last(), *[c for c in df.columns if c != newest_by])
    if limit is not None:
        out = out.limit(limit)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append_new(df: DataFrame, stored: DataFrame | None, keys: list[str], path: str, fmt: str = "parquet") -> None:
    """Insert-or-ignore: one row per key, only keys not stored yet."""
    out = df.dropDuplicates(keys)
    if stored is not None:
        out = out.join(stored.select(*keys).distinct(), keys, "left_anti")
    out.write.mode("append").format(fmt).option("header", True).save(path)


def learned_mappings(found: DataFrame, stored: DataFrame, remark: str = "listing") -> DataFrame:
    """Newly learned (address, project, district) rows not in the manual mapping yet."""
    rows = found.where(~blank("address") & ~blank("community_name")).select(
        "address", "community_name", "district", F.lit(remark).alias("remark")
    ).dropDuplicates(["address", "community_name"])
    return rows.join(stored.select("address", "community_name").distinct(), ["address", "community_name"], "left_anti")


def replace_city_points(points: DataFrame, path: str) -> None:
    """Replace the partitions of the cities in ``points``; other cities stay as they are."""
    laid = points.hint("rebalance", "city").sortWithinPartitions("city", "district", "street", "housenumber")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def progress_of(points: DataFrame) -> DataFrame:
    """Progress row per loaded city."""
    return points.groupBy("city").agg(F.count("*").alias("count")).withColumn("status", F.lit("done"))
