"""Incremental import as Structured Streaming over landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plotline.functions import dates as D
from plotline.functions.text import blank
from plotline.operators.filters import reject_reason
from plotline.operators.ingest import with_dedup_key
from plotline.sources.writers import upsert_transactions


def read_landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_rows(stream: DataFrame, key: str = "sq", event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Insert-or-ignore on a unique id.  With an event time the state is kept for ``delay`` only."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Read everything that is there, append it, stop; a rerun goes on where this one ended."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, rank: int = 1) -> StreamingQuery:
    """Merge each micro-batch of canonical rows into the stored table.

    The state is the table itself, so it survives lost executors and restarts; a batch that is run
    twice leaves the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(reject_reason("address").isNull())
        keyed = rows if "dedup_key" in rows.columns else with_dedup_key(rows)
        ranked = keyed.withColumn("source_rank", F.lit(rank))
        upsert_transactions(batch.sparkSession, ranked, path)

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def monthly_trend(stream: DataFrame) -> DataFrame:
    """Trend buckets by month label, for ``complete`` mode."""
    rows = stream.where((F.col("total_price") > 0) & ~blank("transaction_date"))
    return rows.groupBy(D.period_label("transaction_date").alias("label")).agg(
        F.count("*").alias("count"),
        F.round(F.avg("total_price"), 0).cast("long").alias("avg_price"),
        F.min("total_price").alias("min_price"),
        F.max("total_price").alias("max_price"),
    )


def daily_trend(stream: DataFrame, event_time: str = "tx_time", delay: str = "7 days") -> DataFrame:
    """Append-only daily buckets behind a watermark; sums roll up to months downstream."""
    return (
        stream.withWatermark(event_time, delay).where("total_price > 0")
        .groupBy(F.window(event_time, "1 day"))
        .agg(
            F.count("*").alias("count"), F.sum("total_price").alias("sum_price"),
            F.min("total_price").alias("min_price"), F.max("total_price").alias("max_price"),
        )
        .select(F.col("window.start").alias("day"), "count", "sum_price", "min_price", "max_price")
    )


def roll_up_months(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("count").alias("count"),
        F.round(F.sum("sum_price") / F.sum("count"), 0).cast("long").alias("avg_price"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
    )


def table_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the current state of a complete-mode aggregate as a small table."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progress(rows: DataFrame) -> DataFrame:
    """Rows fetched per city and month."""
    return rows.groupBy(
        F.col("city"), F.regexp_replace(F.substring_index("date_str", "/", 2), "/", "-").alias("period")
    ).agg(F.count("*").alias("count"))
