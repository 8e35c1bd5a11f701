"""Bounded training samples and the fixed folds of the labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline.session import stage

SALTS = 64


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether ``crc32`` of the id as text falls into ``part`` of ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def bounded(rows: DataFrame, group: str, n: int) -> DataFrame:
    """At most ``n`` values of ``doc_id`` for each ``group``, as ``(doc_id, group)``, chosen by a hash of the id.

    ``rows`` need no text.  The ids of each group are counted first, by a sketch that merges and does not count repeated
    rows; only ids whose hash lies in a share that holds about twice ``n`` are ranked, so what is ranked does not grow with
    the input.  The counts are a written table, a row per group: Spark's own size check decides whether they are
    broadcast, and ``rows`` then stay in place; a join of larger counts is dealt over ``SALTS`` parts of each group.
    Rows without ``doc_id`` or group are left out; an id that occurs in two groups can be chosen in both.
    """
    known = F.col("doc_id").isNotNull() & F.col("__g").isNotNull()
    rows = stage(rows.select("doc_id", F.col(group).alias("__g")).where(known), "group_ids")
    counts = stage(rows.groupBy("__g").agg(F.approx_count_distinct("doc_id").alias("__n")), "group_counts")
    counts = counts.select(F.col("__g").alias("__c"), "__n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.withColumns({"__h": share, "__salt": F.pmod(F.hash("doc_id"), F.lit(SALTS))})
    near = near.join(counts, (F.col("__g") == F.col("__c")) & (F.col("__salt") == F.col("__part")))
    near = near.where(F.col("__h") * F.col("__n") <= 2.0 * n).groupBy("doc_id", "__h", "__g").agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "doc_id"))
    return near.withColumn("__r", rank).where(F.col("__r") <= n).select("doc_id", F.col("__g").alias(group))


def texts_of(docs: DataFrame, ids: DataFrame, most: int | None) -> DataFrame:
    """``ids`` with one text of each document that has one; at most ``most`` rows of them, or all, a written table, for None."""
    ids = ids if most is None else F.broadcast(ids.limit(most))
    ids = ids.withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").where("text is not null").join(ids, F.col("doc_id") == F.col("__id")).drop("__id")
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id", *others).agg(F.min("text").alias("text"))
