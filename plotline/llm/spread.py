"""Ranks and look-ups that stay spread out when one key holds a large share of the rows.  DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline.session import stage

# Keys with the most rows whose look-up rows go to every task: a fixed number, whatever the input.
HOT_KEYS = 1000
_ROW_BITS = 33  # row numbers inside a partition, as Spark builds its increasing ids


def equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Null-safe equality of all pairs."""
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs])


def ranked(rows: DataFrame, group: str, order: Sequence[Column], rank: str = "idx", size: str = "n") -> DataFrame:
    """``rows`` (a written table) with the place of each row in its ``group``, from 0, and the group's number of rows.

    ``order`` has to be total, or to leave only rows that may change places.  The rows are dealt by ranges of group and order,
    so a group of any size lies over many tasks; a task numbers its own rows, and the numbers of rows per task
    and group, at most one more than tasks and groups together, give each task's start.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    laid = stage(laid, "ranked")
    part, row = F.shiftright("__id", _ROW_BITS), F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)
    runs = laid.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(F.min(row).alias("__first"), F.count("*").alias("__c"))
    of_group = Window.partitionBy("__g")
    before = F.sum("__c").over(of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(
        "__g", "__p", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(of_group).alias(size)
    )
    out = laid.withColumn("__part", part).join(starts, equal([(F.col(group), F.col("__g")), (F.col("__part"), F.col("__p"))]))
    return out.withColumn(rank, row + F.col("__shift")).drop("__id", "__part", "__g", "__p", "__shift", "__first")


def join_per_key(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` (a written table) joined to ``table``, which has one row per key at most.

    The rows of the ``HOT_KEYS`` most frequent keys stay in place and meet a copy of those keys' table rows, a
    thousand at most; any other key has less than a thousandth of the rows and is shuffled.  NULL keys meet nothing.
    """
    named = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    counts = rows.where(known).groupBy(*[F.col(k).alias(f"__h{k}") for k in keys]).agg(F.count("*").alias("__c"))
    hot = stage(counts.orderBy(F.col("__c").desc()).limit(HOT_KEYS).drop("__c"), "hot_keys")
    on_hot = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__h{k}") for k in keys])
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on_hot, "left").drop(*hot.columns)
    on_table = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__{k}") for k in keys])
    of_hot = named.join(
        F.broadcast(hot), reduce(lambda x, y: x & y, [F.col(f"__{k}") == F.col(f"__h{k}") for k in keys]), "left_semi"
    )
    drop = ["__hot", *[f"__{k}" for k in keys]]
    near = marked.where("__hot").join(F.broadcast(of_hot.limit(HOT_KEYS)), on_table, how).drop(*drop)
    far = marked.where("__hot is null").join(named, on_table, how).drop(*drop)
    return near.unionByName(far)
