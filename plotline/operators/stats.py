"""Aggregates that stay spread out when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotline.session import stage

# Relative width of the bracket around the middle, and the sketch's accuracy.
_BRACKET = (0.48, 0.52)
_ACCURACY = 1000
# Ranges of a bracket that are counted at a time.
_BINS = 256
# Up to this rank Spark limits window groups before the shuffle (its default threshold).
_PUSHED_LIMIT = 1000


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of equally named key columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def join_back(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-key results back to the rows, NULL keys included."""
    right = per_key.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in per_key.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"__{k}"]) for k in keys], F.lit(True))
    return df.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact upper median (element ``n div 2`` of the sorted values, NULL and NaN left out) per key.

    A mergeable quantile sketch brackets the middle of each group; its error is far smaller than the bracket, and a
    small group's sketch holds all its values.  A second pass counts what lies below the bracket and how often each value
    inside it occurs.  The value is then selected: ``_BINS`` equal ranges of the bracket are counted, and only the range with the
    middle goes on, until it is one value.  Nothing is ordered but the ranges of a key, so no task sees a whole group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).alias("__v"))
    edges = F.percentile_approx("__v", list(_BRACKET), _ACCURACY)
    bracket = rows.groupBy(*keys).agg(F.expr("count(*) div 2").alias("__skip"), edges.alias("__e"))
    bracket = bracket.select(*keys, "__skip", F.col("__e")[0].alias("__lo"), F.col("__e")[1].alias("__hi"))
    near = join_back(rows, bracket, keys, "inner").where(F.col("__v") <= F.col("__hi"))
    spot = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    hist = stage(near.groupBy(*keys, spot.alias("__v")).agg(F.count("*").alias("__c"), F.first("__skip").alias("__skip")), "middle")
    below = F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))), F.lit(0))
    state = hist.groupBy(*keys).agg((F.first("__skip") - below).alias("__skip"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    done = None
    while True:
        state = stage(state, "median_range")
        found = state.where("not (__lo < __hi) or __lo is null").select(*keys, F.col("__lo").alias(name))
        done = found if done is None else done.unionByName(found)
        if not state.where("__lo < __hi").limit(1).count():
            return done
        state = _middle_range(hist, state.where("__lo < __hi"), keys)


def _middle_range(hist: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the ``_BINS`` ranges between ``__lo`` and ``__hi`` of a key, the one that holds element ``__skip``, and its own ends."""
    inside = join_back(hist.drop("__skip"), state, keys, "inner").where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    # Halves, so that the width of any two numbers is a number.
    place = F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * _BINS)
    bins = inside.groupBy(*keys, "__skip", place.alias("__b")).agg(
        F.sum("__c").alias("__c"), F.min("__v").alias("__from"), F.max("__v").alias("__to")
    )
    each = bins.groupBy(*keys, "__skip").agg(F.array_sort(F.collect_list(F.struct("__b", "__c", "__from", "__to"))).alias("__bins"))
    before = F.transform("__bins", lambda x, i: F.aggregate(F.slice("__bins", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["__c"]))
    each = each.withColumn("__at", F.arrays_zip(F.col("__bins").alias("x"), before.alias("before")))
    here = F.filter("__at", lambda z: (z["before"] <= F.col("__skip")) & (F.col("__skip") < z["before"] + z["x"]["__c"]))[0]
    each = each.withColumn("__h", here)
    return each.select(
        *keys, (F.col("__skip") - F.col("__h.before")).alias("__skip"), F.col("__h.x.__from").alias("__lo"), F.col("__h.x.__to").alias("__hi")
    )


def upper_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Upper medians (DOUBLE) of several measures per key in one go: the measures become groups of one
    long table, so the rows are read twice however many measures there are."""
    measure = lambda n, c: F.struct(F.lit(n).alias("__m"), c.cast("double").alias("__x"))
    long = df.select(*keys, F.inline(F.array(*[measure(n, c) for n, c in values.items()])))
    mid = upper_median(long, [*keys, "__m"], "__x", "__mid")
    return mid.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__m") == n, F.col("__mid"))).alias(n) for n in values]
    )


def with_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows per key beside every row; counted first, so a hot key is one row on the join's other side."""
    return join_back(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key under a total order.

    Spark cuts every task's rows before the shuffle up to its window-limit threshold; beyond, the rows of a key are
    first ranked per input task, so that a hot key reaches its last task with ``n`` rows of each.
    """
    r = rank or "__rank"
    if n > _PUSHED_LIMIT:
        df = df.withColumn("__task", F.spark_partition_id())
        near = F.row_number().over(Window.partitionBy(*keys, "__task").orderBy(*order))
        df = df.withColumn("__near", near).where(F.col("__near") <= n).drop("__near", "__task")
    out = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= n)
    return out if rank else out.drop(r)


def ranked_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """All rows with their place in their key, from 1, under a total order; a key may hold any number of rows.

    The rows are dealt by ranges of keys and order, each task numbers its own, and the numbers of rows per task and key
    (one more than tasks and keys together, at most) give each task's start.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    laid = stage(df, "rows").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    laid = stage(laid, "laid").withColumn("__part", F.shiftright("__id", 33))
    runs = laid.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*keys, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    out = join_back(laid, starts, [*keys, "__part"], "inner")
    return out.withColumn(rank, F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(pick).select(*keys, "__r.*")


def positive_avg(col: Column) -> Column:
    """Average over the values above zero; 0 when there are none."""
    return F.coalesce(F.avg(F.when(col > 0, col)), F.lit(0.0))


def fixed_avg(col: Column, stored: int, digits: int | None = None) -> Column:
    """Positive average of values kept with ``stored`` decimals, optionally rounded; 0 when none.

    Summed as whole numbers, so the answer does not depend on the order of the rows.
    """
    used = F.when(col > 0, F.round(col * 10**stored, 0).cast("long"))
    if digits is None:
        mean = F.sum(used) / (F.count(used) * 10**stored)
    else:
        mean = F.round(F.sum(used) / (F.count(used) * 10 ** (stored - digits)), 0) / 10**digits
    return F.coalesce(F.when(F.count(used) > 0, mean), F.lit(0.0))


def whole_avg(col: Column) -> Column:
    """Average over the values above zero, rounded to a whole number."""
    return F.round(positive_avg(col), 0).cast("long")


def to_json_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold only flat columns."""
    return df.withColumns({n: F.to_json(n) for n in names})
