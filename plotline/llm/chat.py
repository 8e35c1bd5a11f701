"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, all other
speakers as named users and system turns as they are.  The result has one row per perspective and turn: the
rendered segment, its place in the rendered dialogue and the span the loss applies to (the assistant's own words and
the end mark).  The segments of a perspective in order are its dialogue.

Everything is DataFrame work.  Offsets are running sums in two levels, within blocks of ``BLOCK`` turns and over the
blocks' totals, so that a conversation with very many turns is spread over tasks.

Defined cases: NULL text is an empty turn; a turn without role is rendered as user ``unknown`` and is nobody's
perspective; system is no participant; rows without ``conv_id`` form one conversation; turns of equal number are
ordered by role and text, equal rows follow each other; conversations without participants have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 500
SYSTEM = "system"
END = "<|end|>\n"


def _header(role: Column, own: Column) -> Column:
    name = F.coalesce(role, F.lit("unknown"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))


def rotate(turns: DataFrame) -> DataFrame:
    """``(conv_id, perspective, turn, speaker, segment, segment_start, loss, loss_start, loss_end)`` per perspective and turn."""
    rows = turns.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("__text"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective")).distinct()
    both = rows.join(people, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    both = both.select(
        "conv_id", "perspective", "turn", "speaker", "__text", _header(F.col("speaker"), own).alias("__head"), own.alias("loss"),
        F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).alias("__block"),
    ).withColumn("__size", (F.length("__head") + F.length("__text") + len(END)).cast("long"))
    group = ["conv_id", "perspective", "__block"]
    totals = both.groupBy(*group).agg(F.sum("__size").alias("__total"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"b{c}") for c in group], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group).orderBy("turn", "speaker", "__text").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("bconv_id")) & (F.col("perspective") == F.col("bperspective")) & (F.col("__block") == F.col("b__block"))
    start = F.col("__base") + F.col("__in")
    loss_start = start + F.length("__head")
    return both.join(totals, same).select(
        "conv_id", "perspective", "turn", "speaker", F.concat("__head", "__text", F.lit(END)).alias("segment"), start.alias("segment_start"), "loss",
        F.when(F.col("loss"), loss_start).alias("loss_start"), F.when(F.col("loss"), start + F.col("__size")).alias("loss_end"),
    )
