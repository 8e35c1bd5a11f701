"""The corpus pipeline: five stages, each one operator over everything its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotline.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from plotline.llm.queries import table, tokenizer_path
from plotline.llm.sampling import held_out
from plotline.shipping import ship
from plotline.session import stage

# Several stages have no SQL form (a trained classifier, tokenised packing).
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it rejects go."""
    ship(spark)
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"), 3, 1)), table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: shared lines stay in their first document only."""
    ship(spark)
    return line_dedup.drop_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return jaccard.keep_first(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: contaminated documents go."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_test_items),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
