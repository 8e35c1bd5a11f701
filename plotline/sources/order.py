"""The place of a row in its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ingest_sequence(df: DataFrame) -> DataFrame:
    """``ingest_seq``: a text that sorts as the rows lie, by file, block of the file and row in it.

    Apply it to the scan itself.  A task reads a block from its start to its end, so the task's
    running number orders the rows of one block; blocks are ordered by their offset.  The numbers
    depend on the size of the blocks, their order does not.
    """
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    return df.withColumn("ingest_seq", F.concat_ws(
        "|", "_metadata.file_path", number(F.col("_metadata.file_block_start")),
        number(F.monotonically_increasing_id()),
    ))
