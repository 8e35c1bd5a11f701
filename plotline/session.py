"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build_session(app: str = "plotline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster values come from the submitter."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory the cluster names.

    Only where that setting is absent *and* the master is local (tests) does a
    temporary folder of this machine take its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="plotline-"))
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage, so that a result used several times is computed once, the plan stays small,
    and a lost executor costs a re-read instead of a re-computation.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
