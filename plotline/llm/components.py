"""Connected components of an edge table, without collecting a vertex's neighbours anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotline.session import stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every vertex of ``edges``; the label is the component's smallest vertex.

    Alternates large-star and small-star steps: each hands a vertex's neighbours to the smallest one.  The smallest
    neighbour is a map-side combined minimum that is joined back, so a vertex with very many edges is an ordinary
    skewed join, and the number of rounds follows the logarithm of the longest path.  Every round is written to
    the shared folder, which cuts the lineage.
    """
    links = stage(_forward(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    last = None
    while True:
        links = stage(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.unionByName(roots)


def _forward(links: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller vertex."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    moved = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _forward(moved)


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = links.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _forward(moved.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))))
