"""Merkle manifest of a text table with a witness for every row, by incremental witnesses.

Every row is a leaf; the leaves of a language, in the order of ``doc_id``, form a tree with eight children a node, and the
languages' roots form the same kind of tree above.  :class:`Frontier` appends digests to a tree from left to right.  It
keeps one open run a level; a run that fills up becomes a node of the next level, and at that moment each subtree in the run
gets what it misses there, its siblings to the left and right.  A witness belongs to a subtree, not to a leaf: a leaf's
witness is read from the subtrees above it, so nothing is copied down while the tree grows.

Distribution: places in the order come from range partitions and their sizes, so no language meets in one task.  Blocks of
``ARITY ** BLOCK_LEVELS`` leaves that are aligned with the tree are appended by one task each; their roots are appends to the next tree, whose
blocks are tasks again, until one node is left.  A witness of a block root continues the witness of every leaf below.
What moves is two digests per row; the texts are hashed where they are read.

Defined cases: NULL fields are ``-`` in a leaf; an empty text is ``0:``; rows without ``doc_id`` come first and are never
tampered with; rows of equal id are ordered by their leaf, and repeated rows are leaves of their own with equal leaves and
witnesses of their own places; rows without ``lang`` form a tree, the first one; an empty table has no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotline.llm.spread import join_per_key, ranked
from plotline.session import stage

ARITY = 8
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Step = tuple[str, str]  # the siblings to the left and to the right, each as one text
_STEPS = "array<struct<left:string,right:string>>"
_PA_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """A tree that grows by appends and knows the witness of every subtree whose run is closed."""

    def __init__(self) -> None:
        self.open: list[list[str]] = [[]]
        self.steps: list[list[Step]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.steps.append([])
        run = self.open[level]
        run.append(node)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        """The open run becomes a node; each of its members gets its siblings."""
        run = self.open[level]
        self.steps[level] += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
        self.open[level] = []
        self.append(digest("".join(run)), level + 1)

    def finish(self, height: int) -> str:
        """Close what is open below ``height`` and return the node there."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._close(level)
        return self.open[height][0]

    def witness(self, leaf: int, height: int) -> list[Step]:
        return [self.steps[level][leaf // ARITY**level] for level in range(height)]


def height_of(n: int) -> int:
    """Levels above ``n`` leaves of a whole tree."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def grow(nodes: Sequence[str], n: int, levels: int) -> tuple[Frontier, int, str]:
    """The tree over one aligned block of ``ARITY ** levels`` of a group with ``n`` nodes, its height and its root.

    A block of several is as high as a full one, however few nodes it has.
    """
    tree = Frontier()
    for d in nodes:
        tree.append(d)
    height = min(levels, height_of(n))
    return tree, height, tree.finish(height)


def fold(leaf: str, witness: Sequence[Step]) -> str:
    """The root that a leaf and a witness lead to."""
    for left, right in witness:
        leaf = digest(left + leaf + right)
    return leaf


def _field(c: str) -> Column:
    v = F.col(c).cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def _leaf(text: Column | None = None) -> Column:
    """SHA-256 of a row's fields; with ``text``, as if that were its text (NULL stays)."""
    parts = [_field(c) for c in FIELDS[:-1]]
    if text is None:
        parts.append(_field("text"))
    else:
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, gid, leaf, shown)`` per row; ``shown`` is the leaf that is checked, altered where ``tampered`` holds."""
    rows = docs.select(*FIELDS)
    # NULL before every language, and languages in the order of their bytes.
    gid = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang")))
    altered = _leaf(F.translate("text", UPPER, LOWER))
    shown = F.lit(None).cast("string") if tampered is None else F.when(tampered, altered)
    return rows.select("doc_id", gid.alias("gid"), _leaf().alias("leaf"), shown.alias("shown")).withColumn("place", F.monotonically_increasing_id())


def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by("idx")


def _block_root(levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        n = t["n"][0].as_py()
        _, _, root = grow(t["digest"].to_pylist(), n, levels)
        return pa.table({"gid": t["gid"][:1], "idx": t["block"][:1], "n": pa.array([-(-n // ARITY**levels)], pa.int64()), "digest": [root]})

    return run


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / ARITY**levels).cast("long"))


def block_roots(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The roots of all blocks of ``nodes`` ``(gid, idx, n, digest)``, as nodes of the next tree."""
    rows = _blocks(nodes.select("gid", "idx", "n", "digest"), levels).groupBy("gid", "block")
    return rows.applyInArrow(_block_root(levels), "gid string, idx long, n long, digest string")


def _continued(levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Witnesses of the nodes of a block: their steps inside it, then those of its root."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = _in_order(nodes)
        tree, height, _ = grow(nodes["digest"].to_pylist(), nodes["n"][0].as_py(), levels)
        rest = [(s["left"], s["right"]) for s in above["witness"][0].as_py()]
        steps = [_as_rows(tree.witness(i, height) + rest) for i in range(len(nodes))]
        return pa.table({"gid": nodes["gid"], "idx": nodes["idx"], "root": pa.array([above["root"][0].as_py()] * len(nodes), pa.string()), "witness": pa.array(steps, _PA_STEPS)})

    return run


def _as_rows(witness: Sequence[Step]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in witness]


def climb(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``(gid, idx, root, witness)`` for written ``nodes`` ``(gid, idx, n, digest)``: one more tree of blocks a round."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("gid", "idx", F.col("digest").alias("root"), F.array().cast(_STEPS).alias("witness"))
    above = climb(stage(block_roots(nodes, levels), "block_roots"), levels).withColumnRenamed("idx", "block")
    below = _blocks(nodes.select("gid", "idx", "n", "digest"), levels)
    out = below.groupBy("gid", "block").cogroup(above.groupBy("gid", "block")).applyInArrow(_continued(levels), f"gid string, idx long, root string, witness {_STEPS}")
    return stage(out, "witnesses")


def _proofs(full: bool, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _in_order(rows)  # never empty: every block root comes from rows
        digests, shown = rows["digest"].to_pylist(), rows["shown"].to_pylist()
        tree, height, _ = grow(digests, rows["n"][0].as_py(), levels)
        rest = [(s["left"], s["right"]) for s in above["witness"][0].as_py()]
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        tail = "".join(a + b for a, b in rest)
        proofs, folded, whole = [], [], []
        for i, (leaf, other) in enumerate(zip(digests, shown, strict=True)):
            steps = tree.witness(i, height)
            proofs.append(digest("".join(a + b for a, b in steps) + tail))
            folded.append(fold(other or leaf, steps + rest))
            if full:
                whole.append(_as_rows(steps + rest))
        n = len(rows)
        out = {
            "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
        return pa.table(out | ({"witness": pa.array(whole, _PA_STEPS)} if full else {}))

    return run


_SCHEMA = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None, full: bool = False, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row its leaf, its tree's root, the root of all, the digest of its witness and the check of the witness.

    Where ``tampered`` holds, the check is made with the leaf of the text in lower case.  ``full`` adds the ``witness``
    itself: per level the siblings to the left and right.  A task appends blocks of ``ARITY ** levels`` leaves.
    """
    rows = stage(leaves(docs, tampered), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("place").asc()]
    rows = stage(ranked(rows, "gid", order).withColumnRenamed("leaf", "digest").drop("place"), "leaf_places")
    trees = stage(climb(stage(block_roots(rows, levels), "block_roots"), levels), "trees")
    subroots = stage(trees.where("idx = 0").select(F.col("gid").alias("name"), F.lit("").alias("gid"), F.col("root").alias("digest")), "subroots")
    tops = stage(ranked(subroots, "gid", [F.col("name").asc()]), "subroot_places")
    over = climb(tops, levels).select("idx", F.col("root").alias("__top"), F.col("witness").alias("__rest"))
    over = over.join(tops.select("idx", "name"), "idx").select(F.col("name").alias("gid"), "__top", "__rest")
    above = join_per_key(trees, over, ["gid"]).select(
        "gid", F.col("idx").alias("block"), F.col("root").alias("subroot"), F.col("__top").alias("root"), F.concat("witness", "__rest").alias("witness")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _SCHEMA.format(kind) + (f", witness {_STEPS}" if full else "")
    return _blocks(rows, levels).groupBy("gid", "block").cogroup(above.groupBy("gid", "block")).applyInArrow(_proofs(full, levels), schema)
