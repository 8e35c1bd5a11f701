"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every 5-word shingle is hashed once; its top bits name a bin, and each bin keeps its smallest hash.  An empty bin
takes the value of the first non-empty bin in an order of its own that is the same for all documents, so two
documents agree in a bin with the probability of their Jaccard similarity ``J``.  Of each bin ``BITS`` low-order
bits of the mixed value are stored; bins agree by chance with ``C = 2^-BITS``, hence ``J = (share - C) / (1 - C)``.

:func:`compare_with_next` fingerprints every text and an edited one in which the end is replaced by the beginning
of the next document.  The documents are dealt once by ranges of ``doc_id``; neighbours meet inside a task, and
only the first and last document of each range travel on.

Defined cases: a text without words (NULL, empty, only space) has the empty fingerprint; two empty fingerprints
are alike (1.0), an empty and another one are not (0.0); fewer than five words are one shingle.  Rows are ordered by
descending ``doc_id`` with NULL last, rows with one ``doc_id`` by a hash of the text; the last row is followed by
the first, a single row by itself.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plotline.llm.textops import buffers, constants, mix, shingles, slices, word_hashes
from plotline.session import stage

BINS = 512
BITS = 4
WIDTH = 5
_CHANCE = 2.0**-BITS


def _orders(bins: int) -> np.ndarray:
    """Per bin the rank of every bin in its own random order."""
    i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    with np.errstate(over="ignore"):
        priority = mix(i * constants(1, seed=6)[0] + mix(j + constants(1, seed=7)[0]))
    return priority.argsort(axis=1).argsort(axis=1).astype(np.uint16)


_ORDERS: dict[int, np.ndarray] = {}


def low_bits(col: pa.Array, bins: int = BINS, width: int = WIDTH) -> list[np.ndarray | None]:
    """Per text the ``BITS`` low-order bits of each bin (``None`` for a text without words)."""
    if bins not in _ORDERS:
        _ORDERS[bins] = _orders(bins)
    orders = _ORDERS[bins]
    raw, offs = buffers(col)
    words, first = word_hashes(raw, offs)
    shift = np.uint64(64 - (bins - 1).bit_length())
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out: list[np.ndarray | None] = []
    for s in shingles(words, first, width):
        if not len(s):
            out.append(None)
            continue
        least = np.full(bins, none)
        np.minimum.at(least, (s >> shift).astype(np.int64), s)
        full = least != none
        if not full.all():
            there, empty = np.flatnonzero(full), np.flatnonzero(~full)
            least[empty] = least[there[orders[np.ix_(empty, there)].argmin(axis=1)]]
        out.append((mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8))
    return out


def packed(bits: np.ndarray | None) -> bytes:
    """Two bins per byte."""
    return b"" if bits is None else (bits[0::2] << 4 | bits[1::2]).tobytes()


def unpacked(text: str) -> np.ndarray | None:
    if not text:
        return None
    raw = np.frombuffer(base64.b64decode(text), np.uint8)
    return np.stack([raw >> 4, raw & 15], axis=1).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement of the stored bits."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.clip(((a == b).mean() - _CHANCE) / (1 - _CHANCE), 0.0, 1.0))


def fingerprint(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """``(doc_id, fingerprint)`` per row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [packed(b) for b in low_bits(batch.column("text"), bins)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")
    return rows.withColumn("fingerprint", F.base64("fingerprint"))


def edited_text(text: str, following: str) -> str:
    """The last ``len // 2`` code points replaced by the first as many of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [c.split()[0] for c in RESULT.split(", ")]


def _rows(ids: list, texts: list[str], prints: list) -> pa.RecordBatch:
    """Results of all texts but the last, each beside the text that follows it."""
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    other = low_bits(pa.array(edited, pa.string())) if edited else []
    own = prints[:-1]
    return pa.record_batch(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([packed(p) for p in own], pa.binary()), pa.array([packed(p) for p in other], pa.binary()),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, prints[1:], strict=True)], pa.float64()),
        ],
        names=_FIELDS,
    )


def _with_edge(batch: pa.RecordBatch, edge: str | None = None, part: int = 0, text: str | None = None) -> pa.RecordBatch:
    n = batch.num_rows
    extra = [pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array([text] * n, pa.string())]
    return pa.record_batch([*batch.columns, *extra], names=[*_FIELDS, "edge", "part", "text"])


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of documents: results of all but its last document, and its first and last as edges."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    prints: list = []
    blank = [None] * (len(_FIELDS) - 1)

    def edge(kind: str, name, text: str) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        cols = [pa.array([name], pa.int64()), *[pa.array([v], k) for v, k in zip(blank, kinds, strict=True)]]
        return _with_edge(pa.record_batch(cols, names=_FIELDS), kind, part, text)

    for batch in slices(batches):
        fresh = [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            yield edge("first", batch.column("doc_id")[0].as_py(), fresh[0])
        ids, texts, prints = ids[-1:] + batch.column("doc_id").to_pylist(), texts[-1:] + fresh, prints[-1:] + low_bits(batch.column("text"))
        yield _with_edge(_rows(ids, texts, prints))
    if ids:
        yield edge("last", ids[-1], texts[-1])


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the documents at the end of a range; ``following`` opens the next range."""
    for batch in batches:
        for name, text, following in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True):
            yield _rows([name, None], [text, following], low_bits(pa.array([text, following], pa.string())))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text in base 64, and their likeness (:data:`RESULT`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = stage(dealt.mapInArrow(_walk, RESULT + ", edge string, part long, text string"), "fingerprints")
    # Ranges are few and numbered in order; each ends where the next one that has rows begins.
    parts = done.where("edge = 'first'").select("part")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1))))
    after = parts.select(F.col("part").alias("p"), after.alias("after"))
    heads = done.where("edge = 'first'").select(F.col("part").alias("h"), F.col("text").alias("following"))
    ends = done.where("edge = 'last'").select("doc_id", "text", "part").join(after, F.col("part") == F.col("p"))
    ends = ends.join(heads, F.col("after") == F.col("h")).select("doc_id", "text", "following")
    out = done.where("edge is null").select(*_FIELDS).unionByName(ends.mapInArrow(_meet, RESULT))
    return out.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
