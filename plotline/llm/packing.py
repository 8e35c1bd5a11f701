"""Packing of tokenised documents into fixed windows by non-negative least squares.

Every task tokenises its documents and packs them in pools of about ``pool_ids`` ids:

1. full windows are cut off; what remains of a document is a length below the window;
2. the remainders' histogram ``h`` is the target: all pairs and triples of present lengths that fill the window
   exactly are the columns of ``A`` (each touches at most three rows), and ``min |A x - h|`` over ``x >= 0`` gives
   how often each combination should be used;
3. ``x`` is rounded down, then up by largest fraction while the histogram allows;
4. the residual pieces are packed greedily: longest first, each filled up with the longest piece that still fits,
   and only then by cutting the next piece at the window's edge.

What is left at the end of a pool is shorter than a window and is cut into powers of two, which need no padding,
so a pool wastes nothing whatever its size.  Ids stay in the task that made them: there is no shuffle, memory is
bounded by the pool (plus one document), and a repeated task gives the same sequences.

Defined cases: NULL text is an empty one, which is the end id alone; NULL ``doc_id`` stays NULL; repeated rows are
packed as often as they occur; an empty table gives no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plotline.llm.textops import slices
from plotline.llm.tokens import Encoder

WINDOW = 1024
POOL_IDS = 6_000_000
END_ID = 0
_SHARD_BITS = 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples ``a <= b <= c`` of the present lengths that sum to the window (pairs have ``a = 0``)."""
    there = np.zeros(window + 1, bool)
    there[present] = True
    low = np.concatenate([[0], present]).astype(np.int64)
    a, b = (x.ravel() for x in np.meshgrid(low, present.astype(np.int64), indexing="ij"))
    c = window - a - b
    fits = (a <= b) & (b <= c)
    a, b, c = a[fits], b[fits], c[fits]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient; row 0 (no piece) is not counted."""
    flat = combos.T.ravel()
    n = len(histogram)
    weight = (flat > 0).astype(float)
    rows = np.bincount(flat, weights=weight, minlength=n)
    step = 1.0 / max(1.0, 3.0 * rows.max(initial=0.0))  # at most 1 / largest eigenvalue of A'A
    target = histogram.astype(float)
    target[0] = 0.0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        miss = np.bincount(flat, weights=np.tile(y, 3) * weight, minlength=n) - target
        grad = miss[combos[:, 0]] * (combos[:, 0] > 0) + miss[combos[:, 1]] + miss[combos[:, 2]]
        new = np.maximum(0.0, y - step * grad)
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        y = new + (t - 1.0) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram can supply: floor first, then the largest fractions."""
    out = np.floor(x + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for k in np.flatnonzero(out):
        need = np.bincount(combos[k][combos[k] > 0], minlength=1)
        at = np.flatnonzero(need)
        out[k] = min(out[k], int((left[at] // need[at]).min()))
        left[at] -= out[k] * need[at]
    rest = x - np.floor(x + 1e-9)
    for k in np.argsort(-rest, kind="stable"):
        if rest[k] <= 1e-3:
            break
        a, b, c = combos[k]
        if left[c] and left[b] and (a == 0 or left[a]):
            need = np.bincount([v for v in (a, b, c) if v], minlength=1)
            at = np.flatnonzero(need)
            if (left[at] >= need[at]).all():
                left[at] -= need[at]
                out[k] += 1
    return out


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with these lengths (all at least 1)."""
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    whole = lengths // window
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            pieces.append((int(d), k * window, window, seq, 0))
            seq += 1
    rest = lengths - whole * window
    docs = np.flatnonzero(rest)
    docs = docs[np.argsort(rest[docs], kind="stable")]
    stacks: list[list[int]] = [[] for _ in range(window)]  # documents by remaining length
    for d in docs[::-1].tolist():
        stacks[int(rest[d])].append(d)
    start = (whole * window).tolist()
    histogram = np.array([len(s) for s in stacks], dtype=np.int64)
    present = np.flatnonzero(histogram)
    if len(present):
        combos = combinations(present, window)
        if len(combos):
            counts = rounded(combos, repeat_counts(combos, histogram), histogram)
            for k in np.flatnonzero(counts):
                for _ in range(int(counts[k])):
                    at = 0
                    for size in combos[k].tolist():
                        if size:
                            d = stacks[size].pop()
                            pieces.append((d, start[d], size, seq, at))
                            at += size
                    seq += 1
    return pieces + _greedy(stacks, start, window, seq)


def _greedy(stacks: list[list[int]], start: list[int], window: int, seq: int) -> list[tuple[int, int, int, int, int]]:
    """Longest first; each window is filled with the longest pieces that fit, then by cutting one more piece."""
    pieces: list[tuple[int, int, int, int, int]] = []
    total = sum(len(s) * n for n, s in enumerate(stacks))
    heads = [n for n in range(len(stacks)) if stacks[n]]  # present lengths, ascending

    def take(limit: int) -> tuple[int, int] | None:
        """The longest piece of at most ``limit`` ids."""
        i = int(np.searchsorted(heads, limit, side="right")) - 1 if heads else -1
        if i < 0:
            return None
        size = heads[i]
        d = stacks[size].pop()
        if not stacks[size]:
            heads.pop(i)
        return d, size

    def put(d: int, size: int) -> None:
        if size:
            if not stacks[size]:
                heads.insert(int(np.searchsorted(heads, size)), size)
            stacks[size].append(d)

    while total:
        # The last, incomplete window is split into powers of two.
        room = window if total >= window else 1 << (total.bit_length() - 1)
        at = 0
        while at < room:
            got = take(room - at)
            if got is None:
                got = take(window)
            d, size = got
            used = min(size, room - at)
            pieces.append((d, start[d], used, seq, at))
            start[d] += used
            at += used
            put(d, size - used)
        total -= room
        seq += 1
    return pieces


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, pool_ids: int = POOL_IDS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (:data:`SCHEMA`, with ``ids array<int>`` on request).

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        shard = TaskContext.get().partitionId() << _SHARD_BITS
        names: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            names.extend(batch.column("doc_id").to_pylist())
            for x in encoder.encode(batch.column("text"), end_id):
                ids.append(x)
                held += len(x)
            if held >= pool_ids:
                out, used = _pool(names, ids, window, shard, with_ids)
                yield out
                shard, names, ids, held = shard + used, [], [], 0
        if ids:
            yield _pool(names, ids, window, shard, with_ids)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _pool(names: list, ids: list[np.ndarray], window: int, first: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    pieces = plan(lengths, window)
    doc, start, size, seq, at = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
    parts = [ids[d][a : a + n] for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
    crc = np.array([zlib.crc32(p) for p in parts], dtype=np.int64)
    named = pa.array(names, pa.int64()).take(pa.array(doc))
    cols = [named, start, size, crc, lengths[doc], seq + first, at]
    labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols]
    if with_ids:
        flat = np.concatenate(parts).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)))
        labels.append("ids")
    return pa.record_batch(cols, names=labels), int(seq.max()) + 1
