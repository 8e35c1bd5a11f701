"""Vectorised text helpers used inside tasks: Arrow slices, words, shingles and hashes.

All of them work on the UTF-8 buffers of Arrow batches, so a task handles a few megabytes of text at a
time and creates no Python object per word.  Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 2_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int = 1) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers, fixed by ``seed``; a longer list starts with the shorter one."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_SPACE = np.isin(_BYTE, np.frombuffer(SPACE, np.uint8))
_POSITIONS = [constants(64)]


def positions(n: int) -> np.ndarray:
    """Multipliers of the first ``n`` places in a word."""
    if len(_POSITIONS[0]) < n:
        _POSITIONS[0] = constants(max(n, 2 * len(_POSITIONS[0])))
    return _POSITIONS[0]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``n + 1`` offsets; NULL is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):  # no or several chunks remain only for huge columns
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs.astype(np.int64) - int(offs[0])


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text (one very long text stays whole)."""
    for batch in batches:
        _, offs = buffers(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
            end = min(n, max(start + 1, end))
            yield batch.slice(start, end - start)
            start = end


def _hash_words(raw: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one chunk; a word never crosses ``starts_at``."""
    inside = ~IS_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[starts_at] = inside[starts_at]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(begin[at])
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = (LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * positions(int(length.max()))[place]
        return mix(np.add.reduceat(value, first)), at[first]


def word_hashes(raw: np.ndarray, offs: np.ndarray, chunk: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-case A-Z, split at ASCII space) of the texts, and per text the first word's index.

    Long texts are read in chunks that end at a space, so the temporary memory does not follow the text.
    """
    hashes, places, a = [], [], 0
    edges = offs[:-1]
    while a < len(raw):
        b = min(len(raw), a + chunk)
        if b < len(raw):
            while True:  # extend to the next space, or to the end of an unbroken run
                end = min(len(raw), b + 65536)
                gap = np.flatnonzero(IS_SPACE[raw[b:end]])
                if len(gap):
                    b += int(gap[0])
                    break
                b = end
                if b == len(raw):
                    break
        lo, hi = np.searchsorted(edges, [a, b])
        h, p = _hash_words(raw[a:b], edges[lo:hi] - a)
        hashes.append(h)
        places.append(p + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    p = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.searchsorted(p, offs)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the hashes of its ``width``-word shingles in order; a shorter text is one shingle, an empty one none."""
    c = constants(width + 1, seed=2)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += words[k : k + n] * c[k]
        total = mix(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield total[a : b - width + 1]
            elif b > a:
                yield mix(np.array([(words[a:b] * c[: b - a]).sum(dtype=np.uint64) + c[width] * np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)


def shingle_sets(col: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes."""
    raw, offs = buffers(col)
    words, first = word_hashes(raw, offs)
    for s in shingles(words, first, width):
        yield np.unique(s)
