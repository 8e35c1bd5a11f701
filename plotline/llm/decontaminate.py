"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Texts and items are normalised to lower-case words joined by one space.  Every window of ``width``
consecutive item words (a shorter item is one window) is a pattern of a single automaton; each text is
scanned once, and a match is mapped back to word numbers and to character offsets of the original.

The items are the small, stated query side: their size is measured before they are broadcast, and items
beyond ``max_item_bytes`` are refused rather than cut.  The documents are scanned where they are read;
there is no shuffle.

Defined cases: NULL and empty texts have no words and are clean; NULL or wordless items have no window;
repeated items share patterns and are all reported; items with a NULL id are reported as an empty name.
Extra columns are ignored; an empty table on either side gives clean rows or no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from plotline.llm.textops import slices

WINDOW = 13
MAX_ITEM_BYTES = 64 << 20

# Words are runs of ASCII letters, digits and everything beyond ASCII; all else separates.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_NORMAL = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items array<string>, hit_words array<struct<first:int,last:int>>, "
    "hit_chars array<struct<start:int,end:int>>"
)


def normalise(text: str | None) -> bytes:
    """The words of a text joined by single spaces."""
    return b" ".join((text or "").encode().translate(_NORMAL).split())


def windows(words: list[bytes], width: int) -> Iterator[bytes]:
    for i in range(max(1, len(words) - width + 1) if words else 0):
        yield b" ".join(words[i : i + width])


def build(items: Iterable[tuple[str, str | None]], width: int = WINDOW) -> ahocorasick.Automaton:
    """The automaton; a pattern carries its number of words and the ids of its items."""
    found: dict[str, tuple[int, list[str]]] = {}
    for name, text in items:
        words = normalise(text).split()
        for w in windows(words, width):
            n, names = found.setdefault(f" {w.decode()} ", (w.count(b" ") + 1, []))
            if name not in names:
                names.append(name)
    out = ahocorasick.Automaton()
    for w, value in found.items():
        out.add_word(w, value)
    if found:
        out.make_automaton()
    return out


def scan(machine: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged intervals ``[first, last]`` of hit word numbers, and the items met."""
    flat = normalise(text)
    n = flat.count(b" ") + 1 if flat else 0
    if not n or not len(machine):
        return n, [], set()
    line = f" {flat.decode()} "
    spans: list[tuple[int, int]] = []
    names: set[str] = set()
    at, word = 0, 0  # the words that begin before ``at``
    for end, (count, owners) in machine.iter(line):
        word += line.count(" ", at, end)
        at = end
        spans.append((word - count, word - 1))
        names.update(owners)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return n, merged, names


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets ``[start, end)`` of word intervals in the text as it was."""
    if not spans:
        return []
    edges = {a for a, _ in spans} | {b for _, b in spans}
    found = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in edges}
    return [(found[a][0], found[b][1]) for a, b in spans]


_MACHINES: dict[str, ahocorasick.Automaton] = {}


def _machine(packed: Broadcast) -> ahocorasick.Automaton:
    """One automaton per worker process, whatever number of tasks it runs."""
    items, width, key = pickle.loads(packed.value)
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = build(items, width)
    return _MACHINES[key]


def _broadcast(benchmark: DataFrame, width: int, max_item_bytes: int) -> Broadcast:
    """The items in every worker, after their total size was checked."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0
    if total > max_item_bytes:
        raise ValueError(f"the test items have {total} bytes; max_item_bytes is {max_item_bytes}")
    rows = sorted({(r[0] or "", r[1]) for r in items.collect()})
    key = hashlib.sha256(repr((rows, width)).encode()).hexdigest()
    return benchmark.sparkSession.sparkContext.broadcast(pickle.dumps((rows, width, key)))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Per row of ``docs`` its words, hit words, items and hit places (:data:`SCHEMA`)."""
    packed = _broadcast(benchmark, width, max_item_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(packed)
        for batch in slices(batches):
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                n, spans, names = scan(machine, text)
                hit = sum(b - a + 1 for a, b in spans)
                out.append((n, hit, len(names), sorted(names), spans, original_offsets(text, spans) if spans else []))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.string())),
                 _pairs(cols[4], "first", "last"), _pairs(cols[5], "start", "end")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "hit_words", "hit_chars"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _pairs(rows: Iterable, a: str, b: str) -> pa.Array:
    kind = pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
    return pa.array([[{a: x, b: y} for x, y in r] for r in rows], kind)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    """At least one word in twenty is part of a test item's window."""
    return n_hit > 0 and 20 * n_hit >= n_words


def summary(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The digest of :func:`find_hits`: items as the SHA-256 of their sorted, comma-joined ids."""
    return find_hits(docs, benchmark, width).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    packed = _broadcast(benchmark, width, max_item_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(packed)
        for batch in slices(batches):
            keep = []
            for text in batch.column("text").to_pylist():
                n, spans, _ = scan(machine, text)
                keep.append(not is_contaminated(sum(b - a + 1 for a, b in spans), n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
