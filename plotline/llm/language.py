"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted on a bounded sample of labelled documents.
The probability of a byte is ``c / (n + d)`` in the longest context that the language knows (``c`` of ``n``
occurrences, ``d`` distinct bytes); a byte not seen there costs the escape ``d / (n + d)`` and is looked up one byte
shorter, down to a uniform choice among 256 bytes.  The statistics are frozen, so the exact code length of a byte
is a function of its last ``ORDER`` bytes.  Each language has a table of its own contexts, which no other language
shortens; a text is scored language by language, by one step per context byte and one look-up per byte.  Every byte
that a language has seen is a symbol; the others cost the same in each context and share one, so lengths are exact
for up to ``CONTEXTS`` contexts of a language.  The language with the shortest code for the whole text wins.

Before counting, ASCII and Latin-1 capitals become small, and every run of other ASCII becomes one space.

Defined cases: NULL text or a text without a letter is ``und`` with score 0; ties go to the alphabetically first
language; without labelled rows every text is ``und``.  Labelled rows with NULL text teach nothing; repeated rows
count as often as they are sampled.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotline.llm.sampling import bounded, texts_of
from plotline.llm.textops import slices
from plotline.session import stage

ORDER = 3
DOCS_PER_LANGUAGE = 400  # bound of the training sample
CONTEXTS = 24_000  # bound of the table of a language
_LETTER = re.compile(r"[^\W\d_]")

_ASCII = np.arange(256)
_SMALL = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII)
_SMALL = np.where((_SMALL < 128) & ~((_SMALL >= 97) & (_SMALL <= 122)), 32, _SMALL).astype(np.uint8)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, one after the other, and their ``n + 1`` offsets; each begins with a space."""
    parts = [(t or "").encode() for t in texts]
    size = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(b" " + p for p in parts), np.uint8)
    first = np.concatenate([[0], np.cumsum(size)])
    out = _SMALL[raw]
    capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[capital] += 0x20
    gap = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[first[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[first]


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, chosen by a hash of the id."""
    rows = docs.where("lang is not null and text is not null")
    ids = stage(bounded(rows, "lang", per_language), "language_ids")
    return texts_of(rows, ids, None).select("lang", "text")


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n)`` over all grams of 1 to ``order + 1`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                data, offs = normalised([t for t, own in zip(texts, langs, strict=True) if own == lang])
                grams, counts = _grams(data, offs, order)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[list[bytes], np.ndarray]:
    """Grams that end at each byte but the leading space; contexts before a text's beginning are spaces."""
    back = _contexts(data, offs, order, 32)
    body = np.ones(len(data), bool)
    body[offs[:-1]] = False
    code = data.astype(np.uint64)
    grams, counts = [], []
    for k in range(order + 1):
        if k:
            code = code | (back[k - 1].astype(np.uint64) << np.uint64(8 * k))
        value, n = np.unique(code[body], return_counts=True)
        grams.extend(int(v).to_bytes(k + 1, "big") for v in value)
        counts.append(n)
    return grams, np.concatenate(counts)


def _contexts(data: np.ndarray, offs: np.ndarray, order: int, space: int) -> list[np.ndarray]:
    """The byte ``k + 1`` places back at every position, a space where that is before the text."""
    out = []
    for k in range(1, order + 1):
        b = np.full(len(data), space, data.dtype)
        b[k:] = data[:-k]
        for j in range(k):
            at = offs[:-1] + j
            b[at[at < offs[1:]]] = space
        out.append(b)
    return out


@dataclass
class Table:
    """Code lengths in bits by context and symbol of one language."""

    symbol: np.ndarray  # symbol of each byte, 0 for bytes not seen
    steps: list[np.ndarray]  # context by shorter context and the symbol before it, per length
    bits: np.ndarray  # by context * symbols + symbol

    def costs(self, data: np.ndarray, back: list[np.ndarray]) -> np.ndarray:
        size = int(self.symbol.max()) + 1
        node = np.zeros(len(data), np.int32)
        for step, b in zip(self.steps, back, strict=True):
            node = step[node * size + self.symbol[b]]
        return self.bits[node * size + self.symbol[data]].astype(np.float64)


@dataclass
class Model:
    """The tables of all languages."""

    languages: list[str]
    tables: list[Table]
    order: int

    def lengths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code length per text and language, and the number of coded bytes."""
        data, offs = normalised(texts)
        back = _contexts(data, offs, self.order, 32)
        out = np.zeros((len(texts), len(self.languages)))
        for k, table in enumerate(self.tables):
            cost = table.costs(data, back)
            cost[offs[:-1]] = 0.0  # the leading space
            total = np.concatenate([[0.0], np.cumsum(cost)])
            out[:, k] = total[offs[1:]] - total[offs[:-1]]
        return out, np.diff(offs) - 1


def _table(counts: Iterable[tuple[bytes, int]], order: int, contexts: int) -> Table:
    """The table of one language from its gram counts."""
    tree: dict[bytes, dict[int, int]] = {}
    for gram, n in counts:
        own = tree.setdefault(gram[:-1], {})
        own[gram[-1]] = own.get(gram[-1], 0) + n
    used = sorted({32}.union(*tree.values(), *tree))
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1

    # Contexts beyond the bound are the rarest of the longest ones; a shorter one is always present.
    total = {c: sum(seen.values()) for c, seen in tree.items()}
    short = sorted((c for c in {b"", *total} if len(c) < order), key=lambda c: (len(c), c))
    long = sorted((c for c in total if len(c) == order), key=lambda c: (-total[c], c))[: max(0, contexts - len(short))]
    names = short + sorted(long)
    place = {c: i for i, c in enumerate(names)}

    bits = np.zeros((len(names), size), np.float32)
    for i, c in enumerate(names):
        suffix = c[1:]
        while c and suffix not in place:
            suffix = suffix[1:]
        bits[i] = bits[place[suffix]] if c else 8.0
        seen = tree.get(c)
        if seen:
            d = len(seen)
            bits[i] -= np.log2(d / (total[c] + d))
            bits[i, symbol[list(seen)]] = -np.log2(np.fromiter(seen.values(), float) / (total[c] + d))

    steps = []
    for k in range(order):  # contexts are in order of their lengths; one that has ended stays
        rows = sum(len(c) <= k for c in names)
        step = np.repeat(np.arange(rows, dtype=np.int32)[:, None], size, axis=1)
        for i, c in enumerate(names):
            if len(c) == k + 1 and c[1:] in place:
                step[place[c[1:]], symbol[c[0]]] = i
        steps.append(step.reshape(-1))
    return Table(symbol, steps, bits.reshape(-1))


def build(counts: Iterable[tuple[str, bytes, int]], order: int = ORDER, contexts: int = CONTEXTS) -> Model:
    """The tables of all languages from their gram counts, which are in order of the languages."""
    languages, tables = [], []
    for lang, rows in groupby(counts, key=lambda r: r[0]):
        languages.append(lang)
        tables.append(_table(((bytes(gram), n) for _, gram, n in rows), order, contexts))
    return Model(languages, tables, order)


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Model | None:
    """A model from the labelled rows of ``docs`` (``text``, ``lang``)."""
    counts = gram_counts(sample(docs, per_language), order).orderBy("lang", "gram")
    model = build(counts.toLocalIterator(), order)  # the grams of one language at a time
    return model if model.languages else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; the score is the posterior of the winner under equal priors."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if own is not None:
                length, _ = own.lengths(texts)
                best = length.argmin(axis=1)
                share = np.exp2(np.maximum(-1000.0, length.min(axis=1, keepdims=True) - length))
                for i, t in enumerate(texts):
                    if t and _LETTER.search(t):
                        names[i] = own.languages[best[i]]
                        scores[i] = 1.0 / share[i].sum()
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
