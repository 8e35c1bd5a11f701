"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (3 to 5 bytes, with its borders) and of itself,
all hashed into one table; a passage of ``PASSAGE`` words is the average of its words, and a softmax over two
classes, one linear layer, scores it.  Embeddings and layer are trained jointly, in numpy, on a bounded sample
of labelled documents.  Toxic words are few in long texts, so a document counts as its worst passage; training
starts with whole-document averages and then follows the worst passage.  An unseen spelling of a word shares most
of its n-grams and so most of its vector.

Averages are linear: in scoring, each table entry is reduced to the number the layer makes of it, exactly.

Defined cases: NULL text, empty text or a text without words has the score of the layer's bias alone; without labelled
rows of both classes every score is 0.  Labels with NULL ``toxic`` or unknown ``doc_id`` teach nothing; repeated
rows count as often as sampled.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotline.llm.language import normalised
from plotline.llm.sampling import bounded, texts_of
from plotline.llm.textops import constants, slices

PER_CLASS = 2500  # bound of the training sample, documents of each class
MAX_CHARS = 20_000  # longer documents are not used for training
BUCKET_BITS = 17
PASSAGE = 12
SIZES = (3, 4, 5)
THRESHOLD = 0.7
_MULTIPLIERS = (constants(8 * 16, seed=11) >> np.uint64(32)).astype(np.uint32).reshape(16, 8) | np.uint32(1)


def word_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions of the words of normalised bytes (with a space at either end), and per gram its word and bucket."""
    gap = data == 32
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not len(first):
        return first, np.zeros(0, np.int32), np.zeros(0, np.int32)
    word = (np.cumsum(~gap[1:] & gap[:-1]) - 1).astype(np.int32)  # of the byte one place on
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    wide = data.astype(np.uint32)
    owners, buckets = [], []
    shift = np.uint32(32 - BUCKET_BITS)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        at = np.flatnonzero(gaps[size - 1 : size - 1 + n] == gaps[1 : 1 + n])  # no space inside
        h = np.full(len(at), size, np.uint32)
        for k in range(size):
            h = (h ^ wide[at + k]) * _MULTIPLIERS[size, k]
        h ^= h >> np.uint32(15)
        owners.append(word[at])
        buckets.append((h * np.uint32(0x9E3779B1) >> shift).astype(np.int32))
    return first, np.concatenate(owners), np.concatenate(buckets)


def passages(first: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its passage, and per text its first passage and number of passages."""
    at = np.searchsorted(first, offs)
    count = np.diff(at)
    number = -(-count // PASSAGE)
    base = np.cumsum(number) - number
    text = np.repeat(np.arange(len(count)), count)
    return base[text] + (np.arange(len(first)) - at[:-1][text]) // PASSAGE, base, number


@dataclass
class Model:
    """What the linear layer makes of each table entry, and its bias."""

    weight: np.ndarray
    bias: float
    scale: float

    def passage_logits(self, words: np.ndarray, first: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        passage, base, number = passages(first, offs)
        total = int(number.sum())
        size = np.bincount(passage, minlength=total)
        mean = np.bincount(passage, weights=words, minlength=total) / np.maximum(size, PASSAGE // 2)
        return mean, base, number

    def scores(self, texts: list[str | None]) -> np.ndarray:
        data, offs = normalised(texts)
        data = np.append(data, np.uint8(32))
        first, owner, bucket = word_grams(data)
        grams = np.maximum(1, np.bincount(owner, minlength=len(first)))
        words = np.bincount(owner, weights=self.weight[bucket], minlength=len(first)) / grams
        # A word that repeats its neighbour counts once (equal words have equal sums).
        once = np.ones(len(first), bool)
        once[1:] = (words[1:] != words[:-1]) | (grams[1:] != grams[:-1])
        once[np.searchsorted(first, offs[:-1])[np.searchsorted(first, offs[:-1]) < len(first)]] = True
        mean, base, number = self.passage_logits(words[once], first[once], offs)
        worst = np.zeros(len(texts))
        some = number > 0
        if some.any():
            worst[some] = np.maximum.reduceat(mean, base[some])
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * worst + self.bias, -40, 40)))


def fit(texts: list[str], labels: np.ndarray, dims: int = 8, epochs: int = 24, batch: int = 100, rate: float = 3.0, seed: int = 7) -> Model:
    """Train table and layer on documents with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    # Words of the sample, each distinct word once with its grams.
    names: dict[bytes, int] = {}
    tokens: list[np.ndarray] = []
    for text in texts:
        data, _ = normalised([text])
        own = np.array([names.setdefault(w, len(names)) for w in data.tobytes().split()], np.int32)
        tokens.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    flat = np.frombuffer(b" " + b" ".join(names) + b" ", np.uint8)
    _, owner, bucket = word_grams(flat)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    grams = np.bincount(owner, minlength=len(names))
    start = np.cumsum(grams) - grams
    many = np.maximum(1, grams)

    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, dims)).astype(np.float32)
    layer = rng.normal(0, 0.5, dims).astype(np.float32)
    bias = 0.0
    # One step size for the whole table: rare n-grams move little, so single documents are not learnt by heart.
    seen = lseen = bseen = 1e-6
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    scale = 10.0
    usable = np.flatnonzero([len(t) > 0 for t in tokens])
    for epoch in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), batch):
            docs = usable[at : at + batch]
            used = np.unique(np.concatenate([tokens[d] for d in docs]))
            word = np.zeros(len(names))
            rows = bucket[np.repeat(start[used] - (np.cumsum(grams[used]) - grams[used]), grams[used]) + np.arange(int(grams[used].sum()))]
            value = table[rows] @ layer
            word[used] = np.bincount(np.repeat(np.arange(len(used)), grams[used]), weights=value, minlength=len(used)) / many[used]
            chosen, size, doc_of = [], [], []
            for j, d in enumerate(docs):
                own = tokens[d]
                part = np.arange(len(own)) // PASSAGE
                number = int(part[-1]) + 1
                if epoch < 4:  # whole documents
                    chosen.append(own)
                    size.append(len(own))
                else:
                    n = np.maximum(np.bincount(part), PASSAGE // 2)
                    worst = int((np.bincount(part, weights=word[own]) / n).argmax()) if number > 1 else 0
                    chosen.append(own[worst * PASSAGE : (worst + 1) * PASSAGE])
                    size.append(int(n[worst]))
                doc_of.append(np.full(len(chosen[-1]), j))
            ids, doc_of, size_ = np.concatenate(chosen), np.concatenate(doc_of), np.array(size, float)
            logit = scale * np.bincount(doc_of, weights=word[ids], minlength=len(docs)) / size_ + bias
            slope = (1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))) - y[docs]) * weight[docs] / len(docs)
            # Back through the averages: document -> words -> grams.
            per_word = scale * slope[doc_of] / size_[doc_of] / many[ids]
            count = grams[ids]
            rows = bucket[np.repeat(start[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            push = np.repeat(per_word, count)
            rows, back = np.unique(rows, return_inverse=True)
            push = np.bincount(back, weights=push).astype(np.float32)
            grad = push[:, None] * layer[None, :] + 1e-7 * table[rows]
            grad_layer = (push[:, None] * table[rows]).sum(axis=0)
            seen += float((grad**2).sum()) / dims
            table[rows] -= rate * grad / np.sqrt(seen)
            lseen += float((grad_layer**2).mean())
            layer -= (0.5 * rate * grad_layer / np.sqrt(lseen)).astype(np.float32)
            bseen += float(slope.sum()) ** 2
            bias -= rate * float(slope.sum()) / np.sqrt(bseen)
    return Model((table @ layer).astype(np.float32), bias, scale)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model | None:
    """A model from labelled rows of ``docs``: at most ``per_class`` documents of each class, none above ``max_chars``."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    known = known.join(docs.select(F.col("doc_id").alias("__doc")).distinct(), F.col("doc_id") == F.col("__doc"), "left_semi")
    rows = texts_of(docs, bounded(known, "__toxic", per_class), 2 * per_class)
    rows = rows.where((F.col("text") != "") & (F.length("text") <= max_chars))
    got = rows.orderBy("__toxic", F.xxhash64("doc_id"), "doc_id").select("__toxic", "text").collect()
    y = np.array([r["__toxic"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit([r["text"] for r in got], y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs``."""
    run = _scorer(docs, model, False)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def remove_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return docs.mapInArrow(_scorer(docs, model, True), docs.schema)


def _scorer(docs: DataFrame, model: Model | None, keep: bool):
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            s = own.scores(texts) if own is not None else np.zeros(len(texts))
            if keep:
                yield batch.filter(pa.array(s < THRESHOLD))
            else:
                yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run
