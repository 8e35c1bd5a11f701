"""Quality classifier by positive-unlabelled learning.

Trusted positives (``quality = 1``) and unlabelled documents train a small network under the non-negative
unbiased risk ``pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])`` with the logistic loss; when the estimated
negative part falls below zero its gradient is reversed, which keeps the network from driving it further down.
The class prior ``pi`` is estimated as the share of positives among the labelled training rows.

A document is described by the shape of its text - kinds of characters, words and lines, and how much they repeat -
never by its labels, language, source or id.  Features are computed where the texts are read; only those of a bounded
sample reach the driver.

Defined cases: NULL and empty texts have the features of an empty text; without positives or without unlabelled
training rows every score is 0.  Labels with NULL ``quality`` or unknown ``doc_id`` teach nothing; rows that repeat are
counted as often as sampled.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotline.llm.sampling import bounded, texts_of
from plotline.llm.textops import buffers, slices, word_hashes

PER_KIND = 5000  # bound of the training sample: positives, and unlabelled documents
THRESHOLD = 0.7
_MARKS = b"*%&$#|!.,;:()[]{}<>/\\\"'-_=+@"
_BYTE = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTE >= a) & (_BYTE <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_WIDE, _BLANK = _BYTE >= 128, (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))


def features(col: pa.Array) -> np.ndarray:
    """One row of numbers per text; the same for equal texts."""
    raw, offs = buffers(col)
    words, first = word_hashes(raw, offs)
    rows = []
    for i in range(len(offs) - 1):
        own = raw[offs[i] : offs[i + 1]]
        n = max(1, len(own))
        count = np.bincount(own, minlength=256)
        share = count / n
        kinds = [share[k].sum() for k in (_UPPER, _LOWER, _DIGIT, _WIDE, _BLANK)]
        marks = [share[b] for b in _MARKS]
        p = share[share > 0]
        w = words[first[i] : first[i + 1]]
        m = max(1, len(w))
        _, often = np.unique(w, return_counts=True) if len(w) else (w, np.zeros(1))
        letters = max(1, count[_UPPER].sum() + count[_LOWER].sum() + count[_WIDE].sum())
        lines = own.tobytes().split(b"\n")
        filled = [x for x in lines if x]
        rows.append([
            *kinds, *marks, 1 - sum(kinds), -(p * np.log2(p)).sum() if len(p) else 0.0, count[_UPPER].sum() / letters,
            n / m, len(often) / m, often.max() / m, (w[1:] == w[:-1]).sum() / m, (often > 1).sum() / m, np.log1p(len(w)), np.log1p(n),
            np.log1p(len(lines)), len(set(filled)) / max(1, len(filled)), np.log1p(n / max(1, len(filled))), len(w) == 0,
        ])
    return np.array(rows, np.float32).reshape(len(offs) - 1, -1)


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(_forward(self.layers, self._scaled(x))[1], -40, 40)))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, v, c = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ v + c


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Model:
    """Minimise the non-negative risk by Adam."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-3, (), prior)
    xp, xu = model._scaled(positive), model._scaled(unlabelled)
    d = xp.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moment = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    steps = max(epochs * max(1, len(xu) // batch), 400)
    for step in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(batch, len(xp)))]
        u = xu[rng.integers(0, len(xu), min(batch, len(xu)))]
        layers = (theta[0], theta[1], theta[2], theta[3][0])
        hp, zp = _forward(layers, p)
        hu, zu = _forward(layers, u)
        softplus = lambda z: np.logaddexp(0.0, z)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        gp_pos = -prior * _sigmoid(-zp) / len(p)
        gp_neg, gu_neg = -prior * _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
        gp, gu = (gp_pos + gp_neg, gu_neg) if negative >= 0 else (-gp_neg, -gu_neg)
        grads = [1e-4 * theta[0], np.zeros(hidden), 1e-4 * theta[2], np.zeros(1)]
        for x, h, g in ((p, hp, gp), (u, hu, gu)):
            back = np.outer(g, theta[2]) * (1 - h**2)
            for k, part in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                grads[k] = grads[k] + part
        for t, (m1, m2), g in zip(theta, moment, grads, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            t -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    model.layers = (theta[0], theta[1], theta[2], float(theta[3][0]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_kind: int = PER_KIND) -> Model | None:
    """A model from ``docs`` (training rows) and ``labels``: at most ``per_kind`` positives and unlabelled rows."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("quality").alias("__quality"))
    rows = docs.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("__doc"), "left")
    # Positives are trusted; the labels 0 are used for the prior alone.
    kind = F.when(F.col("__quality").isNull(), "unlabelled").when(F.col("__quality") == 1, "positive")
    rows = rows.select("doc_id", "__quality", kind.alias("__kind"))
    share = rows.where("__quality is not null").agg(F.avg("__quality")).first()[0]
    picked = texts_of(docs, bounded(rows, "__kind", per_kind), 2 * per_kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text"))
            yield pa.record_batch([batch.column("__kind"), batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["kind", "doc_id", "x"])

    got = picked.select("__kind", F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind string, doc_id long, x array<float>").orderBy("kind", "doc_id", "x").collect()
    sets = {k: np.array([r["x"] for r in got if r["kind"] == k], np.float32) for k in ("positive", "unlabelled")}
    if not len(sets["positive"]) or not len(sets["unlabelled"]):
        return None
    return fit(sets["positive"], sets["unlabelled"], float(share))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs``."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in slices(batches):
            s = own.scores(features(batch.column("text"))) if own is not None else np.zeros(batch.num_rows)
            s = s.astype(np.float64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
