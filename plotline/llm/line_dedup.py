"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference counts.

A line's key is the line stripped of ASCII space with A-Z lower-cased; keys shorter than ``min_chars`` code
points are never touched.  The state has three tables, all keyed by a 128-bit hash of the key:

* ``refs``: exact references ``(hi, lo, doc_id)``, one row per key and document;
* ``counts``: ``(hi, lo, docs, first_doc)``, the reference counts, derived from ``refs``;
* ``filters``: per shard of the hash space one cuckoo filter of the keys that are in ``counts``.

An insertion asks the filters first: keys they do not know are new and need no look-up, the rest are merged
with the exact counts.  A deletion takes a document's references out, recounts only its keys and removes the
fingerprints of keys without references; the tables then are what they would be had the document never come.
A filter only ever saves work; every decision is taken on the exact counts.

Hot lines: references are pre-aggregated before each shuffle (minimum and count), so a line that a third
of all documents share is one row per task.  Nothing collects the documents of a line.  Filters of the *shared*
keys gate the second reading of the texts; they are broadcast only while their total size is within
``gate_bytes``, else the exact join runs without the gate and gives the same rows.

Defined cases: NULL text is one empty line; a NULL ``doc_id`` owns no reference, its lines stay; rows that
repeat a ``doc_id`` are one document (a key in both is no duplicate); a key repeated inside its first document
stays there each time; an empty table gives no rows.  Extra columns pass through ``drop_lines`` unchanged.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from plotline.llm.textops import SPACE, constants, mix, slices
from plotline.session import scratch_folder, stage

MIN_CHARS = 10
KEYS_PER_SHARD = 200_000
GATE_BYTES = 16 << 20


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports insertion, look-up and removal of arrays of hashes.

    Partial-key cuckoo hashing: the second bucket follows from the first and the fingerprint alone.  A
    fingerprint that finds no place after ``MAX_KICKS`` moves doubles the filter, which needs the keys again, so
    the owner passes all hashes of the shard to :meth:`of`; ``add`` reports whether everything found a place.
    """

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of all ``hashes``, at most 84 % full."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(hashes)) / (0.84 * cls.SLOTS)))))
        while True:
            out = cls(buckets)
            if out.add(hashes):
                return out
            buckets *= 2

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(hashes.astype(np.uint64, copy=False))
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return print_, first, first ^ self._jump(print_)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return mix(prints.astype(np.uint64) + constants(1, seed=9)[0]) & self.mask

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; returns which are still without a place."""
        left = np.ones(len(prints), bool)
        for slot in range(self.SLOTS):
            rows = np.flatnonzero(left)
            rows = rows[self.table[bucket[rows], slot] == 0]
            place, one = np.unique(bucket[rows], return_index=True)  # one newcomer per free slot
            self.table[place, slot] = prints[rows[one]]
            left[rows[one]] = False
        return left

    def add(self, hashes: np.ndarray) -> bool:
        prints, bucket, other = self._places(hashes)
        for turn in range(self.MAX_KICKS):
            left = self._settle(prints, bucket)
            prints, bucket, other = prints[left], bucket[left], other[left]
            left = self._settle(prints, other)
            prints, bucket, other = prints[left], bucket[left], other[left]
            if not len(prints):
                return True
            # Both buckets are full: one newcomer per bucket takes a slot, the evicted go to their other bucket.
            place, one = np.unique(other, return_index=True)
            evicted = self.table[place, turn % self.SLOTS].copy()
            self.table[place, turn % self.SLOTS] = prints[one]
            prints[one], bucket[one] = evicted, place ^ self._jump(evicted)
            other = bucket ^ self._jump(prints)
        return False

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(hashes)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint per hash (each must have been added)."""
        for p, a, b in zip(*self._places(hashes), strict=True):
            for place in (a, b):
                slot = np.flatnonzero(self.table[place] == p)
                if len(slot):
                    self.table[place, slot[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of one line in UTF-8, or None for a line too short to be judged."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Per line the 16-byte hash of its key (None: too short)."""
    keys = (line_key(x, min_chars) for x in (text or "").encode().split(b"\n"))
    return [None if k is None else key_hash(k) for k in keys]


def shard_of(hi: F.Column, shards: int) -> F.Column:
    return F.pmod(hi, F.lit(shards)).cast("int")


def references(docs: DataFrame, min_chars: int = MIN_CHARS, gate: list[bytes] | None = None) -> DataFrame:
    """One row ``(hi, lo, doc_id)`` per key and document (repeated only if a ``doc_id`` repeats).

    ``gate`` are the cuckoo filters, by shard, of the keys that matter; references to others are left out.
    """
    packed = docs.sparkSession.sparkContext.broadcast(gate) if gate is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [CuckooFilter.from_bytes(f) for f in packed.value] if packed is not None else None
        for batch in slices(batches):
            names = batch.column("doc_id").to_pylist()
            raw, owner = [], []
            for name, text in zip(names, batch.column("text").to_pylist(), strict=True):
                if name is not None:
                    found = set(line_hashes(text, min_chars))
                    found.discard(None)
                    raw.extend(found)
                    owner.append((name, len(found)))
            pair = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            ids = np.repeat(np.array([n for n, _ in owner], np.int64), [c for _, c in owner])
            if filters is not None and len(pair):
                shard = np.mod(pair[:, 0], len(filters))
                keep = np.zeros(len(pair), bool)
                for s in np.unique(shard):
                    rows = np.flatnonzero(shard == s)
                    keep[rows] = filters[s].has(pair[rows, 1].view(np.uint64))
                pair, ids = pair[keep], ids[keep]
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids)], names=["hi", "lo", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hi long, lo long, doc_id long")


def count_references(refs: DataFrame, exact: bool = True) -> DataFrame:
    """Reference counts per key.  ``exact=False`` tells only "one document" from "several" in ``docs`` (1 or 2),
    which needs no row per document; minimum and maximum differ exactly when there are several."""
    if not exact:
        several = F.when(F.min("doc_id") < F.max("doc_id"), 2).otherwise(1).cast("long")
        return refs.groupBy("hi", "lo").agg(several.alias("docs"), F.min("doc_id").alias("first_doc"))
    return refs.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def build_filters(counts: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter per shard: ``(shard, keys, cuckoo)``."""

    def one(group: pa.Table) -> pa.Table:
        h = group.column("lo").to_numpy().view(np.uint64)
        return pa.table({
            "shard": group.column("shard").slice(0, 1), "keys": pa.array([len(h)], pa.int64()),
            "cuckoo": pa.array([CuckooFilter.of(h).to_bytes()], pa.binary()),
        })

    rows = counts.select(shard_of(F.col("hi"), shards).alias("shard"), "lo")
    return rows.groupBy("shard").applyInArrow(one, "shard int, keys long, cuckoo binary")


def shards_for(keys: int, per_shard: int = KEYS_PER_SHARD) -> int:
    return max(1, -(-keys // per_shard))


def _gate(shared: DataFrame, keys: int, gate_bytes: int) -> list[bytes] | None:
    """Filters of the shared keys by shard, or None when they would not fit the bound."""
    if keys * 8 > gate_bytes:  # a filter has at most 8 bytes per key
        return None
    shards = shards_for(keys, 20_000)
    blank = CuckooFilter(1).to_bytes()
    found = {r["shard"]: bytes(r["cuckoo"]) for r in build_filters(shared, shards).collect()}
    return [found.get(s, blank) for s in range(shards)]


DECISION = "kept string, n_lines long, n_dropped long"


def decide(docs: DataFrame, min_chars: int = MIN_CHARS, gate_bytes: int = GATE_BYTES) -> DataFrame:
    """The rows of ``docs`` with :data:`DECISION` columns after all of them were inserted into an empty state."""
    shared = stage(count_references(references(docs, min_chars), exact=False).where("docs > 1"), "shared_lines")
    return apply_counts(docs, shared, min_chars, gate_bytes)


def apply_counts(docs: DataFrame, shared: DataFrame, min_chars: int = MIN_CHARS, gate_bytes: int = GATE_BYTES) -> DataFrame:
    """The rows of ``docs`` without the lines whose key is shared and whose first document is another one."""
    refs = references(docs, min_chars, _gate(shared, shared.count(), gate_bytes))
    owned = shared.select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), "first_doc")
    lost = (
        refs.join(owned, (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")) & (F.col("doc_id") > F.col("first_doc")))
        .select(F.col("doc_id").alias("__doc"), F.struct("hi", "lo").alias("__key"))
        .groupBy("__doc").agg(F.collect_set("__key").alias("__keys"))  # the keys of one document
    )
    lost = lost.select("__doc", F.transform("__keys", lambda k: k["hi"]).alias("__his"), F.transform("__keys", lambda k: k["lo"]).alias("__los"))
    plain = [c for c in docs.columns if c not in ("__doc", "__his", "__los")]
    joined = docs.select(*plain).join(lost, docs["doc_id"] == lost["__doc"], "left").drop("__doc")
    return joined.mapInArrow(_dropper(min_chars), _schema(docs, plain))


def _schema(docs: DataFrame, plain: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [c for c in plain if c not in ("kept", "n_lines", "n_dropped")]
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in names], DECISION])


def _dropper(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, lines, dropped = [], [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("text", "__his", "__los")], strict=True)
            for text, his, los in rows:
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if his:
                    gone = {struct.pack("<qq", a, b) for a, b in zip(his, los, strict=True)}
                    parts = [p for p, h in zip(parts, line_hashes(text, min_chars), strict=True) if h not in gone]
                kept.append("\n".join(parts))
                dropped.append(lines[-1] - len(parts))
            names = [n for n in batch.schema.names if n not in ("__his", "__los", "kept", "n_lines", "n_dropped")]
            yield pa.record_batch(
                [*[batch.column(n) for n in names], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*names, "kept", "n_lines", "n_dropped"],
            )

    return run


def summary(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document its lines, dropped lines and the SHA-256 of what stays."""
    return decide(docs.select("doc_id", "text"), min_chars).select(
        F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with their texts after line dedup; documents that lose every line stay with an empty text."""
    out = decide(docs, min_chars)
    cols = []
    for f in docs.schema:
        if f.name == "text":
            cols.append(F.when(F.col("text").isNotNull(), F.col("kept")).alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return out.select(*cols)


class LineState:
    """The three tables of an incremental run, one folder per version under the shared scratch folder."""

    def __init__(self, spark: SparkSession, shards: int = 16, min_chars: int = MIN_CHARS):
        self.spark, self.shards, self.min_chars = spark, shards, min_chars
        self.refs = spark.createDataFrame([], "hi long, lo long, doc_id long")
        self.counts = spark.createDataFrame([], "hi long, lo long, docs long, first_doc long")
        self.filters = spark.createDataFrame([], "shard int, keys long, cuckoo binary")

    def _known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (hi, lo, ...) with ``known``: what the shard's filter says."""
        sharded = keys.withColumn("shard", shard_of(F.col("hi"), self.shards))
        kind = StructType([*sharded.schema.fields, StructField("known", BooleanType())])

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            h = left.column("lo").to_numpy().view(np.uint64)
            yes = np.zeros(len(h), bool)
            for raw in right.column("cuckoo").to_pylist():
                yes |= CuckooFilter.from_bytes(raw).has(h)
            return left.append_column("known", pa.array(yes))

        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(ask, kind).drop("shard")

    def _write(self, refs: DataFrame, counts: DataFrame, touched: DataFrame) -> None:
        """New versions of the tables; only shards with touched keys get a new filter."""
        folder = scratch_folder(self.spark, "line_state")
        refs.select("hi", "lo", "doc_id").write.parquet(f"{folder}/refs")
        counts.select("hi", "lo", "docs", "first_doc").write.parquet(f"{folder}/counts")
        self.refs, self.counts = (self.spark.read.parquet(f"{folder}/{n}") for n in ("refs", "counts"))
        shards = touched.select(shard_of(F.col("hi"), self.shards).alias("shard")).distinct()
        fresh = build_filters(self.counts.join(shards, shard_of(F.col("hi"), self.shards) == shards["shard"], "left_semi"), self.shards)
        fresh.unionByName(self.filters.join(shards, "shard", "left_anti")).write.parquet(f"{folder}/filters")
        self.filters = self.spark.read.parquet(f"{folder}/filters")

    def insert(self, docs: DataFrame) -> None:
        """Add documents (their ids must be new)."""
        refs = stage(references(docs, self.min_chars).distinct(), "line_refs")
        asked = stage(self._known(count_references(refs)), "line_asked")
        old = asked.where("known").select("hi", "lo")
        merged = (
            asked.where("known").drop("known").unionByName(self.counts.join(old, ["hi", "lo"], "left_semi"))
            .groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))
        )
        counts = self.counts.join(old, ["hi", "lo"], "left_anti").unionByName(merged).unionByName(asked.where("not known").drop("known"))
        self._write(self.refs.unionByName(refs), counts, asked)

    def delete(self, ids: DataFrame) -> None:
        """Take documents out (``ids`` has ``doc_id``) as if they had never been inserted."""
        names = ids.select(F.col("doc_id").cast("long")).distinct()
        touched = stage(self.refs.join(names, "doc_id", "left_semi").select("hi", "lo").distinct(), "line_touched")
        refs = stage(self.refs.join(names, "doc_id", "left_anti"), "line_refs")
        again = count_references(refs.join(touched, ["hi", "lo"], "left_semi"))
        counts = self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(again)
        self._write(refs, counts, touched)

    def shared(self) -> DataFrame:
        return self.counts.where("docs > 1")
