"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

Two sets of ``a`` and ``b`` shingles with Jaccard similarity ``t`` or more differ in at most
``H = floor((a + b)(1 - t) / (1 + t))`` shingles.  The hash space is cut into ``m`` segments.  If a set looks up
segments with budgets that add up to ``H + 1`` - one for "equal in this segment", two for "equal up to one
shingle" - one of these look-ups must succeed for every similar set.

* **Size bands.**  A band holds sizes within a factor ``1 / t``; a set looks for partners that are not larger than
  itself, so it looks in its own band and the one below.  Each band has its own ``m``.
* **Segment subsets and one-deletion neighbourhoods.**  A segment's signature is a hash of its subset.  In the
  first ``g`` segments of a band all subsets with one shingle taken out are indexed too: sets that differ
  in one shingle there meet in such a signature.
* **Cost-based allocation.**  ``m`` and ``g`` of a band minimise signatures plus expected useless candidates under
  the measured sizes (:func:`choose`); each set spends its look-ups on the segments with the largest subsets and
  leaves out the small ones, which are the common ones.
* **Verification.**  Candidates are checked on their whole texts.

Signatures travel as packed arrays (8 bytes each), one Spark row per task and target group.  In a group, sets
that share a signature are linked to one centre, the one that shares most, never to each other; only sets that
turn out *not* to be connected with their centre are compared with the others that met it, after a bound on the
symmetric difference (counters per hash range) has been applied.  No link is lost and copies are not expanded into pairs.
Equal sets are one class throughout, known by a 64-bit digest of their shingles.

Defined cases: NULL, empty and wordless texts have an empty set and are linked with nothing; shorter texts are one
shingle; each of several rows with one ``doc_id`` is returned with the component of its own text; rows without
``doc_id`` link nothing and are returned without a component; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotline.llm.components import connected
from plotline.llm.textops import constants, mix, shingle_sets, slices
from plotline.session import stage

WIDTH = 5
THRESHOLD = (4, 5)
GROUP_ENTRIES = 1_500_000
FLUSH_ENTRIES = 1_000_000
BLOCK = 20_000
_WASTE = 5.0  # cost of a useless candidate in signatures
_PROBE, _EXACT, _LOCAL = 0x8000, 0x4000, 0x3FFF


@dataclass(frozen=True)
class Band:
    """Sizes ``lo..hi``, looked up by sizes up to ``top``, cut into ``m`` segments of which ``g`` have neighbourhoods."""

    lo: int
    hi: int
    top: int
    m: int
    g: int


def differing(total, t: tuple[int, int]):
    """Most shingles in which two sets of together ``total`` shingles may differ."""
    return total * (t[1] - t[0]) // (t[1] + t[0])


def band_edges(largest: int, t: tuple[int, int]) -> list[tuple[int, int]]:
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, lo * t[1] // t[0])
        out.append((lo, hi))
        lo = hi + 1
    return out


def _overdraw(spare: int, m: int, g: int, lam: float) -> float:
    """Upper estimate of the chance that a set has more useless segments than it can leave out."""
    none = math.exp(-lam)
    mean = (m - g) * none + 2 * g * none * (1 + lam)
    if spare + 1 <= mean:
        return 1.0
    return math.exp((spare + 1) * (1 - math.log((spare + 1) / mean)) - mean) if mean > 0 else 0.0


def choose(lo: int, hi: int, t: tuple[int, int], own: int, below: int) -> Band:
    """The cheapest band layout for ``own`` sets in the band and ``below`` sets that look down into it."""
    top = hi * t[1] // t[0]
    need = differing(top + hi, t) + 1
    if need == 1:
        return Band(lo, hi, top, 0, 0)  # only equal sets can be similar
    best = None
    for part in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6):
        m = max(1, math.ceil(need * part))
        for spare in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6):
            g = max(0, math.ceil(need * (1 + spare)) - m)
            if g > m or m + g < need:
                continue
            cost = 0.0
            for n, sets, partner in ((lo, own, lo), ((lo + hi) // 2, own, (lo + hi) // 2), (hi, own, hi), (hi + 1, below, hi), (top, below, hi)):
                lam = n / m
                asked = differing(n + partner, t) + 1
                entries = m + g * lam if partner == n else asked * (1 + g / (m + g) * (lam - 1))
                waste = _overdraw(m + g - asked, m, g, lam) * own * math.exp(-partner / m)
                cost += sets * (entries + _WASTE * waste) / (3 if partner == n else 2)
            if best is None or cost < best[0]:
                best = (cost, Band(lo, hi, top, m, g))
    return best[1]


def plan_bands(sizes: dict[int, int], largest: int, t: tuple[int, int]) -> list[Band]:
    """One layout per band; ``sizes`` counts the sets per band number."""
    edges = band_edges(largest, t)
    return [choose(lo, hi, t, sizes.get(k, 0), sizes.get(k + 1, 0)) for k, (lo, hi) in enumerate(edges)]


def signatures(sets: list[np.ndarray], bands: list[Band], t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets: ``(signature, set number, flags)`` over their own band and the one below."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    his = np.array([b.hi for b in bands], dtype=np.int64)
    m_of, g_of = (np.array([getattr(b, k) for b in bands], dtype=np.int64) for k in ("m", "g"))
    band = np.searchsorted(his, n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for down in (0, 1):
        k = band - down
        ok = (n > 0) & (k >= 0)
        ok[ok] &= (m_of[k[ok]] > 0) & (n[ok] <= np.array([b.top for b in bands])[k[ok]])
        who = np.flatnonzero(ok)
        if not len(who):
            continue
        kk, size = k[who], n[who]
        m, g = m_of[kk], g_of[kk]
        base = np.concatenate([[0], np.cumsum(m)])
        value = np.concatenate([sets[i] for i in who])
        owner = np.repeat(np.arange(len(who)), size)
        # Sorted sets and segments that are hash ranges: a set's segments follow each other.
        with np.errstate(over="ignore"):
            segment = ((value >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            at = base[owner] + segment
            count = np.bincount(at, minlength=base[-1])
            token = mix(value + constants(1, seed=3)[0])
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token, dtype=np.uint64)])
            end = np.cumsum(count)
            total = running[end] - running[end - count]
            owner_of = np.repeat(np.arange(len(who)), m)
            number = np.arange(base[-1]) - base[owner_of]
            salt = mix(number.astype(np.uint64) * constants(1, seed=4)[0] + kk[owner_of].astype(np.uint64))
            double = number < g[owner_of]
            # Spend the budget on the largest subsets.
            asked = differing(size + np.minimum(size, his[kk]), t) + 1
            worth = np.where(double, 2, 1)
            order = np.lexsort((-(count / worth), owner_of))
            spent = np.cumsum(worth[order])
            before = spent - worth[order] - np.concatenate([[0], np.cumsum(m + g)])[owner_of[order]]
            probe = np.zeros(base[-1], bool)
            probe[order] = before < asked[owner_of[order]]
            flags = np.where(probe, _PROBE, 0) | _EXACT
            keep = np.ones(base[-1], bool) if down == 0 else probe
            out.append((mix(total[keep] + salt[keep]), who[owner_of[keep]], flags[keep]))
            near = (double & keep)[at]
            spot = at[near]
            out.append((mix(total[spot] - token[near] + salt[spot]), who[owner_of[spot]], flags[spot] & ~_EXACT))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig, who, flags = (np.concatenate(c) for c in zip(*out, strict=True))
    return sig, who, flags


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def counters(s: np.ndarray) -> bytes:
    """Shingles per range of a second hash, at most 255, in one to two times as many ranges as there are shingles.

    The L1 distance of two sets' counters bounds the number of shingles in which they differ from below.
    """
    bits = max(6, int(np.ceil(np.log2(max(1, len(s))))))
    at = (mix(s) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(rows: list[bytes]) -> np.ndarray:
    """Counters of several sets in the number of ranges of the smallest; sums of neighbours keep the bound."""
    size = min(map(len, rows))
    return np.stack([np.frombuffer(r, np.uint8).reshape(size, -1).sum(axis=1, dtype=np.int32) for r in rows])


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, class, counts)`` per row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), width))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([counters(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "class", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, class long, counts binary")


def _pack(sig: np.ndarray, cls: np.ndarray, who: np.ndarray, flags: np.ndarray, groups: int) -> pa.RecordBatch:
    """One row per target group: 40 bits of each signature, 16 bits of set number and flags, and the sets' classes."""
    group = (sig >> np.uint64(40)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    group, sig = group[order], sig[order]
    tag = (who[order] | flags[order]).astype("<u2")
    low = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(cut[1:], len(group))
    names = cls.astype("<i8")
    sigs, tags, owners = [], [], []
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        local, back = np.unique(tag[a:b] & _LOCAL, return_inverse=True)
        sigs.append(low[a:b].tobytes())
        tags.append(((tag[a:b] & ~np.uint16(_LOCAL)) | back.astype("<u2")).astype("<u2").tobytes())
        owners.append(names[local].tobytes())
    return pa.record_batch(
        [pa.array(group[cut].astype(np.int32)), pa.array(sigs, pa.binary()), pa.array(tags, pa.binary()), pa.array(owners, pa.binary())],
        names=["g", "sigs", "tags", "owners"],
    )


def index(docs: DataFrame, bands: list[Band], groups: int, t: tuple[int, int], width: int = WIDTH) -> DataFrame:
    """Packed signatures of all sets by target group; equal sets of one task are sent once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owners: list[int] = []
        entries = 0
        for batch in slices(batches):
            sets = []
            for s in shingle_sets(batch.column("text"), width):
                if len(s) and (c := digest(s)) not in seen:
                    seen.add(c)
                    sets.append((c, s))
            if len(owners) + len(sets) > _LOCAL or entries > FLUSH_ENTRIES:
                if held:
                    yield _pack(*_joined(held, owners), groups)
                held, owners, entries = [], [], 0
            for i in range(0, len(sets), _LOCAL):
                part = sets[i : i + _LOCAL]
                if owners and len(owners) + len(part) > _LOCAL:
                    if held:
                        yield _pack(*_joined(held, owners), groups)
                    held, owners, entries = [], [], 0
                sig, who, flags = signatures([s for _, s in part], bands, t)
                if len(sig):
                    held.append((sig, who + len(owners), flags))
                    entries += len(sig)
                owners.extend(c for c, _ in part)
            if len(seen) > 1_000_000:  # only saves work: a set sent twice is merged later
                seen.clear()
        if held:
            yield _pack(*_joined(held, owners), groups)

    return docs.select("text").mapInArrow(run, "g int, sigs binary, tags binary, owners binary")


def _joined(held: list, owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sig, who, flags = (np.concatenate(c) for c in zip(*held, strict=True))
    return sig, np.array(owners, np.int64), who, flags


def stars(group: pa.Table) -> pa.Table:
    """Candidate pairs ``(centre, other)`` of one group of signatures.

    A bucket is a run of equal signatures with at least one look-up and one whole subset; its centre is the set that
    meets most others in this group.
    """
    sigs, flags, cls = [], [], []
    for s, g, o in zip(*[group.column(c).to_pylist() for c in ("sigs", "tags", "owners")], strict=True):
        wide = np.zeros((len(s) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(s, np.uint8).reshape(-1, 5)
        tag = np.frombuffer(g, "<u2")
        sigs.append(wide.view("<u8").ravel())
        flags.append(tag & ~np.uint16(_LOCAL))
        cls.append(np.frombuffer(o, "<i8")[tag & _LOCAL])
    sig, flag, who = np.concatenate(sigs), np.concatenate(flags), np.concatenate(cls)
    order = np.argsort(sig, kind="stable")
    sig, flag, who = sig[order], flag[order], who[order]
    same = sig[1:] == sig[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    sig, flag, who = sig[many], flag[many], who[many]
    pair = np.zeros((0, 2), np.int64)
    if len(sig):
        order = np.lexsort((who, sig))
        sig, flag, who = sig[order], flag[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])]))
        flag = np.bitwise_or.reduceat(flag, first)
        sig, who = sig[first], who[first]
        run = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(run, len(sig)))
        good = (size > 1) & (np.bitwise_or.reduceat(flag, run) == (_PROBE | _EXACT))
        who, size = who[np.repeat(good, size)], size[good]
        if len(who):
            pair = _centred(who, size)
    return pa.table({"a": pair[:, 0], "b": pair[:, 1]})


def _centred(who: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct pairs of each bucket's centre and its other members; ``who`` lists the buckets' members."""
    _, back = np.unique(who, return_inverse=True)
    meets = np.bincount(back, weights=np.repeat(size - 1, size))[back]
    run = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((who, -meets, run))
    centre = who[order][np.cumsum(size) - size]
    pair = np.stack([centre[run], who], axis=1)
    pair = pair[pair[:, 0] != pair[:, 1]]
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    return pair[np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])]


def similar(a: int, b: int, both: int, t: tuple[int, int]) -> bool:
    return t[1] * both >= t[0] * (a + b - both)


def _bounded(pairs: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs ``(a, b)`` of classes with ``maybe``: neither sizes nor counters exclude similarity."""
    left = nodes.select(F.col("class").alias("a"), F.col("n_shingles").alias("na"), F.col("counts").alias("ca"))
    right = nodes.select(F.col("class").alias("b"), F.col("n_shingles").alias("nb"), F.col("counts").alias("cb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = t[1] * np.minimum(na, nb) >= t[0] * np.maximum(na, nb)
            ca, cb = batch.column("ca"), batch.column("cb")
            for i in np.flatnonzero(ok).tolist():
                x, y = folded([ca[i].as_py(), cb[i].as_py()])
                ok[i] = np.abs(x - y).sum() <= differing(na[i] + nb[i], t)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "maybe"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long, maybe boolean")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, t: tuple[int, int], width: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes with ``linked``, computed from whole texts."""
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    place = used.join(nodes.select("class", "doc"), "class").select(F.col("doc").alias("__doc"), "class")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(place, F.col("doc_id") == F.col("__doc")).select("class", "text")
    texts = stage(texts, "texts")
    rows = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            yes = [
                similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), t)
                for x, y in zip(shingle_sets(batch.column("ta"), width), shingle_sets(batch.column("tb"), width), strict=True)
            ]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "linked"])

    checked = rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _rest(tried: DataFrame, missed: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs that the stars leave open: of the sets that met a centre, those that are not connected with it
    (``missed``) against the others with another ``label``.

    The sets that met a centre are dealt to blocks, the missed ones go to every block.
    """
    pairs = tried.join(missed.select("a").distinct(), "a", "left_semi")
    blocks = pairs.groupBy(F.col("a").alias("ba")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    flags = missed.select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    pairs = pairs.join(blocks, F.col("a") == F.col("ba")).join(flags, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
    facts = nodes.select(F.col("class").alias("c"), "n_shingles", "counts", "label")
    home = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    places = F.when(F.col("fb").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    dealt = pairs.select(F.col("a").alias("centre"), F.col("b").alias("c"), F.col("fb").isNotNull().alias("missed"), home.alias("home"), F.explode(places).alias("block"))

    def run(group: pa.Table) -> pa.Table:
        names = ("c", "n_shingles", "label", "missed", "home", "block")
        cls, n, label, open_, home, block = (group.column(c).to_numpy(zero_copy_only=False) for c in names)
        counts = folded(group.column("counts").to_pylist())
        there = np.flatnonzero(home == block)
        found = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(open_):
            ok = there[(t[1] * np.minimum(n[i], n[there]) >= t[0] * np.maximum(n[i], n[there])) & (label[there] != label[i])]
            for j in range(0, len(ok), 1000):
                some = ok[j : j + 1000]
                some = some[np.abs(counts[some] - counts[i]).sum(axis=1) <= differing(n[some] + n[i], t)]
                found.append(np.stack([np.minimum(cls[some], cls[i]), np.maximum(cls[some], cls[i])], axis=1))
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return dealt.join(facts, "c").groupBy("centre", "block").applyInArrow(run, "a long, b long").distinct()


def labels(docs: DataFrame, described: DataFrame, t: tuple[int, int] = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``(class, label)``: the same label exactly for classes that links of similarity ``t`` connect."""
    sized = described.where("class is not null and doc_id is not null")
    facts = [F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"), F.min("doc_id").alias("doc")]
    nodes = stage(sized.groupBy("class").agg(*facts), "classes")
    bands, groups = _layout(nodes, t)
    docs = docs.where(F.col("doc_id").isNotNull())
    met = index(docs, bands, groups, t, width).groupBy("g").applyInArrow(stars, "a long, b long").distinct()
    tried = stage(_bounded(met, nodes, t), "tried")
    first = stage(_verify(tried.where("maybe").select("a", "b"), docs, nodes, t, width), "verified")
    nodes = stage(_labelled(nodes, connected(first.where("linked"))), "labelled")
    missed = tried.where("not maybe").select("a", "b").unionByName(first.where("not linked").select("a", "b"))
    own = nodes.select(F.col("class").alias("a"), F.col("label").alias("la"))
    other = nodes.select(F.col("class").alias("b"), F.col("label").alias("lb"))
    missed = missed.join(own, "a").join(other, "b").where("la <> lb").select("a", "b")
    known = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    open_ = _rest(tried, missed, nodes, t)
    open_ = stage(open_.join(known, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), "open")
    second = _verify(open_, docs, nodes, t, width).where("linked").join(own, "a").join(other, "b")
    joined = connected(second, "la", "lb").select(F.col("node").alias("old"), F.col("label").alias("new"))
    return nodes.join(joined, F.col("label") == F.col("old"), "left").select("class", F.coalesce("new", "label").alias("label"))


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, F.col("class") == F.col("node"), "left").select(*nodes.columns, F.coalesce("label", "class").alias("label"))


def _layout(nodes: DataFrame, t: tuple[int, int]) -> tuple[list[Band], int]:
    """Band layouts from the sizes of all sets, and the number of groups their signatures are dealt to."""
    largest = nodes.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(largest, t)
    number = F.lit(len(edges))
    for k, (_, hi) in reversed(list(enumerate(edges))):
        number = F.when(F.col("n_shingles") <= hi, F.lit(k)).otherwise(number)
    sizes = {r[0]: r[1] for r in nodes.groupBy(number.alias("k")).count().collect()}
    bands = plan_bands(sizes, largest, t)
    each = [b.m + 2 * b.g * b.top / max(1, b.m) for b in bands]
    entries = sum((sizes.get(k, 0) + sizes.get(k + 1, 0)) * e for k, e in enumerate(each))
    return bands, max(1, math.ceil(entries / GROUP_ENTRIES))


def components(docs: DataFrame, t: tuple[int, int] = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, class, component_id)`` per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stage(describe(docs, width), "described")
    label = labels(docs, described, t, width).select(F.col("class").alias("c"), "label")
    rows = described.select("doc_id", "n_shingles", "class").join(label, F.col("class") == F.col("c"), "left")
    least = rows.where("label is not null").groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("least"))
    return rows.join(least, F.col("label") == F.col("l"), "left").select(
        "doc_id", "n_shingles", "class", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, t: tuple[int, int] = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest ``doc_id``."""
    out = components(docs, t, width).where("component_id < doc_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(out, docs["doc_id"] == out["__drop"], "left_anti")
