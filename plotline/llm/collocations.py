"""Collocations: phrases of two to five words that stand together more often than their parts suggest.

Texts become chunks of word numbers, and adjacent numbers are counted as pairs.  Frequent words get ids in the order of their
frequency, so a pair is a cell of a square and frequent pairs lie near its corner.  The square is cut into tiles of
``TILE`` by ``TILE`` cells; a chunk counts a tile with many pairs by direct addressing (``numpy.bincount`` over all its
cells) and a tile with few as a sorted coordinate list.  Frequent pairs are ranked in turn, and their ids replace the words: two
pairs that overlap in a word are a phrase of three, and so on, so a longer phrase is always a pair of ids.

Distribution: a chunk holds some hundred kilobytes of text of one language (rows of megabytes fragment the heap) and is the unit of all tasks.  A task adds up the pairs of
its chunks, tile by tile, and Spark adds up the tasks, so the hottest pair is a row per task.  Ids return to the chunks
in two parts: those of the ``HEAD`` most frequent pairs, a fixed number, go to every task; all others meet the chunks that have
them in a join, whose keys are no hot ones.  Words return by the join alone.  Ranks come from range partitions.

Defined cases: NULL text is empty; NULL language is ``und``; NULL ids and repeated rows are ordinary documents, each counted;
other columns are ignored; an empty table, or one without frequent phrases, gives no rows.  A word is any run without space,
tab and the delimiters, whatever its length; words are compared as bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plotline.llm.spread import join_per_key, ranked
from plotline.session import stage

LEAST = 100
LONGEST = 5
TOP = 2000
TILE = 1024
CHUNK_BYTES = 640 << 10
# The most frequent words or pairs of a level, over all languages, whose ids go to every task; of words, those up to ``_SHORT`` bytes.
HEAD = 1 << 19
_SHORT = 64
_ID_BITS = 31
_SALTS = 64

_DELIMITERS = b".,;:!?\x0a\x0b\x0c\x0d"
_NORMAL = bytes.maketrans(_DELIMITERS + b"\t" + bytes(range(65, 91)), b"\n" * len(_DELIMITERS) + b" " + bytes(range(97, 123)))
_BREAK = b"\n"
_BREAK_ID = -1


def tokens(data: bytes) -> list[bytes]:
    """Lower-case words in order, with ``_BREAK`` wherever a phrase ends."""
    return [w for w in data.translate(_NORMAL).replace(_BREAK, b" \n ").split(b" ") if w]


class _Chunk:
    """Word numbers of the texts of one language, filled until it is large."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        words = tokens(data)
        for w in set(words):
            self.number.setdefault(w, len(self.number))
        words.append(_BREAK)
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(data) + 1

    def rows(self) -> tuple[bytes, list[bytes], np.ndarray]:
        """The numbers, the words from number 1 on, and how often each occurs."""
        seq = np.concatenate(self.parts)
        return seq.tobytes(), list(self.number)[1:], np.bincount(seq, minlength=len(self.number))[1:]


def pieces_of(data: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end at a delimiter, where there is one."""
    at = 0
    while len(data) - at > limit:
        cut = max(data.rfind(bytes([d]), at, at + limit) for d in _DELIMITERS)
        if cut < 0:
            cut = min((p for d in _DELIMITERS if (p := data.find(bytes([d]), at + limit)) >= 0), default=len(data) - 1)
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


def _chunks(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Chunk] = {}
        task, made = TaskContext.get().partitionId(), 0

        def row(lang: str, c: _Chunk) -> pa.RecordBatch:
            nonlocal made
            made += 1
            seq, words, counts = c.rows()
            return pa.record_batch(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([lang]), pa.array([seq], pa.binary()),
                 pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                names=["chunk", "lang", "seq", "codes", "counts"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for part in pieces_of(data, limit):
                    c = open_.setdefault(lang, _Chunk())
                    c.add(part)
                    if c.size >= limit:
                        yield row(lang, open_.pop(lang))
        for lang, c in open_.items():
            yield row(lang, c)

    return run


def chunks(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, lang, seq, codes, counts)``: word numbers, distinct words and their counts, a row per chunk and language."""
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(_chunks(limit), "chunk long, lang string, seq binary, codes array<string>, counts array<long>")


def count_tiles(left: np.ndarray, right: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as ``left << 31 | right`` and their counts, tile by tile.

    A tile with at least one pair for 16 of its cells is counted by direct addressing, the others together as a sorted list.
    """
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = int(max(left.max(), right.max())) // tile + 1
    names, where, sizes = np.unique((left // tile) * side + right // tile, return_inverse=True, return_counts=True)
    dense = sizes * 16 >= tile * tile
    codes, counts = [], []
    for t in np.flatnonzero(dense).tolist():
        a0, b0 = (int(names[t]) // side) * tile, (int(names[t]) % side) * tile
        here = where == t
        cells = np.bincount((left[here] - a0) * tile + (right[here] - b0), minlength=tile * tile)
        met = np.flatnonzero(cells)
        codes.append(((a0 + met // tile) << _ID_BITS) | (b0 + met % tile))
        counts.append(cells[met])
    rest = ~dense[where]
    code, n = np.unique((left[rest] << _ID_BITS) | right[rest], return_counts=True)
    codes.append(code)
    counts.append(n)
    return np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(np.int64)


_LEVEL = "chunk long, lang string, seq binary"
_COUNTS = "lang string, bucket int, pairs binary"
# Pairs of a task that are held before they are handed on; places of the input for each bucket of pairs.
_HELD = 1 << 20
_PER_BUCKET = 1 << 20


def pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes and their counts, first bytes first: most of the others are zero, and Spark compresses what it shuffles."""
    steps = np.diff(codes, prepend=0).astype("<i8")
    return np.concatenate([x.view(np.uint8).reshape(-1, 8).T.ravel() for x in (steps, counts.astype("<i8"))]).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = (np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel() for x in np.split(np.frombuffer(data, np.uint8), 2))
    return np.cumsum(steps), counts


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts."""
    every, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every)
    every, n = every[order], n[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _codes(seq: np.ndarray) -> np.ndarray:
    """The pair that begins at each place, -1 where a phrase ends."""
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), (a << _ID_BITS) | b, -1)


def _count_pairs(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_COUNTS`` of the chunks of a task: the pairs of a language by buckets of their codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = _added(*zip(*parts, strict=True))
                of = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(of, kind="stable")
                met, starts = np.unique(of[order], return_index=True)
                rows = [pack(codes[x], n[x]) for x in np.split(order, starts[1:])] if len(met) else []
                yield pa.record_batch([pa.array([lang] * len(rows), pa.string()), pa.array(met, pa.int32()), pa.array(rows, pa.binary())], names=["lang", "bucket", "pairs"])
            held.clear()

        for batch in batches:
            for lang, seq in zip(batch.column("lang").to_pylist(), batch.column("seq"), strict=True):
                ids = np.frombuffer(seq.as_buffer(), np.int32)
                a, b = ids[:-1], ids[1:]
                both = (a >= 0) & (b >= 0)
                codes, counts = count_tiles(a[both].astype(np.int64), b[both].astype(np.int64))
                held.setdefault(lang, []).append((codes, counts))
                size += len(codes)
                if size > _HELD:
                    yield from summed()
                    size = 0
        yield from summed()

    return run


def _add_pairs(least: int) -> Callable[[pa.Table], pa.Table]:
    """``(lang, code, a)`` of the pairs of a bucket that occur ``least`` times."""

    def run(rows: pa.Table) -> pa.Table:
        codes, n = _added(*zip(*(unpack(x.as_py()) for x in rows["pairs"]), strict=True))
        codes, n = codes[n >= least], n[n >= least]
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(codes), pa.string()), "code": pa.array(codes, pa.int64()), "a": pa.array(n, pa.int64())})

    return run


def pair_counts(level: DataFrame, least: int, places: int) -> DataFrame:
    """``(lang, code, a)``: the pairs of all chunks that occur ``least`` times.

    There are as many buckets as keep one at ``_PER_BUCKET`` different pairs, as no language has more pairs than places.
    """
    rows = level.mapInArrow(_count_pairs(max(1, -(-places // _PER_BUCKET))), _COUNTS)
    return rows.groupBy("lang", "bucket").applyInArrow(_add_pairs(least), "lang string, code long, a long")


def in_pairs(ids: np.ndarray) -> np.ndarray:
    """The places that have a neighbour to pair with; one break stands for all that lies between two runs of them."""
    named = ids >= 0
    both = named[:-1] & named[1:]
    keep = np.zeros(len(ids), bool)
    keep[:-1] |= both
    keep[1:] |= both
    # What follows a run is never named, else it would belong to it.
    keep[np.flatnonzero(keep[:-1] & ~keep[1:]) + 1] = True
    return ids[keep]


WordHead = dict[str, tuple[pa.Array, np.ndarray]]


def _word_ids(words: pa.Array, known: tuple[pa.Array, np.ndarray] | None) -> np.ndarray:
    """Ids of words; -1 for the others."""
    if known is None or not len(words):
        return np.full(len(words), _BREAK_ID, np.int32)
    spot = pc.fill_null(pc.index_in(words, value_set=known[0]), -1).to_numpy(zero_copy_only=False)
    return np.where(spot >= 0, known[1][spot], _BREAK_ID).astype(np.int32)


def _words_by_head(head: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Local word numbers become ids, if the word is one of the most frequent; others and breaks end a phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, seq, words in zip(*(batch.column(c) for c in ("chunk", "lang", "seq", "codes")), strict=True):
                ids = _word_ids(words.values, head.value.get(lang.as_py()))
                ids = np.concatenate([np.full(1, _BREAK_ID, np.int32), ids])[np.frombuffer(seq.as_buffer(), np.int32)]
                yield from _chunk_row(chunk.as_py(), lang.as_py(), ids).to_batches()

    return run


def _other_words(head: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(of, lang, local, code)`` of the words of each chunk that are not among the most frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, words in zip(*(batch.column(c) for c in ("chunk", "lang", "codes")), strict=True):
                local = np.flatnonzero(_word_ids(words.values, head.value.get(lang.as_py())) < 0)
                n = len(local)
                yield pa.record_batch(
                    [pa.array([chunk.as_py()] * n, pa.int64()), pa.array([lang.as_py()] * n, pa.string()), pa.array(local, pa.int64()), words.values.take(pa.array(local))],
                    names=["of", "lang", "local", "code"],
                )

    return run


def _words_by_both(head: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As :func:`_words_by_head`, with the ids of the chunk's other frequent words from a join."""

    def run(level: pa.Table, known: pa.Table) -> pa.Table:
        if not len(level):
            return level.select(["chunk", "lang", "seq"])
        lang = level["lang"][0].as_py()
        ids = np.concatenate([np.full(1, _BREAK_ID, np.int32), _word_ids(level["codes"][0].values, head.value.get(lang))])
        ids[known["local"].to_numpy() + 1] = known["id"].to_numpy()
        return _chunk_row(level["chunk"][0].as_py(), lang, ids[np.frombuffer(level["seq"][0].as_buffer(), np.int32)])

    return run


def _chunk_row(chunk: int, lang: str, ids: np.ndarray) -> pa.Table:
    """A row of the next level, which holds only what can be part of a pair; no row without pairs.

    A task's rows go to Python as one batch, and the longer the phrases, the fewer places have an id.
    """
    ids = in_pairs(ids.astype(np.int32))
    rows = 1 if len(ids) else 0
    return pa.table({"chunk": pa.array([chunk] * rows, pa.int64()), "lang": pa.array([lang] * rows, pa.string()), "seq": pa.array([ids.tobytes()] * rows, pa.binary())})


Head = dict[str, tuple[np.ndarray, np.ndarray]]


def _look_up(codes: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Ids of codes by a sorted list of them; -1 for the others."""
    if known is None or not len(known[0]):
        return np.full(len(codes), _BREAK_ID, np.int32)
    spot = np.minimum(np.searchsorted(known[0], codes), len(known[0]) - 1)
    return np.where(known[0][spot] == codes, known[1][spot], _BREAK_ID).astype(np.int32)


def _by_head(head: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each place gets the id of the pair that begins there, if it is one of the most frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, seq in zip(*(batch.column(c) for c in ("chunk", "lang", "seq")), strict=True):
                ids = _look_up(_codes(np.frombuffer(seq.as_buffer(), np.int32)), head.value.get(lang.as_py()))
                yield from _chunk_row(chunk.as_py(), lang.as_py(), ids).to_batches()

    return run


def _other_pairs(head: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(chunk, lang, code)`` of the distinct pairs of each chunk that are not among the most frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, seq in zip(*(batch.column(c) for c in ("chunk", "lang", "seq")), strict=True):
                codes = np.unique(_codes(np.frombuffer(seq.as_buffer(), np.int32)))
                codes = codes[(codes >= 0) & (_look_up(codes, head.value.get(lang.as_py())) < 0)]
                for at in range(0, len(codes), 100_000):
                    some = codes[at : at + 100_000]
                    yield pa.record_batch(
                        [pa.array([chunk.as_py()] * len(some), pa.int64()), pa.array([lang.as_py()] * len(some)), pa.array(some)], names=["of", "lang", "code"]
                    )

    return run


def _by_both(head: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As :func:`_by_head`, with the ids of the chunk's other frequent pairs from a join."""

    def run(level: pa.Table, known: pa.Table) -> pa.Table:
        if not len(level):
            return level
        codes = _codes(np.frombuffer(level["seq"][0].as_buffer(), np.int32))
        ids = _look_up(codes, head.value.get(level["lang"][0].as_py()))
        order = np.argsort(known["code"].to_numpy())
        rest = _look_up(codes, (known["code"].to_numpy()[order], known["id"].to_numpy()[order]))
        return _chunk_row(level["chunk"][0].as_py(), level["lang"][0].as_py(), np.maximum(ids, rest))

    return run


def _ids(frequent: DataFrame) -> DataFrame:
    """``(lang, code, a, id)``: what is frequent in a language, numbered from the most frequent on."""
    out = ranked(stage(frequent, "frequent"), "lang", [F.col("a").desc(), F.col("code").asc()], "id", "__n").drop("__n")
    return stage(out.withColumn("id", F.when(F.col("id") < (1 << _ID_BITS), F.col("id")).otherwise(F.raise_error(F.lit("too many phrases")))), "phrase_ids")


def _first(ids: DataFrame, most: int) -> pa.Table:
    """``(lang, code, id)`` of the most frequent."""
    return ids.orderBy(F.col("a").desc(), "lang", "id").limit(most).select("lang", "code", "id").toArrow()


def _named_words(level: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Chunks of word ids from chunks of local numbers."""
    first = _first(ids.where(F.octet_length("code") <= _SHORT), most)
    langs, codes, names = first["lang"].to_pandas(), first["code"].combine_chunks(), first["id"].to_numpy()
    head: WordHead = {lang: (codes.take(pa.array(at)), names[at].astype(np.int32)) for lang, at in langs.groupby(langs).indices.items()}
    sent = level.sparkSession.sparkContext.broadcast(head)
    rows = level.select("chunk", "lang", "seq", "codes")
    if len(first) == ids.count():
        return stage(rows.mapInArrow(_words_by_head(sent), _LEVEL), "word_ids")
    other = rows.mapInArrow(_other_words(sent), "of long, lang string, local long, code string")
    known = other.join(ids.select("lang", "code", "id"), ["lang", "code"]).select("of", "local", "id")
    return stage(rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_words_by_both(sent), _LEVEL), "word_ids")


def _named_pairs(level: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Chunks whose places are named by the frequent pair that begins there."""
    first = _first(ids, most)
    langs, codes, names = first["lang"].to_pandas(), first["code"].to_numpy(), first["id"].to_numpy()
    head: Head = {}
    for lang, at in langs.groupby(langs).groups.items():
        order = at.to_numpy()[np.argsort(codes[at])]
        head[lang] = codes[order], names[order].astype(np.int32)
    sent = level.sparkSession.sparkContext.broadcast(head)
    if len(first) < most:
        return stage(level.mapInArrow(_by_head(sent), _LEVEL), "pair_ids")
    other = level.mapInArrow(_other_pairs(sent), "of long, lang string, code long")
    known = other.join(ids.select("lang", "code", "id"), ["lang", "code"]).select("of", "code", "id")
    return stage(level.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_by_both(sent), _LEVEL), "pair_ids")


def phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = CHUNK_BYTES, head: int = HEAD
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times, and the number of words per language.

    ``(lang, size, id, words, a, heads, tails, longer)``: ``heads`` are the counts of the phrase's first 1, 2 ... words,
    ``tails`` those of what follows, ``longer`` the count of the most frequent phrase that has one word more.
    """
    level = stage(chunks(docs, limit), "chunks")
    totals = stage(level.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "word_totals")
    words = level.select("lang", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n"))))
    ids = _ids(words.groupBy("lang", "code").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    places = totals.agg(F.max("n")).first()[0] or 0
    none = F.array().cast("array<long>")
    found = [ids.select("lang", "id", F.array("code").alias("words"), "a", none.alias("heads"), none.alias("tails"))]
    for size in range(2, longest + 1):
        level = (_named_words if size == 2 else _named_pairs)(level, ids, head)
        ids = _ids(pair_counts(level, least, places))
        pairs = ids.select(
            "lang", "id", "a", F.shiftright("code", _ID_BITS).alias("left"), F.col("code").bitwiseAND((1 << _ID_BITS) - 1).alias("right")
        )
        pairs = stage(pairs, "phrase_pairs")
        shorter = found[-1]
        front = shorter.select("lang", F.col("id").alias("left"), F.col("words").alias("w1"), F.concat("heads", F.array("a")).alias("heads"))
        back = shorter.select("lang", F.col("id").alias("right"), F.element_at("words", -1).alias("w2"), F.concat(F.array("a"), "tails").alias("tails"))
        both = stage(join_per_key(pairs, front, ["lang", "left"]), "phrase_heads")
        both = join_per_key(both, back, ["lang", "right"])
        found.append(stage(both.select("lang", "id", "left", "right", F.concat("w1", F.array("w2")).alias("words"), "a", "heads", "tails"), "phrases"))
    return _with_longer(found), totals


def _with_longer(found: list[DataFrame]) -> DataFrame:
    out = None
    for size, rows in enumerate(found, 1):
        rows = rows.select("lang", F.lit(size).alias("size"), "id", "words", "a", "heads", "tails")
        if size < len(found):
            above = found[size]
            sides = above.select("lang", F.col("left").alias("id"), "a").unionByName(above.select("lang", F.col("right").alias("id"), "a"))
            rows = rows.join(sides.groupBy("lang", "id").agg(F.max("a").alias("longer")), ["lang", "id"], "left")
        else:
            rows = rows.withColumn("longer", F.lit(None).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mine(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = 100,
    limit: int = CHUNK_BYTES, head: int = HEAD,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language (None: all).

    The score of a cut is ``1000 a n / (l r)``, rounded down; the lowest cut counts.  A phrase is left out if a longer one that
    holds it occurs at least ``share`` times in a hundred of its own occurrences.
    """
    rows, totals = phrases(docs, least, longest, limit, head)
    # A phrase that holds another and is as frequent implies one of one word more that is at least as frequent.
    rows = rows.where("size > 1").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rows = join_per_key(stage(rows, "candidates"), totals, ["lang"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    each = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "c"))
    each = each.select("lang", "phrase", "a", "n", "k", F.col("c.heads").alias("l"), F.col("c.tails").alias("r"))
    # Whole numbers of up to 38 digits; beyond, Spark refuses.
    over, under = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")
    each = each.withColumns({"__over": over, "__under": under}).withColumn("score", F.expr("__over div __under"))
    best = each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    out = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is None:
        return ranked(stage(out, "scored"), "lang", order, "rank", "__n").withColumn("rank", F.col("rank") + 1).drop("__n")
    near = out.withColumn("__s", F.pmod(F.hash("phrase"), F.lit(_SALTS)))
    near = near.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__s").orderBy(*order))).where(F.col("__r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return near.drop("__s", "__r").withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
