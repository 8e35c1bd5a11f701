"""Byte-level BPE ids of Arrow text columns, one look-up per distinct word.

The pre-tokeniser's pattern splits a text into words that are encoded independently of each other.  The split is
computed on code-point arrays, words are named by a 64-bit hash, and only words that this worker has not met yet
go through the BPE itself.  The known words are bounded; when the table is full it starts anew.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from plotline.llm.textops import buffers, constants, mix, positions

# Fixed by the vocabulary: what the byte-level pre-tokeniser splits at.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
MAX_WORDS = 1_500_000


def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 < b:
                out[a:0xD800] = value
                out[0xE000 : b + 1] = value
            else:
                out[a : b + 1] = value
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others, in order, for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_starts(cp: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words begin in concatenated texts; ``edges`` are the texts' offsets, end included."""
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[edges] = True
    run = np.flatnonzero(first)  # run starts, n included
    text_edge = np.zeros(n + 1, bool)
    text_edge[edges] = True
    a, b = run[:-1], run[1:]
    begin = first.copy()

    # Space before something else in the same text: a last blank joins what follows, any other last space stands alone.
    inner = (kind[a] == SPACE) & ~text_edge[b]
    last = b[inner] - 1
    blank = cp[last] == 0x20
    begin[b[inner][blank]] = False
    begin[last] = True

    # An apostrophe that begins a word takes the contraction's letters with it.
    lone = a[(b - a == 1) & (kind[a] == OTHER) & (cp[a] == 0x27) & ~text_edge[b]]
    lone = lone[begin[lone] & (kind[np.minimum(lone + 1, n - 1)] == LETTER)]
    if len(lone):
        one = cp[lone + 1]
        two = np.where(lone + 2 < n, cp[np.minimum(lone + 2, n - 1)], 0)
        two = np.where(first[np.minimum(lone + 2, n)], 0, two)  # the letters end after one
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((lone[short], 2), (lone[long & ~short], 3)):
            begin[hit + 1] = False
            begin[hit + size] = True
    begin[n] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of texts under one byte-level BPE file, equal to those of its own library."""

    _SHARED: dict[str, Encoder] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in cls._SHARED:
            cls._SHARED[path] = cls(path)
        return cls._SHARED[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.whole = Tokenizer.from_file(path)  # for texts that spell a special token
        self.bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.kinds = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of known words
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, col: pa.Array, end_id: int) -> list[np.ndarray]:
        """Per text its ids as little-endian unsigned 32-bit numbers, with ``end_id`` behind them."""
        texts = col.to_pylist()
        apart = {i for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        flat = "".join(t for i, t in enumerate(texts) if t and i not in apart)
        sizes = [0 if i in apart else len(t or "") for i, t in enumerate(texts)]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        cp = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        out: list[np.ndarray] = []
        if len(cp):
            starts = word_starts(cp, self.kinds[cp], edges)
            length = np.diff(starts)
            code, names = pd.factorize(self._hash(cp, starts, length))
            where, many = self._look_up(names, code, starts, flat)
            size = many[code]
            ends = np.cumsum(size)
            base = where[code] - (ends - size)
            got = self.ids[np.repeat(base, size) + np.arange(int(ends[-1]))]
            cut = np.concatenate([[0], ends])[np.searchsorted(starts, edges)]
        else:
            got, cut = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for i in range(len(texts)):
            own = got[cut[i] : cut[i + 1]]
            if i in apart:
                own = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4")
            out.append(np.concatenate([own, tail]).astype("<u4", copy=False))
        return out

    @staticmethod
    def _hash(cp: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = starts[:-1]
        place = np.arange(len(cp)) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            value = (cp.astype(np.uint64) + np.uint64(1)) * positions(int(length.max()))[place]
            return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * constants(1, seed=5)[0])

    def _look_up(self, names: np.ndarray, code: np.ndarray, starts: np.ndarray, flat: str) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each distinct word; unknown words are encoded and kept."""
        if len(self.known) > MAX_WORDS:
            self._forget()
        spot = np.searchsorted(self.known, names)
        hit = spot < len(self.known)
        hit[hit] = self.known[spot[hit]] == names[hit]
        fresh = np.flatnonzero(~hit)
        where, many = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        where[hit], many[hit] = self.at[spot[hit]], self.size[spot[hit]]
        if len(fresh):
            example = np.zeros(len(names), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]  # the first word with each hash
            a, b = starts[example[fresh]].tolist(), starts[example[fresh] + 1].tolist()
            lists = [self.bpe.encode_ordinary(flat[x:y]) for x, y in zip(a, b, strict=True)]
            size = np.array([len(x) for x in lists], np.int32)
            new = np.array([i for x in lists for i in x], np.uint32)
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, new])
            where[fresh], many[fresh] = at, size
            known = np.concatenate([self.known, names[fresh]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
        return where, many


def text_bytes(col: pa.Array) -> int:
    return int(buffers(col)[1][-1])
