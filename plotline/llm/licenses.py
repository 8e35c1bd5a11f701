"""License scans by conditional compression and exact naming words.

Every place of some template's naming words is a candidate: the words around it are compressed with each template as a
zstandard raw dictionary, in a window as long as the template may be, and the templates are ranked by their savings, as shares of
what they save on themselves.  Those with at least the share ``CLOSE`` of the highest are confirmed by their wording, down to
the end of the ranking if none of them is.

A template is a wording of a license: a text, header, heading or notice, each one its own template (``license_texts`` has
the default table).  Its naming words, marked by braces (name, version, clauses), must be in the text as they are, next to
each other; as many words as the share ``DIFFERENCE`` of all may be missing, if that is not more than half of the other
words, and as many may be added in between.  Every place that confirms a template is reported with its span, wherever
its line breaks are: the naming words are looked up in the words of the whole document, and the words before, between
and behind them are aligned by longest common subsequences, so the smallest difference is found.  A wording between
``^`` and ``$`` is a heading and must be all the words of its line.  An SPDX line is read as an expression, a row per
license in it.  Of templates that claim the same naming words the one with more matching words is reported, then the one
that differs less, then the one that saves more on the passage itself.

Candidate blocks are runs of neighbouring lines that contain a cue word.  A block without a confirmed template is reported
with a NULL license and its closest template: it is cut into overlapping windows around its cues, long enough for the
longest template, the savings rank the templates of a window (of a license its texts of ``LONG`` words and its first
wording), and the ``RANKED`` that save most are compared word by word.  A saving decides nothing else: on a long text it
can be negative for a notice that is there word for word.

Blocks are judged where their document is read, so there is no shuffle and no state.

Defined cases: NULL and empty texts and those with neither a cue nor a confirmed template have no rows; ties in savings
and differences go to the alphabetically first name; a notice repeated in a document is reported at each place, repeated
rows each report theirs.  ``block`` is the confirmed passage, or the lines of an unconfirmed block; ``span_start`` and
``span_end`` are its characters in the document.  'licence' in a naming word is 'license'.  Extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from plotline.llm.license_texts import TEMPLATES
from plotline.llm.textops import slices

CUES = ("licens", "licenc", "copyright", "all rights reserved", "spdx", "warrant", "redistribut", "public domain")
RANKED = 3
LONG = 40
CLOSE = 0.5
DIFFERENCE = 0.2
LEVEL = 6
_CUE = re.compile("|".join(map(re.escape, CUES)), re.IGNORECASE)
_WORD = re.compile(r"\w+(?:\.\w+)*")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
_SPDX_PART = re.compile(r"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?)")

SCHEMA = (
    "doc_id long, first_line int, last_line int, block string, license string, saved_bytes int, block_bytes int, "
    "difference double, missing array<string>, added array<string>, span_start int, span_end int"
)


class Wording(NamedTuple):
    """A template: its plain text and words, the places of its naming words as ``[first, end)``, words not to be added."""

    license: str
    text: str
    words: tuple[str, ...]
    names: tuple[tuple[int, int], ...]
    heading: bool
    without: frozenset[str]


class Match(NamedTuple):
    """A confirmed template: characters and bytes of its passage, bytes saved, and what differs."""

    start: int
    end: int
    license: str
    saved: int
    size: int
    difference: float
    missing: list[str]
    added: list[str]


def _name(word: str) -> str:
    return word.replace("licenc", "licens")


def wordings(templates: Mapping[str, str | Sequence[str]]) -> list[Wording]:
    """The wordings of all licenses; each one marks its naming words by braces."""
    out = []
    for name in sorted(templates):
        given = templates[name]
        for text in [given] if isinstance(given, str) else given:
            without = frozenset(re.findall(r"~(\w+)", text.lower()))
            text = re.sub(r"\s*~\w+", "", text)
            heading = text.startswith("^") and text.endswith("$")
            plain = re.sub(r"[{}]", "", text[1:-1] if heading else text)
            words, names = [], []
            for i, part in enumerate(re.split(r"[{}]", text)):
                own = [_name(w) if i % 2 else w for w in _WORD.findall(part.lower())]
                if i % 2 and own:
                    names.append((len(words), len(words) + len(own)))
                words += own
            if not names:
                raise ValueError(f"no naming words in a wording of {name}: {plain[:60]}")
            out.append(Wording(name, plain, tuple(words), tuple(names), heading, without))
    return out


@lru_cache(maxsize=None)
def _compressor(template: str | None) -> zstandard.ZstdCompressor:
    extra = {}
    if template is not None:
        extra["dict_data"] = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, **extra)


def _with(block: str, template: str | None) -> int:
    return len(_compressor(template and template.lower()).compress(block.lower().encode()))


def saving(block: str, template: str) -> int:
    """Bytes the template saves; the fewer, the less the block has of it."""
    return _with(block, None) - _with(block, template)


def wording(block: str, template: str) -> tuple[float, list[str], list[str]]:
    """Share of the template's words that differ, its words missing in the block, and words added between the others."""
    own, want = (_WORD.findall(x.lower()) for x in (block, template))
    steps = difflib.SequenceMatcher(None, want, own, autojunk=False).get_opcodes()
    inner = [i for i, s in enumerate(steps) if s[0] == "equal"]
    missing, added = [], []
    for i, (kind, a, b, c, d) in enumerate(steps):
        if kind != "equal":
            missing += want[a:b]
            if inner and inner[0] < i < inner[-1]:  # text around the notice is not a difference
                added += own[c:d]
    return (max(len(missing), len(added)) / max(1, len(want)), missing, added)


def blocks(text: str | None) -> list[tuple[int, int, str]]:
    """Runs of neighbouring lines with a cue: first line, last line, text."""
    low = (text or "").lower()
    if not any(c in low for c in CUES):
        return []
    lines = text.split("\n")
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    for i, line in enumerate([*lines, ""]):
        if any(c in line.lower() for c in CUES):
            run.append(line)
        elif run:
            out.append((i - len(run), i - 1, "\n".join(run)))
            run = []
    return out


def windows(block: str, width: int) -> list[str]:
    """Overlapping pieces of a block; every cue has at least ``width`` words of one piece on either side."""
    words = list(_WORD.finditer(block))
    starts = [w.start() for w in words]
    out, centre = [], None
    for i in (bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(block)):
        if centre is None or i > centre + width:
            centre = i
            a, b = max(0, i - 2 * width), min(len(words), i + 2 * width + 1)
            out.append(block[words[a].start() : words[b - 1].end()])
    return out or [block]


def ranked(known: Sequence[Wording]) -> list[Wording]:
    """The wordings that name the closest license of an unconfirmed block."""
    return [w for i, w in enumerate(known) if len(w.words) >= LONG or not i or known[i - 1].license != w.license]


def nearest(block: str, known: Sequence[Wording], difference: float = DIFFERENCE) -> tuple[int, int, float, list[str], list[str]]:
    """Bytes saved, bytes of the window, difference, missing and added words of the closest ranked template."""
    width = max((len(w.words) for w in known), default=0)
    best = None
    for window in windows(block, width + int(difference * width)):
        alone = _with(window, None)
        ranks = sorted((_with(window, w.text) - alone, w.license, w.text) for w in known)
        for saved, _, text in ranks[:RANKED]:
            share, missing, added = wording(window, text)
            if best is None or share < best[2]:
                best = (-saved, len(window.encode()), share, missing, added)
    return best or (0, len(block.encode()), 1.0, [], [])


def _window(w: Wording) -> tuple[int, int]:
    """First word and end, from its first naming word, of the place that holds the template with all words it may have more."""
    slack = int(DIFFERENCE * len(w.words) + 1e-9)
    begin = -w.names[0][0] - slack
    return begin, begin + len(w.words) + 2 * slack


@lru_cache(maxsize=None)
def _whole(template: str) -> int:
    return max(1, saving(template, template))


def _by_window(known: Sequence[Wording]) -> dict[tuple[int, int], list[tuple[int, str, int]]]:
    """The templates by their windows: number, words without layout, and bytes saved on itself."""
    out: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
    for i, w in enumerate(known):
        plain = " ".join(w.words)
        out.setdefault(_window(w), []).append((i, plain, _whole(plain)))
    return out


def shares(words: Sequence[str], at: int, known: Mapping[tuple[int, int], Sequence[tuple[int, str, int]]], seen: dict) -> dict[int, float]:
    """Of each template the saving on its window around a word, as a share of its saving on itself.

    Layout and the spelling of 'license' do not count.  ``seen`` keeps the shares of windows that a text repeats.
    """
    out = {}
    for (begin, end), group in known.items():
        window = " ".join(words[max(0, at + begin) : at + end])
        key = (begin, end, window)
        if key not in seen:
            alone = _with(window, None)
            seen[key] = {i: (alone - _with(window, plain)) / whole for i, plain, whole in group}
        out |= seen[key]
    return out


def _common(want: Sequence[int], own: Sequence[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of all beginnings of ``want`` and ``own``."""
    out = np.zeros((len(want) + 1, len(own) + 1), np.int32)
    words = np.asarray(own, np.int64)
    for i, w in enumerate(want):
        row = out[i].copy()
        np.maximum(row[1:], out[i, :-1] + (words == w), out=row[1:])
        np.maximum.accumulate(row, out=out[i + 1])
    return out


def _pairs(want: Sequence[int], own: Sequence[int], table: np.ndarray, end: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of ``want`` and the first ``end`` of ``own``."""
    i, j, out = len(want), end, []
    while i and j:
        if want[i - 1] == own[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _align(want: list[int], names: Sequence[tuple[int, int]], own: list[int], first: int, lost: int, slack: int) -> tuple[int, int, list[tuple[int, int]]] | None:
    """First word, end and matching pairs of the closest place with the first name at ``first``.

    At most ``lost`` words are missing and ``slack`` added.
    """
    a, b = names[0]
    if own[first - a : first - a + len(want)] == want and first >= a:
        return first - a, first - a + len(want), [(i, first - a + i) for i in range(len(want))]
    head, left = want[:a][::-1], own[max(0, first - a - slack) : first][::-1]
    heads = _common(head, left)
    best: tuple[tuple[int, int], int, int, list[tuple[int, int]]] | None = None

    def ends(k: int, at: int, missing: int, added: int, inner: list[tuple[int, int]]) -> None:
        """``inner`` are the pairs up to name ``k``, which ends before word ``at``."""
        nonlocal best
        begin = names[k][1]
        if k + 1 < len(names):
            a, b = names[k + 1]
            part, size = want[begin:a], b - a
            reach = own[at : at + len(part) + slack - added]
            table = _common(part, reach)
            for gap in range(len(reach) + 1):
                if own[at + gap : at + gap + size] == want[a:b]:
                    same = int(table[len(part), gap])
                    m, n = missing + len(part) - same, added + gap - same
                    if m <= lost and n <= slack:
                        pairs = [(begin + i, at + j) for i, j in _pairs(part, reach, table, gap)]
                        ends(k + 1, at + gap + size, m, n, [*inner, *pairs, *((a + i, at + gap + i) for i in range(size))])
            return
        tail, right = want[begin:], own[at : at + len(want) - begin + slack]
        tails = _common(tail, right)
        i, j = np.arange(len(left) + 1)[:, None], np.arange(len(right) + 1)[None, :]
        same = heads[len(head)][:, None] + tails[len(tail)][None, :]
        gone, more = missing + len(head) + len(tail) - same, added + i + j - same
        over = 4 * (len(want) + slack + 1)
        worst = np.where((gone <= lost) & (more <= slack), np.maximum(gone, more), over)
        p, q = divmod(int((worst.astype(np.int64) * over + gone + more).argmin()), len(right) + 1)
        if worst[p, q] < over and (best is None or (int(worst[p, q]), int(gone[p, q] + more[p, q])) < best[0]):
            before = [(len(head) - 1 - x, first - 1 - y) for x, y in _pairs(head, left, heads, p)][::-1]
            behind = [(begin + x, at + y) for x, y in _pairs(tail, right, tails, q)]
            best = ((int(worst[p, q]), int(gone[p, q] + more[p, q])), first - p, at + q, [*before, *inner, *behind])

    ends(0, first + b - a, 0, 0, [(a + i, first + i) for i in range(b - a)])
    return best and best[1:]


def matches(text: str, known: Sequence[Wording], difference: float = DIFFERENCE, close: float = CLOSE) -> list[Match]:
    """Every confirmed template of a text, by place; with ``close`` below every share each template is confirmed that can be."""
    spans, words = [], []
    for m in _WORD.finditer(text):
        spans.append(m.span())
        words.append(m[0].lower())
    number: dict[str, int] = {}
    plain = [number.setdefault(w, len(number)) for w in words]
    own = [number.setdefault(_name(w), len(number)) if "licenc" in w else n for w, n in zip(words, plain, strict=True)]
    exact = own == plain
    place: dict[int, list[int]] = {}
    for i, n in enumerate(own):
        place.setdefault(n, []).append(i)

    # The templates by the places of their first naming words.
    places: dict[int, list[int]] = {}
    for k, w in enumerate(known):
        a, b = w.names[0]
        name = [number.get(x, -1) for x in w.words[a:b]]
        if -1 not in name:
            for first in place.get(name[0], []):
                if own[first : first + b - a] == name:
                    places.setdefault(first, []).append(k)
    mixed: dict[int, list[int]] = {}

    def confirm(k: int, first: int) -> tuple | None:
        w = known[k]
        slack = int(difference * len(w.words) + 1e-9)
        want = [number.get(x, -1) for x in w.words]
        named = {i for x, y in w.names for i in range(x, y)}
        if k not in mixed:
            mixed[k] = own if exact else _mixed(plain, own, want, named)
        at = _align(want, w.names, mixed[k], first, min(slack, (len(w.words) - len(named)) // 2), slack)
        if at is None or w.heading and not _whole_line(text, spans, at[0], at[1]):
            return None
        begin, end, pairs = at
        has = {i for i, _ in pairs}
        met = {j for _, j in pairs}
        missing = [x for i, x in enumerate(w.words) if i not in has]
        added = [words[j] for j in range(begin, end) if j not in met]
        if not w.without.isdisjoint(added):
            return None
        start, stop = spans[begin][0], spans[end - 1][1]
        stop += text[stop : stop + 1] == "."
        passage = text[start:stop]
        saved = saving(passage, w.text)
        size = len(passage.encode())
        row = Match(start, stop, w.license, saved, size, max(len(missing), len(added)) / len(w.words), missing, added)
        return -len(pairs), row.difference, -saved / size, w.license, row, met, {j for i, j in pairs if i in named}

    found, windowed = [], {}
    spelled = [_name(x) for x in words]
    windows_of = _by_window(known) if places else {}
    for first, there in places.items():
        share = shares(spelled, first, windows_of, windowed)
        least, some = close * max(share.values()), False
        for k in sorted(there, key=lambda k: (-share[k], k)):
            # The winners are confirmed; the others only until one is, where no winner is.
            if share[k] < least and some:
                break
            row = confirm(k, first)
            if row is not None:
                found.append(row)
                some = True

    out, taken = _expressions(text, {w.license.lower(): w.license for w in known}), set()
    for *_, row, met, claimed in sorted(found, key=lambda x: (*x[:4], x[4].start)):
        if not claimed & taken:
            taken |= met
            out.append(row)
    return sorted(out)


def _expressions(text: str, known: Mapping[str, str]) -> list[Match]:
    """The licenses of SPDX lines, an exception with its license; each has the span of its expression."""
    out = []
    for line in _SPDX.finditer(text):
        names, at, end, operand, depth = [], line.end(), line.end(), True, 0
        while (m := _SPDX_PART.match(text, at)) is not None:
            part, at = m[1], m.end()
            if operand and part == "(":
                depth += 1
            elif operand and part not in ("AND", "OR", "WITH", ")") and (part.lower() in known or re.search("[A-Z0-9]", part)):
                if names and names[-1].endswith(" WITH "):
                    names[-1] += part
                else:
                    names.append(known.get(part.lower(), part))
                operand, end = False, at
            elif not operand and part == ")" and depth:
                depth, end = depth - 1, at
            elif not operand and part in ("AND", "OR", "WITH"):
                operand = True
                if part == "WITH":
                    names[-1] += " WITH "
            else:
                break
        passage = text[line.start() : end]
        for name in dict.fromkeys(n.removesuffix(" WITH ") for n in names if n not in ("NONE", "NOASSERTION")):
            saved = saving(passage, f"SPDX-License-Identifier: {name}")
            out.append(Match(line.start(), end, name, saved, len(passage.encode()), 0.0, [], []))
    return out


def _mixed(plain: list[int], own: list[int], want: list[int], named: set[int]) -> list[int]:
    """The words as they are, but one spelling of 'license' where a naming word asks for it."""
    names = {want[i] for i in named}
    return [b if b in names else a for a, b in zip(plain, own, strict=True)]


def _whole_line(text: str, spans: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether the words from ``begin`` to ``end`` have their line for themselves."""
    before = begin == 0 or "\n" in text[spans[begin - 1][1] : spans[begin][0]]
    return before and (end == len(spans) or "\n" in text[spans[end - 1][1] : spans[end][0]])


def cueless(known: Sequence[Wording]) -> list[frozenset[str]]:
    """The naming words of the wordings whose naming words have no cue."""
    names = (frozenset(w.words[i] for a, b in w.names for i in range(a, b)) for w in known)
    return sorted({n for n in names if not any(_CUE.search(x) for x in n)}, key=sorted)


def worth_reading(text: str, names: Iterable[frozenset[str]]) -> bool:
    """Whether a text has a cue, or all naming words of a wording that needs none."""
    low = text.lower()
    if any(c in low for c in CUES):
        return True
    has: dict[str, bool] = {}
    return any(all(has[x] if x in has else has.setdefault(x, x in low) for x in n) for n in names)


def judge(text: str | None, known: Sequence[Wording], difference: float = DIFFERENCE, names: Sequence[frozenset[str]] | None = None) -> list[tuple]:
    """The rows of one text, without its name."""
    if not text or not worth_reading(text, cueless(known) if names is None else names):
        return []
    lines = [0] + [m.end() for m in re.finditer("\n", text)]
    out, covered = [], []
    for m in matches(text, known, difference):
        a, b = bisect_right(lines, m.start) - 1, bisect_right(lines, m.end - 1) - 1
        out.append((a, b, text[m.start : m.end], *m[2:], m.start, m.end))
        covered.append((a, b))
    reach, k = -1, 0
    close = ranked(known)
    for a, b, block in blocks(text):
        while k < len(covered) and covered[k][0] <= b:
            reach = max(reach, covered[k][1])
            k += 1
        if reach < a:
            out.append((a, b, block, None, *nearest(block, close, difference), lines[a], lines[a] + len(block)))
    return sorted(out, key=lambda r: r[-2:])


def scan(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] | DataFrame | None = None) -> DataFrame:
    """One row per confirmed template of every text, and one per candidate block without any (:data:`SCHEMA`).

    ``templates`` are the wordings by license, or a table ``(license, wording)``, instead of the default ones.
    """
    if isinstance(templates, DataFrame):
        table: dict[str, list[str]] = {}
        for name, text in templates.select("license", "wording").distinct().orderBy("license", "wording").collect():
            table.setdefault(name, []).append(text)
        templates = table
    known = wordings(TEMPLATES if templates is None else templates)
    free = cueless(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32, words = pa.int32(), pa.list_(pa.string())
        kinds = [pa.int64(), i32, i32, pa.string(), pa.string(), i32, i32, pa.float64(), words, words, i32, i32]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in slices(batches):
            rows = []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.extend((name, *row) for row in judge(text, known, names=free))
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
