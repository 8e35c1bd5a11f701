"""Small cases: NULLs, empty tables, ties, repeated rows, clashing columns, brute force and round trips."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotline.llm import chat, decontaminate, fingerprints, jaccard, language, licenses, line_dedup, packing, quality, sampling, toxicity
from plotline.llm.queries import tokenizer_path
from plotline.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string"
TEXTS = ["", None, " \t\n", "one two", "One  TWO", "a b c d e f g h", "a b c d e f g h", "x " * 30_000, "word\n" * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, None, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h", None, "s", 1, None, None), (5, TEXTS[5], None, "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_tokens_equal_the_library():
    rnd = random.Random(3)
    parts = ["'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "\xa0", "a", "é", "1", "²", "!", "漢", "don't", " 's", "x'd", "<|endoftext|>", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["", None]
    lib = Tokenizer.from_file(tokenizer_path())
    got = Encoder(tokenizer_path()).encode(pa.array(texts), 0)
    assert [x.tolist() for x in got] == [lib.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_packing_round_trip(docs, empty):
    lib = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    seqs, own = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        if i != 5:  # a repeated row is packed twice
            assert [x for _, p, _ in sorted(own[i]) for x in p] == ids
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_plan_uses_combinations_without_cutting():
    lengths = np.array([700] * 50 + [324] * 50 + [300, 300, 424] * 10)
    pieces = packing.plan(lengths)
    assert len(pieces) == len(lengths) and max(p[3] for p in pieces) == 59


def test_jaccard_against_brute_force(spark, docs, empty):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None][: len(TEXTS)]
    for base in range(25):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 9, 14, 40, 120]))]
        for copy in range(rnd.randint(1, 12)):
            new = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                new[rnd.randrange(len(new))] = rnd.choice(vocabulary)
            rows.append((100 + base * 20 + copy, " ".join(new)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(table).collect()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.components(empty).count() == 0
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id is null").count() == 1


def test_fingerprints(spark, docs, empty):
    rows = fingerprints.compare_with_next(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[5] == prints[6] and prints[0] == prints[1] == prints[2] == ""
    order = sorted(texts, reverse=True)
    for r in rows:
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = fingerprints.edited_text(texts[r.doc_id], following)
        true = len(shingles(texts[r.doc_id]) & shingles(edited)) / max(1, len(shingles(texts[r.doc_id]) | shingles(edited)))
        assert r.n_chars == len(texts[r.doc_id]) and (not prints[r.doc_id] or abs(r.near_edited - true) < 0.15)
    assert fingerprints.compare_with_next(empty).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprints.compare_with_next(one).count() == 1


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    f = line_dedup.CuckooFilter.of(keys[:10_000])
    assert f.has(keys[:10_000]).all() and f.has(keys[10_000:]).mean() < 0.01
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.remove(keys[:5_000])
    assert f.has(keys[5_000:10_000]).all() and f.has(keys[:5_000]).mean() < 0.01
    assert not line_dedup.CuckooFilter(1).has(keys).any()


def test_line_state_can_be_undone(spark):
    first = spark.createDataFrame([(1, "a shared line here\nonly in one text"), (2, "A shared line here \nsomething else now"), (3, None)], "doc_id long, text string")
    more = spark.createDataFrame([(0, "a shared line here\nonly in one text"), (7, "brand new line here")], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    state = line_dedup.LineState(spark, shards=3)
    state.insert(first)
    counts, refs = rows(state.counts), rows(state.refs)
    assert rows(state.shared().select("docs", "first_doc")) == [(2, 1)]
    state.insert(more)
    assert rows(state.shared().select("docs", "first_doc")) == [(2, 0), (3, 0)]
    state.delete(more.select("doc_id"))
    assert (rows(state.counts), rows(state.refs)) == (counts, refs)
    state.delete(first.select("doc_id"))
    assert state.counts.count() == state.refs.count() == 0


def test_line_dedup_small(docs, empty):
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.doc_id: r.text for r in kept.collect()}[6] == ""  # its only line stays in document 5
    assert line_dedup.summary(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, "!!"), (4, "a b c d e f g")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_hits(docs, items).collect()}
    assert got[5].n_hit == 7 and got[5].items == ["1", "4"] and [tuple(x) for x in got[5].hit_chars] == [(0, 13)]
    assert got[0].n_words == 0 and got[7].n_hit == 0
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    assert decontaminate.summary(empty, items).count() == 0 and decontaminate.summary(docs, items.limit(0)).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_hits(docs, items, max_item_bytes=10)


def test_bounded_sample(spark, empty):
    """The smallest hashes of each group, whatever its size; repeated rows count once."""
    rows = [(i, "hot") for i in range(4000)] + [(i, "small") for i in range(5000, 5030)] + [(7000 + i % 3, "repeated") for i in range(6000)]
    rows += [(None, "hot"), (1, None), (5000, "hot")]
    table = spark.createDataFrame(rows, "doc_id long, lang string").repartition(5)
    got = sampling.bounded(table, "lang", 50).collect()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    want = defaultdict(list)
    for r in table.where("doc_id is not null and lang is not null").distinct().orderBy(share, "doc_id").collect():
        want[r.lang].append(r.doc_id)
    assert sorted(got) == sorted((i, g) for g, ids in want.items() for i in ids[:50])
    assert {g: len(ids[:50]) for g, ids in want.items()} == {"hot": 50, "small": 30, "repeated": 3}
    assert sampling.bounded(empty, "lang", 50).count() == 0


def test_language(spark, docs, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 5, "en" if i % 2 else "fr") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] in ("en", "fr")
    scores = model.lengths(["the dog and the cat", "le chien et le chat"])[0]
    assert scores.argmin(axis=1).tolist() == [0, 1]
    assert language.train(empty) is None and {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_languages_do_not_shorten_each_other(spark):
    docs = [(i, f"word{chr(97 + i % 26)} {chr(97 + i // 26)}x", f"l{i:03}") for i in range(420)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=1)
    assert model.languages == [d[2] for d in docs]
    rnd, texts = random.Random(2), {}
    texts["a"] = "".join(rnd.choice("abcdefghijkl ") for _ in range(9_000))
    texts["b"] = "".join(chr(rnd.randrange(0x100, 0x800)) for _ in range(300))
    counts = []
    for lang, text in texts.items():
        grams, n = language._grams(*language.normalised([text]), 3)
        counts += [(lang, g, int(c)) for g, c in zip(grams, n, strict=True)]
    both = language.build(counts, contexts=1_500)
    alone = language.build([c for c in counts if c[0] == "b"], contexts=1_500)
    probe = [texts["b"][:50], texts["a"][:50], "".join(map(chr, range(0x80, 0x800)))]
    assert (both.lengths(probe)[0][:, 1] == alone.lengths(probe)[0][:, 0]).all()
    assert len({int(s) for s in both.tables[1].symbol if s}) > 80


def test_code_lengths_are_exact():
    """The table against a walk down the contexts."""
    text = "abracadabra abrakadabra"
    data, offs = language.normalised([text])
    grams, n = language._grams(data, offs, 2)
    model = language.build([("x", g, int(c)) for g, c in zip(grams, n, strict=True)], order=2)
    follow = defaultdict(dict)
    for g, c in zip(grams, n.tolist(), strict=True):
        follow[g[:-1]][g[-1:]] = c
    total = 0.0
    padded = b"  " + text.encode()
    for i in range(2, len(padded)):
        for k in range(2, -1, -1):
            seen = follow.get(padded[i - k : i])
            if seen is None:
                continue
            all_, kinds = sum(seen.values()), len(seen)
            if padded[i : i + 1] in seen:
                total -= np.log2(seen[padded[i : i + 1]] / (all_ + kinds))
                break
            total -= np.log2(kinds / (all_ + kinds))
    assert abs(model.lengths([text])[0][0, 0] - total) < 1e-3


def test_toxicity_shares_spellings(docs, empty, spark):
    rnd = random.Random(2)
    clean = [" ".join(rnd.choice(["sun", "moon", "tree", "river", "cloud"]) + rnd.choice("abcde") for _ in range(40)) for _ in range(200)]
    texts = [t + (" you idiotic" + rnd.choice("abcd") + " fool") * (i % 2) for i, t in enumerate(clean)]
    model = toxicity.fit(texts, np.array([i % 2 for i in range(200)]))
    scores = model.scores([clean[1], clean[1] + " idioticz", clean[1] + " umbrella", texts[1], "", None])
    assert scores[1] > max(scores[0], scores[2]) and scores[0] < 0.5 < scores[3] and scores[4] == scores[5]
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.remove_toxic(docs, None).columns == docs.columns


def test_quality(docs, empty):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["sun", "moon", "tree", "river"]) for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(rnd.choice(["SUN!!", "MOON***", "TREE$$"]) for _ in range(60)) for _ in range(80)]
    x, y = quality.features(pa.array(good)), quality.features(pa.array(bad))
    model = quality.fit(x[:200], np.concatenate([x[200:], y[:40]]), 0.7)
    assert model.scores(x).min() > model.scores(y).max()
    got = quality.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    assert quality.score(empty, None).count() == 0


def test_licenses(spark, docs, empty):
    rows = [(1, "x\nReleased under the MIT License.\ny\nAll rights reserved"), (2, "This work is licenced under the GNU General Public License, version 2."), (3, "a warranty claim of the buyer")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_line, r.license) for r in got] == [(1, 1, "MIT"), (1, 3, "Proprietary"), (2, 0, "GPL-2.0"), (3, 0, None)]
    assert got[2].missing == ["licensed"] and got[2].added == ["licenced"]
    assert licenses.scan(docs).count() == licenses.scan(empty).count() == 0


def test_license_notice_in_a_long_line():
    rnd = random.Random(1)
    for size in (2_000, 40_000):
        filler = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(size)) for _ in range(2)]
        got = licenses.judge(f"{filler[0]} Released under the MIT License. {filler[1]}", licenses.wordings(licenses.TEMPLATES))
        assert [(r[3], r[6]) for r in got] == [("MIT", 0.0)] and got[0][2] == "Released under the MIT License."


def test_license_naming_words():
    known = licenses.wordings(licenses.TEMPLATES)
    for text in ("Licensed under CC BY-ND 2.0.", "Released under the BSD License.", "Released under the GPL License.",
                 "Licensed under the Apache License, Version 1.7.", "This work is licensed under the GNU Library General Public License, version 3."):
        assert [r[3] for r in licenses.judge(text, known)] == [None], text
    two = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    for text in (two, two.replace("\n", " ")):
        got = licenses.judge(text, known)
        assert [(r[3], text[r[-2] : r[-1]]) for r in got] == [("MIT", two.split("\n")[0]), ("Apache-2.0", two.split("\n")[1])]


def test_license_differences_are_the_smallest():
    rnd, tried = random.Random(5), 0
    for _ in range(300):
        want = [rnd.choice("abcd") for _ in range(rnd.randint(4, 9))]
        a = rnd.randrange(len(want) - 1)
        want[a : a + 2] = ["x", "y"]
        known = licenses.wordings({"L": " ".join([*want[:a], "{x y}", *want[a + 2 :]])})
        own = [w for w in want for w in ([w] if w in "xy" or rnd.random() < 0.8 else rnd.choice([[], [w, "e"], ["e"]]))]
        if "x y" not in " ".join(own):
            continue
        own = [rnd.choice("abcd") for _ in range(3)] + own + [rnd.choice("abcd") for _ in range(3)]
        at, cost = own.index("x"), 99
        for i in range(at + 1):  # brute force over all spans: longest common subsequences left and right of the name
            for j in range(at + 2, len(own) + 1):
                same = 2 + sum(int(licenses._common([ord(c) for c in p], [ord(c) for c in q])[-1, -1]) for p, q in ((want[:a], own[i:at]), (want[a + 2 :], own[at + 2 : j])))
                if len(want) - same <= (len(want) - 2) // 2:  # not more than half of the other words
                    cost = min(cost, max(len(want) - same, j - i - same))
        got = licenses.matches(" ".join(own), known, 0.4)
        assert [round(m.difference * len(want)) for m in got] == ([cost] if cost <= int(0.4 * len(want) + 1e-9) else [])
        tried += bool(got)
    assert tried > 100


def test_license_wordings(spark):
    known = licenses.wordings(licenses.TEMPLATES)
    for w in known:  # each wording alone names its license, headings included
        assert [m.license for m in licenses.matches(w.text, known)] == [w.license], w.text
    mit = next(w.text for w in known if w.license == "MIT" and len(w.words) > 150)
    lines = {
        "MIT License": ["MIT"], "SPDX-License-Identifier: MIT": ["MIT"], "Released under the BSD 3-Clause License.": ["BSD-3-Clause"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Zlib x": ["GPL-2.0-only WITH Classpath-exception-2.0", "MIT", "Zlib"],
        "This is the MIT License": [None], "see the SPDX-License-Identifier: line": [None], "Released under the AGPL version 3": ["AGPL-3.0"],
        "# " + mit.replace(" of ", "\n# of "): ["MIT"], mit.replace("sublicense", "sublicence and rent"): ["MIT"],
    }
    assert {t: [r[3] for r in licenses.judge(t, known)] for t in lines} == lines
    table = spark.createDataFrame([("Own", "Free for {all of my friends}."), ("Own", "My {own license}.")], "license string, wording string")
    docs = spark.createDataFrame([(1, "Now free for all of my friends. My own licence, released under the MIT License.")], "doc_id long, text string")
    assert [(r.license, r.block) for r in licenses.scan(docs, table).collect()] == [("Own", "free for all of my friends."), ("Own", "My own licence")]


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, None, "?"), (None, 0, "ann", "x"), (2, 0, "system", "s")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted({(r.conv_id, r.perspective) for r in got}, key=repr) == [(1, "ann"), (1, "bob"), (None, "ann")]
    for who in ("ann", "bob"):
        own = sorted((r for r in got if r.conv_id == 1 and r.perspective == who), key=lambda r: r.segment_start)
        text = "".join(r.segment for r in own)
        assert [text[r.loss_start : r.loss_end] for r in own if r.loss] == [("hi" if who == "ann" else "") + chat.END]
        assert all(text[r.segment_start :].startswith(r.segment) for r in own)


def test_license_savings_rank_the_templates(monkeypatch):
    known = licenses.wordings(licenses.TEMPLATES)
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    filler = " ".join(f"w{i % 977}" for i in range(400))
    texts = [t for t in docs if t and licenses.worth_reading(t, licenses.cueless(known))]
    texts += [f"{filler}\n{w.text}\n{filler}" for w in known[::7]]
    # Every template that can be confirmed against those that the savings put in front: none is lost.
    whole = [licenses.matches(t, known, close=float("-inf")) for t in texts]
    assert sum(map(len, whole)) >= 100
    tried, align = [], licenses._align
    monkeypatch.setattr(licenses, "_align", lambda *a: tried.append(1) or align(*a))
    assert [licenses.matches(t, known) for t in texts] == whole
    few = len(tried)
    tried.clear()
    assert [licenses.matches(t, known, close=float("-inf")) for t in texts] == whole and few < len(tried)
    # A saving that names the wrong templates changes which are confirmed first.
    asked = []
    monkeypatch.setattr(licenses, "_with", lambda block, template: asked.append(template) or len(block))
    licenses.matches("Released under the MIT License.", known)
    assert len(set(asked)) > len(known) // 2
