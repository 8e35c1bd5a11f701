"""Merkle manifest, URL filters and collocations against brute force, with NULLs, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotline.llm import collocations, merkle, redirects, spread
from plotline.llm.sampling import held_out
from plotline.session import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx string, phrase string, a string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    out = []
    for row in tree[:-1]:
        a = i - i % 8
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 8])))
        i //= 8
    return out


def manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    by_lang = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by_lang[r[2]].append((r[0], leaf(r, r[1]), leaf(r, lower(r[1])) if bad and r[1] is not None else leaf(r, r[1])))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by_lang[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in by_lang[g]])
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for i, (doc, d, shown) in enumerate(by_lang[g]):
            way = steps(trees[g], i) + steps(top, j)
            for a, b in way:
                shown = sha(a + shown + b)
            out.append((doc, d, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), shown, shown == top[-1][0]))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS)


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def corpus():
    rnd = random.Random(5)
    langs = [None, "", "é", "en", "zz"] + [f"l{i}" for i in range(70)]
    rows = [(i, rnd.choice(["Some Text", "", None, "é Ü A"]), "en" if i % 2 else rnd.choice(langs), rnd.choice([None, "s"]), i % 7 or None) for i in range(1500)]
    return rows + [rows[3]] * 40 + [(None, "A", "en", None, None), (7, "Other", "en", None, None)]


@pytest.mark.parametrize(("n", "levels"), [(0, 1), (1, 4), (9, 1), (1542, 1), (1542, 4)])
def test_manifest(spark, n, levels):
    rows = corpus()[-n:] if n else []
    got = merkle.manifest(docs_of(spark, rows), held_out(F.col("doc_id"), 3, 0), levels=levels)
    assert order(got.collect()) == order(manifest_by_hand(rows))


def test_manifest_witness_leads_to_the_root(spark):
    rows = merkle.manifest(docs_of(spark, corpus()), None, full=True).collect()
    assert all(r.verified and merkle.fold(r.leaf, [(s.left, s.right) for s in r.witness]) == r.root for r in rows)
    other = [(i, t if i != 11 else "changed", *x) for i, t, *x in corpus()]
    assert merkle.manifest(docs_of(spark, other)).first().root != rows[0].root


def test_frontier_attaches_witnesses_when_a_run_closes():
    tree = merkle.Frontier()
    nodes = [sha(str(i)) for i in range(70)]
    for i, d in enumerate(nodes):
        tree.append(d)
        assert len(tree.steps[0]) == (i + 1) // 8 * 8
    assert tree.finish(3) == levels(nodes)[-1][0]
    assert [tree.witness(i, 3) for i in range(70)] == [steps(levels(nodes), i) for i in range(70)]


def test_ranks_and_hot_joins(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, 1)] * 3 + [(f"k{i}", i) for i in range(50)]
    df = stage(spark.createDataFrame(rows, "g string, v long").withColumn("place", F.monotonically_increasing_id()), "t")
    got = spread.ranked(df, "g", [F.col("v").desc(), F.col("place")]).collect()
    assert sorted((r.idx, r.v, r.n) for r in got if r.g == "hot") == [(i, 2999 - i, 3000) for i in range(3000)]
    assert sorted((r.idx, r.n) for r in got if r.g is None) == [(0, 3), (1, 3), (2, 3)]
    table = spark.createDataFrame([("hot", "H"), ("k1", "K")], "g string, name string")
    assert Counter(r.name for r in spread.join_per_key(df, table, ["g"], "left").collect()) == {"H": 3000, "K": 1, None: 52}
    assert spread.join_per_key(df, table, ["g"]).count() == 3001


# --- URL filters ------------------------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string, host long, verdict string, a string"


def link(url, kind="canonical"):
    if kind == "canonical":
        return f"<html><head><LINK href='{url}' rel=\"Canonical\" ></head><p>x"
    return f'<meta content="0; URL=\'{url}\'" http-equiv=refresh><a href="/canonical">'


def judge_by_hand(pages, edges, rules=tuple(redirects.RULES)):
    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
        return lower(host), re.match(r"[^?#]*", tail)[0], re.match(r"[^#]*", tail)[0]

    def rule(host, path):
        fit = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[3:] if fit else (None, None)

    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    where = {}
    for a, b in edges:
        (h1, p1, t1), (h2, p2, t2) = parts(a), parts(b)
        where[h1 + t1], where[h2 + t2] = (h1, p1), (h2, p2)
        root[find(h1 + t1)] = find(h2 + t2)
    decided = defaultdict(set)
    for x, (h, p) in where.items():
        decided[find(x)].add(rule(h, p)[1])
    out = []
    for page, url, *_ in pages:
        host, path, tail = parts(url)
        name, verdict = rule(host, path)
        if not verdict:
            seen = decided[find(host + tail)] if host + tail in root else set()
            verdict = "block" if "block" in seen and "allow" not in seen else "allow"
        out.append((page, host, path, name, verdict))
    return out


def test_url_filters(spark):
    bad, worse, good = "https://x.example.org/es/1", "https://x.example.org/es/2", "http://www.example.org/fr/1"
    pages = [
        (1, "http://A.net/x?q=1#top", link(bad), 0, "", ""), (1, "http://A.net/x?q=1#top", link(bad), 0, "", ""),
        (2, "http://a.net/y", link("./x?q=1"), 0, "", ""), (3, "https://a.net/d/e/", link("../../x?q=1", "refresh"), 0, "", ""),
        (4, "http://b.net/1", link("//b.net/2"), 0, "", ""), (5, "http://b.net/2", link(good) + link("/3"), 0, "", ""), (6, "http://b.net/3", link(worse), 0, "", ""),
        (7, "http://c.net/1", "<!-- " + link(bad) + " -->", 0, "", ""), (8, "http://c.net/2", "<script>'" + link(bad) + "'</script >", 0, "", ""),
        (9, "http://c.net/3", "<link rel=canonical href=", 0, "", ""), (10, "http://c.net/4", link("mailto:a@" + "b"), 0, "", ""), (11, "http://c.net/5", link("#x"), 0, "", ""),
        (12, None, link(bad), 0, "", ""), (13, "no scheme", link(bad), 0, "", ""), (None, "http://d.net", None, 0, "", ""), (14, "", "", 0, "", ""),
        (15, "http://example.org/en/17", link("http://e.net/"), 0, "", ""), (16, "http://e.net/", "", 0, "", ""), (17, "http://sub.example.org/en/2", "", 0, "", ""),
        (18, "http://notorg/de/", "", 0, "", ""), (19, "http://x.com/fr", "", 0, "", ""), (20, "http://x.com/de/?a", "", 0, "", ""), (21, "http://f.net/1", "", 0, "", ""),
    ]
    chain = [(f"http://chain.net/{i}", f"http://chain.net/{i + 1}") for i in range(9)] + [("http://chain.net/9", "http://y.com/de/")]
    star = [(f"http://star.net/{i}", "http://star.net/hub") for i in range(60)] + [("http://star.net/hub", bad)]
    pages += [(100 + i, a, "", 0, "", "") for i, (a, _) in enumerate(chain)] + [(200 + i, a, "", 0, "", "") for i, (a, _) in enumerate(star)]
    html = [(pages[0][1], bad), (pages[2][1], "http://a.net/x?q=1"), (pages[3][1], "http://a.net/x?q=1"), ("http://b.net/1", "http://b.net/2"), ("http://b.net/2", good),
            ("http://b.net/2", "http://b.net/3"), ("http://b.net/3", worse), ("http://example.org/en/17", "http://e.net/")]
    logged = chain + star + [("http://f.net/1", "http://f.net/1"), ("http://f.net/1", None)]
    more = spark.createDataFrame(logged, "source string, target string")
    got = redirects.judge(spark.createDataFrame(pages, PAGES), redirects.rule_table(spark), more)
    want = judge_by_hand(pages, html + chain + star)
    assert order(got.collect()) == order(want)
    assert {v for _, h, _, _, v in want if h in ("a.net", "chain.net", "star.net", "e.net")} == {"block"}
    none = spark.createDataFrame([], PAGES)
    assert redirects.judge(none, redirects.rule_table(spark)).count() == 0


def test_many_rules_of_one_host(spark):
    rules = [("block", "r.net", f"/{i}") for i in range(300)] + [("allow", "r.net", "/12"), ("allow", "net", ""), ("block", "net", "")]
    pages = [(i, f"http://w{i % 3}.r.net/{i * 7}/x", "", 0, "", "") for i in range(200)]
    got = redirects.judge(spark.createDataFrame(pages, PAGES), redirects.rule_table(spark, rules))
    assert order(got.collect()) == order(judge_by_hand(pages, [], rules))


def test_hostile_html_does_not_step_back(spark):
    pages = [(1, "http://a.net/", "canonical <link " + "'" * 99_999 + "<link rel=canonical href=" * 20_000 + "<!--" * 50_000, 0, "", "")]
    assert redirects.page_edges(spark.createDataFrame(pages, PAGES)).count() == 0


# --- collocations -----------------------------------------------------------------------------------------------------
def mine_by_hand(rows, least, longest, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower(text or "")):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    f = {k: a for k, a in f.items() if a >= least}
    dropped = set()
    for k, a in f.items():
        w = k[1:]
        for size in range(2, len(w)):
            dropped |= {(k[0], *w[i : i + size]) for i in range(len(w) - size + 1) if a >= f[(k[0], *w[i : i + size])]}
    out = []
    for lang in n:
        mine = []
        for k, a in f.items():
            w = k[1:]
            if k[0] != lang or len(w) < 2 or k in dropped:
                continue
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:c])] * f[(lang, *w[c:])]), c) for c in range(1, len(w))]
            score, c = min(cuts)
            mine.append((-score, -a, " ".join(w).encode(), f[(lang, *w[:c])], f[(lang, *w[c:])]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(mine)[:top], 1)]
    return out


def texts():
    rnd = random.Random(9)
    words = ["The", "cat", "sat", "é", "on", "a", "MAT", "x.y", "b,", "!", " z", "w\x1cv", "\tq"]
    out = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None, "und"])) for _ in range(300)]
    return out + [("Once upon a time there was a cat\n" * 30, "en")] * 4 + [(None, "en"), ("", None), (" \t\n", "xx"), ("a " * 20_000, "fr")]


@pytest.mark.parametrize(("limit", "top", "head"), [(collocations.CHUNK_BYTES, 2000, collocations.HEAD), (500, 15, 40), (500, 2000, 0)])
def test_collocations(spark, limit, top, head):
    rows = texts()
    df = docs_of(spark, [(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)])
    got = collocations.mine(df, least=12, top=top, limit=limit, head=head).collect()
    want = mine_by_hand(rows, 12, 5, top)
    assert order(got) == order(want) and len(want) > 14
    if head:
        return
    every = collocations.mine(df, least=12, top=None, limit=limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert order(every) == order(mine_by_hand(rows, 12, 5, 10**9))


def test_levels_hold_only_places_in_pairs(spark, monkeypatch):
    levels = []
    named = collocations._named_pairs
    monkeypatch.setattr(collocations, "_named_pairs", lambda *a: levels.append(named(*a)) or levels[-1])
    rare = [" ".join(f"w{i}x{k}" for k in range(2_000)) for i in range(20)]
    got = collocations.mine(docs_of(spark, [(i, f"a b c d {w} a b. {w}", "en", None, None) for i, w in enumerate(rare)]), least=20).collect()
    assert {r.phrase for r in got} == {"a b c d", "a b"}
    # Each level keeps the chain of a phrase, not the rest of its text.
    kept = [[np.frombuffer(r.seq, np.int32).tolist() for r in level.collect()] for level in levels]
    assert [sum(map(len, rows)) for rows in kept] == [20 * 4, 20 * 3, 0]


def test_in_pairs_loses_no_pair():
    rng = np.random.default_rng(7)
    for size in (0, 1, 2, 3, 50, 500):
        ids = np.where(rng.random(size) < 0.5, -1, rng.integers(0, 5, size)).astype(np.int32)
        kept = collocations.in_pairs(ids)
        pairs = [c[c >= 0].tolist() for c in map(collocations._codes, (ids, kept))]
        assert pairs[0] == pairs[1]
        assert not ((kept[:-1] < 0) & (kept[1:] < 0)).any()


def test_pairs_leave_a_task_as_a_list_for_each_bucket():
    seq = np.random.default_rng(3).integers(0, 300, 20_000).astype(np.int32)
    level = pa.table({"chunk": [1, 2], "lang": ["en", "en"], "seq": pa.array([seq.tobytes(), seq.tobytes()], pa.binary())})
    rows = pa.Table.from_batches(collocations._count_pairs(3)(level.to_batches()))
    assert rows["bucket"].to_pylist() == [0, 1, 2]
    got = [collocations.unpack(x.as_py()) for x in rows["pairs"]]
    want = np.unique(collocations._codes(seq), return_counts=True)
    codes, counts = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(codes)
    assert (codes[order] == want[0]).all() and (counts[order] == 2 * want[1]).all()


def test_collocations_of_nothing(spark):
    assert collocations.mine(docs_of(spark, [])).count() == 0
    assert collocations.mine(docs_of(spark, [(1, None, None, None, None)])).count() == 0


@pytest.mark.parametrize("high", [5, 700, 5000])
def test_tiles_count_like_a_plain_count(high):
    rnd = np.random.default_rng(high)
    a, b = rnd.integers(0, high, 60_000), np.minimum(rnd.geometric(0.01, 60_000), high) - 1
    codes, counts = collocations.count_tiles(a, b, tile=64)
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert {(c >> 31, c & (1 << 31) - 1): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)} == want


def test_score_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**15 + 1, 10**15 + 3, 10**15 + 1, 10**15 + 2)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = df.select((F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).alias("x"), (wide("l") * wide("r")).alias("y")).select(F.expr("x div y").alias("s")).first().s
    assert got == 1000 * (10**15 + 1) * (10**15 + 3) // ((10**15 + 1) * (10**15 + 2))
