"""The corpus pipeline's rows against a plain version of its stages."""

import re
from collections import defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plotline.llm import toxicity
from plotline.llm.queries import table, tokenizer_path
from plotline.llm.sampling import held_out

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def without_shared_lines(texts):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in texts.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    gone = lambda doc, line: len(holders[key(line)]) > 1 and min(holders[key(line)]) != doc
    return {d: "\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in texts.items()}


def first_of_near_copies(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in texts.items() if find(d) == d}


def uncontaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in texts.items():
        w = words(t)
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out[d] = t
    return out


def test_pipeline_rows(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"), 3, 1)), table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    texts = first_of_near_copies(without_shared_lines(texts))
    texts = uncontaminated(texts, [r.text for r in table(spark, SF, "benchmark").collect()])
    lib = Tokenizer.from_file(tokenizer_path())
    want = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns, name
