"""WAND against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from voxelgraph.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, lang string, terms string, n string", "item_id long, text string, doc_id int"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(split(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        query, scores = Counter(split(text)), []
        for (i, bag), size in zip(bags, lengths):
            m = 25 + (75 * size * n) // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in query.items() if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, None, "x", "y") for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return sorted([tuple(r) for r in wand.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 3 else f"common{i % 2}" for i in range(60)] + ["a" * 20, "b" * 9 + "ü", "x7"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([6, 63])]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    docs[5:8] = [(5, docs[9][1]), (6, docs[9][1]), (7, None)]
    return docs, [(j, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for j in range(25)]


@pytest.mark.parametrize("shard", [wand.SHARD, 7])
def test_search_matches_scoring_all(spark, monkeypatch, shard):
    docs, items = corpus(1)
    monkeypatch.setattr(wand, "SHARD", shard)
    assert got(spark, docs, items) == plain(docs, items)
    assert got(spark, docs, items, k=3) == plain(docs, items, 3)


def test_queries_in_blocks(spark, monkeypatch):
    docs, items = corpus(2, 80)
    monkeypatch.setattr(wand, "QUERY_CHARS", 300)
    assert got(spark, docs, items) == plain(docs, items)


def test_defined_edges(spark):
    docs = [(3, "tie word"), (1, "tie word"), (None, "tie word"), (1, "tie word"), (4, ""), (5, None), (6, " !? "), (7, "big " * 300_000 + "Tie"), (8, "\U0001f600 ÄB")]
    items = [(1, "TIE"), (1, "word word"), (2, None), (3, "..."), (None, "\U0001f600"), (4, "unknown")]
    out = got(spark, docs, items)
    assert out == plain(docs, items)
    assert {r[2] for r in out if r[:2] in ((1, 1), (1, 2))} == {1}
    assert got(spark, [], items) == [] and got(spark, docs, []) == []


def test_documents_that_cannot_win_are_not_scored():
    rng = np.random.default_rng(3)
    n, terms = 20_000, 30
    has = rng.random((n, terms)) < np.where(np.arange(terms) < 5, 0.5, 0.002)
    own, which = np.nonzero(has)
    search = wand.Search([[(t, 1) for t in range(terms)]], np.where(np.arange(terms) < 5, 100, 6000), n, 50 * n, 10)
    counts = np.ones(len(own), np.int64)
    search.shard(list(range(n)), np.full(n, 50), np.concatenate([[0], np.cumsum(has.sum(1))]), which, counts)
    m = 25 + 75 * 50 * n // (50 * n)
    whole = has @ np.where(np.arange(terms) < 5, 100, 6000) * (1_000_000_000 // (1000 + 8 * m))
    assert sorted((s for s, _, _ in search.heaps[0]), reverse=True) == sorted(whole.tolist(), reverse=True)[:10]
    assert search.scored < n / 10
