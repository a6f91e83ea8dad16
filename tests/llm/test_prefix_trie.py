"""The trie of rebuilt conversations against a plain one."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from voxelgraph.llm import prefix_trie
from voxelgraph.llm import queries as text_queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key int, base string"


def plain(rows):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            by[c].append((t is not None, t or 0, digest, (role, text)))
    by = {c: [e[3] for e in sorted(v, key=lambda e: e[:3])] for c, v in by.items()}
    whole = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(by.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, q in whole.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    for q in members:
        if q:
            kids[q[:-1]].append(q)

    def below(q):
        leaves, saved = int(not kids[q]), (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
        for k in kids[q]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for q, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(q))
        out.append((min(who), len(q), min(members[q[:-1]]) if q else None, len(who), len(kids[q]), *below(q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted([tuple(r) for r in prefix_trie.prefix_trie(df, **more).select(*COLUMNS).collect()], key=str)


def conversations(seed, low=-45, high=130):
    rng, rows = random.Random(seed), []
    for c in range(low, high):
        for t in range(rng.randint(0, 7) if rng.random() < 0.8 else 0):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a  b\tc", "", None, "é x"])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return [*rows, (None, 1, "user", "x")]


@pytest.mark.parametrize("flush", [prefix_trie.FLUSH, 3, 1])
def test_trie_matches_a_plain_one(spark, flush):
    rows = conversations(3)
    assert got(spark, rows, flush=flush) == plain(rows)


def test_hot_nodes_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST", 2)
    rows = [(c, 0, "system", "one prompt for all") for c in range(400)] + [(c, 1, "user", f"q{c % 5}") for c in range(0, 400, 3)]
    rows += [(7, t, "user", "again " * (t % 3)) for t in range(1, 150)]
    assert got(spark, rows, flush=20) == plain(rows)


def test_defined_edges(spark):
    assert got(spark, []) == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)  # its base is absent, and so is what it would take
    none = hashlib.sha256(str(turnless).encode()).hexdigest()
    assert got(spark, [(turnless, 0, "user", "x")]) == [(turnless, 0, None, 1, 0, 1, 0, none)]
    long = "w " * 200_000
    rows = [(20, 0, None, long), (40, 0, "", long), (60, None, None, None)]
    assert got(spark, rows) == plain(rows)
    assert max(r[6] for r in plain(rows)) == 200_000


@pytest.mark.parametrize("name", ["op11_wand_shards", "op12_cover_tree", "op13_family_first_trie"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(text_queries.oracle_sql()[name]).df()
    df = text_queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(df.columns)
    want = want[df.columns].astype(object)
    assert sorted(str(list(r)) for r in df.collect()) == sorted(map(str, want.where(want.notna(), None).values.tolist()))
