"""The pipeline's stages, each against what its operator or brute force gives on the stage's own input."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from voxelgraph.llm import language, packing, simhash
from voxelgraph.storage import durable

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900001, "12 34 !!", None, "x", 8), (900002, None, None, "x", 0), (900003, "", "en", None, None)], docs.schema)
    docs = durable(docs.unionByName(extra))
    language_id, lines, near, mixing, pack = [f for _, f in corpus_pipeline.STAGES]

    first = durable(language_id(spark, docs, SF))
    pred = {r.doc_id: r for r in language.identify(docs, docs).collect()}
    want = {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert first.columns == COLUMNS and {r.doc_id for r in first.collect()} == want
    assert want == {r.doc_id for r in docs.collect() if r.doc_id < 900000}  # only the rows without letters go

    second = durable(lines(spark, first, SF))
    rows = sorted(first.collect(), key=lambda r: r.doc_id)
    seen, kept = set(), {}
    for r in rows:
        ls = r.text.split("\n")
        gone = [False] * len(ls)
        for span in (2, 1):
            for p in range(len(ls) - span + 1):
                k = tuple(ls[p : p + span])
                if any(WORD.search(x) for x in k) and (span == 2 or len(k[0]) >= 80):
                    if k in seen:
                        gone[p : p + span] = [True] * span
                    seen.add(k)
        text = "\n".join(x for x, g in zip(ls, gone) if not g)
        if not any(gone) or WORD.search(text):
            kept[r.doc_id] = text
    assert second.columns == COLUMNS and {r.doc_id: r.text for r in second.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = durable(near(spark, second, SF))
    assert sorted(r.doc_id for r in third.collect()) == brute_similar([(r.doc_id, r.text) for r in second.collect()])

    fourth = durable(mixing(spark, third, SF))
    left = {r.doc_id: r.text for r in fourth.collect()}
    before = {r.doc_id: r.text for r in third.collect()}
    assert fourth.columns == COLUMNS and left.items() <= before.items() and len(left) > 0.5 * len(before)

    last = pack(spark, fourth, SF)
    assert last.agg(F.sum("length")).first()[0] == packing.pieces(fourth).agg(F.sum("length")).first()[0]


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def brute_similar(rows, least=0.8):
    """Ids that stay: the smallest of each group linked by the Jaccard similarity of five-word shingles."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in WORD.findall(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                up[b] = a
    return sorted({rows[top(i)][0] for i in range(len(rows))})


def test_near_duplicate_stage_reaches_edited_copies(spark):
    rng = random.Random(3)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 12])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert got == brute_similar(rows)
    groups = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert sorted(set(groups.values())) == got and len(groups) == len(rows)
    two_bits = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(two_bits) > len(got)  # what a radius of two bits leaves


def test_near_duplicate_groups_larger_than_a_crowd(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [["a", "b", "c"], ["A", "b", "C"], []]
    for n in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 8, 30])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert sorted(set(got.values())) == brute_similar(rows) and got[1] == 0


def test_the_first_shared_place_is_a_key_of_both(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        x = [rng.getrandbits(64) for _ in range(simhash.PRINTS)]
        y = list(x)
        for _ in range(rng.randrange(40)):
            y[rng.randrange(simhash.PRINTS)] ^= 1 << rng.randrange(64)
        for side, z in ((0, x), (1, y)):
            rows.append((n * 2 + side, *[v - (1 << 64) if v >> 63 else v for v in z]))
    fps = [f"fp{k}" for k in range(simhash.PRINTS)]
    df = spark.createDataFrame(rows, "node long, " + ", ".join(f"{f} long" for f in fps))
    keys = simhash._keys(df, ["node"]).select("key", (F.col("node") / 2).cast("int").alias("pair"), (F.col("node") % 2).alias("side"))
    shared = keys.groupBy("pair", "key").agg(F.countDistinct("side").alias("n")).where("n = 2").groupBy("pair").agg((F.min("key") / (1 << 32)).cast("int").alias("place"))
    want = {r.pair: r.place for r in shared.collect()}
    a, b = df.where("node % 2 = 0"), df.where("node % 2 = 1")
    both = a.select((F.col("node") / 2).cast("int").alias("pair"), *fps).join(b.select(((F.col("node") - 1) / 2).cast("int").alias("pair"), *[F.col(f).alias(f"x{f}") for f in fps]), "pair")
    got = both.select("pair", simhash._first_shared([F.col(f).bitwiseXOR(F.col(f"x{f}")) for f in fps]).alias("place")).where("place is not null").collect()
    assert {r.pair: r.place for r in got} == want and 50 < len(want) < 400
