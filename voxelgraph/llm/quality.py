"""Quality by supervised subword embeddings: hashed word and character n-gram vectors averaged per document, softmax output.

Features of a text are its words and the 3-, 4- and 5-byte n-grams of each word with its edges marked, lower-casing none, and
one feature each for a word that came one, two or three words before. The vectors and the output layer are learned with numpy stochastic gradient descent on a bounded sample of labelled rows. As the
model is linear in the averaged vectors, scoring needs each bucket's share of the log-odds only: one float, broadcast.

Edge cases: a null, empty or wordless text gets the score of the output bias alone; null ids are scored and never held out;
without labels of both classes every score is the share of label 1 (0.5 without labels); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.llm.text import Powers, Texts, U, mix, owners, scan, space_table
from voxelgraph.llm.training import fold, sample_ids, sample_texts

BUCKETS, WIDTH, PER_CLASS, GRAMS = 1 << 17, 8, 1500, (3, 4, 5)


def features(t: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features with repeats, and the text of each."""
    blanks = space_table()
    start, end, first = t.words(blanks)
    blank = blanks[t.data]
    key, own = [t.hashes(start, end)], [owners(first)]
    # One blank between words marks their edges: texts are taken apart by one too.
    marked = np.where(blank, np.uint8(32), t.data)
    padded = np.full(len(marked) + t.n + 1, 32, np.uint8)
    where = np.arange(len(marked)) + np.repeat(np.arange(1, t.n + 1), np.diff(t.off))
    padded[where] = marked
    up, down = t.powers.upto(len(padded) + 1)
    prefix = np.zeros(len(padded) + 1, U)
    np.cumsum((padded.astype(U) + U(1)) * up[: len(padded)], out=prefix[1:])
    blanks_before = np.concatenate([[0], np.cumsum(padded == 32)])
    text_of = np.searchsorted(t.off[1:] + np.arange(1, t.n + 1), np.arange(len(padded)), side="right")
    for n in GRAMS:
        at = np.arange(len(padded) - n + 1)
        at = at[blanks_before[at + n - 1] == blanks_before[at + 1]]  # no blank but at the edges
        key.append(mix((prefix[at + n] - prefix[at]) * down[at] + U(n)))
        own.append(text_of[at + 1])
    for n in (1, 2, 3):  # a word that came n words before is a feature of its own
        same = np.flatnonzero((key[0][n:] == key[0][:-n]) & (own[0][n:] == own[0][:-n]))
        key.append(np.full(len(same), n, U))
        own.append(own[0][same])
    return (np.concatenate(key) % U(buckets)).astype(np.int64), np.concatenate(own)


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = 4, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Log-odds of label 1 for each bucket, and the bias."""
    y = np.asarray(labels, int)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return np.zeros(buckets, np.float32), float(np.log(share / (1 - share)))
    powers, bags = Powers(), []
    for s in texts:
        f, n = np.unique(features(Texts(pa.array([s], pa.large_string()), powers), buckets)[0], return_counts=True)
        bags.append((f, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vector = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((width, 2)), np.zeros(2)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            f, x = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = x @ vector[f] if len(f) else np.zeros(width)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= balance[i]
            if len(f):
                # Averaging makes each vector's share of the gradient tiny; x / max(x) keeps its direction and gives it size.
                vector[f] -= (lr * x / x.max())[:, None] * (out @ p)[None, :].astype(np.float32) * 0.1
            out -= lr * np.outer(h, p) * 4
            bias -= lr * p * 0.1
    return (vector @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(share: np.ndarray, bias: float, feature: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    many = np.bincount(own, minlength=n)
    z = bias + np.bincount(own, share[feature], n) / np.maximum(1, many)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 3, held: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Only labels whose fold isn't `held` are learned."""
    known = labels.where(fold("doc_id", parts) != held).select("doc_id", F.col(label).alias("label")).where("label in (0, 1)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    got = sample_texts(rows, sample_ids(known, per_class))
    share, bias = train(got["text"].tolist(), got["label"].to_numpy(int))
    model = docs.sparkSession.sparkContext.broadcast((share, bias))

    def make():
        share, bias = model.value

        def work(part, t):
            return part.column("doc_id"), score(share, bias, *features(t, len(share)), t.n)

        return work

    out = scan(rows, make, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
