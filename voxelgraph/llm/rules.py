"""Quality rules with an isolation forest over rule statistics.

Statistics count over whole texts. A forest of random splits, each tree of which is grown on LEAVES documents drawn from those labelled
good, gives each document its mean path length: anomalous documents are cut off early. The threshold is calibrated on all
labelled rows, so that a documented share of those labelled good (KEEP) stays above it, exactly.

Edge cases: a null text has no words and one line without words; null ids are judged like others; where none is labelled
good all labelled ones stand for them; without labels nothing is anomalous; an empty table gives an empty result; repeated
rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.llm.text import Texts, U, grams, inside, item_hashes, mix, owners, scan, space_table, table_of
from voxelgraph.llm.training import quantile
from voxelgraph.storage import durable

TREES, LEAVES, KEEP = 64, 256, 0.995

#: Rows that the trees draw theirs from: no fewer than they can all use.
PER_CLASS = TREES * LEAVES

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def per_text(t: Texts, flags: np.ndarray) -> np.ndarray:
    """How many of the bytes flagged each text has."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[t.off[1:]] - total[t.off[:-1]]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: keys found twice or more; keys equal to an earlier one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] = later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(t: Texts, window: int = 5) -> list[np.ndarray]:
    """The columns of COUNTS."""
    blanks, data = space_table(), t.data
    start, end, first = t.words(blanks)
    own = owners(first)
    salt = lambda h, who: mix(h ^ (who.astype(U) * U(0x9E3779B97F4A7C15)))
    # Words in repeated windows.
    h = item_hashes(t, start, end)
    at = np.flatnonzero(inside(first, window))
    twice, _ = repeated(salt(grams(h, window)[at], own[at]) if len(at) else np.zeros(0, U))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    in_repeat = np.bincount(own, np.cumsum(edge[:-1]) > 0, t.n).astype(np.int64)
    # Lines with a word that came before.
    begin, stop, line_first = t.lines()
    line_own = owners(line_first)
    wordy = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    line_hash = salt(item_hashes(t, begin, stop), line_own)
    _, later = repeated(line_hash[wordy])
    dup_lines = np.bincount(line_own[wordy], later, t.n).astype(np.int64)
    is_lead = (data & 0xC0) != 0x80
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    return [np.diff(first), per_text(t, is_lead & ~blanks[data]), per_text(t, table_of(b"#*$%&|<>")[data]), dup_lines, in_repeat, per_text(t, upper), per_text(t, digit), per_text(t, table_of(b"!?.,;:()[]{}\"'/\\=-_@")[data]), np.diff(line_first)]


def features(x: np.ndarray) -> np.ndarray:
    """(rows, 8) from COUNTS."""
    words, chars, symbols, dup, rep, upper, digits, punct, lines = x.astype(float).T
    w, c = np.maximum(1, words), np.maximum(1, chars)
    return np.column_stack([np.log1p(words), chars / w, symbols / w, dup / np.maximum(1, lines), rep / w, upper / c, digits / c, punct / w])


@dataclass
class IsolationForest:
    feature: np.ndarray  # (trees, nodes): -1 at leaves
    cut: np.ndarray
    length: np.ndarray  # path length at leaves, with the mean of an unbuilt subtree

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, length in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1))):
                split = f[node] >= 0
                if not split.any():
                    break
                right = x[rows, np.maximum(f[node], 0)] >= c[node]
                node = np.where(split, 2 * node + 1 + right, node)
            total += length[node]
        return total / max(1, len(self.feature))


def mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean length of an unsuccessful search among n."""
    n = np.maximum(n, 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 9) -> IsolationForest:
    """Splits are random places in a node's cell, not between its rows: box (low, high of each feature) is the root's cell. So
    ground that no row of x occupies is cut off early, even where x is constant."""
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(leaves)))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    usable = np.flatnonzero(box[1] > box[0])
    for t in range(trees):
        todo = [(0, 0, rng.choice(len(x), min(leaves, len(x)), replace=False), box)]
        while todo:
            node, level, rows, cell = todo.pop()
            if level == depth or len(rows) < 2 or not len(usable):
                length[t, node] = level + mean_path(float(len(rows)))
                continue
            f = rng.choice(usable)
            c = rng.uniform(cell[0, f], cell[1, f])
            feature[t, node], cut[t, node] = f, c
            right = x[rows, f] >= c
            below, above = cell.copy(), cell.copy()
            below[1, f] = above[0, f] = c
            todo += [(2 * node + 1, level + 1, rows[~right], below), (2 * node + 2, level + 1, rows[right], above)]
    return IsolationForest(feature, cut, length)


def base_rules(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def calibrated(x: np.ndarray, good: np.ndarray, keep: float = KEEP) -> tuple[IsolationForest | None, float]:
    """A forest and the path length below which a document is anomalous. x: COUNTS of a sample; good: 1, 0 or NaN (no label)."""
    x, good = x[~base_rules(x[:, 0], x[:, 4])], good[~base_rules(x[:, 0], x[:, 4])]
    if not len(x):
        return None, 0.0
    v = features(x)
    forest = grow(v[good == 1] if (good == 1).any() else v, np.stack([v.min(0), v.max(0)]))
    path = forest.path(v)
    base = path[good == 1] if (good == 1).any() else path
    return forest, float(np.quantile(base, 1 - keep))


def _pool(good: DataFrame, most: int) -> DataFrame:
    """Up to `most` rows, drawn from all by the hash of their id; about twice as many are ranked."""
    n = good.count()
    draw = F.pmod(F.xxhash64(F.lit("forest"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = good.where(draw * F.lit(float(n)) < F.lit(2.0 * most + 100)) if n > most else good
    return some.orderBy(F.xxhash64(F.lit("forest"), "doc_id"), "doc_id", *COUNTS).limit(most)


def _box(known: DataFrame) -> np.ndarray | None:
    """Least and largest value of each feature, over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = features(np.column_stack([np.asarray(b.column(c)) for c in COUNTS]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1], dtype=np.int32)), pa.array(v.min(0)), pa.array(v.max(0))], names=["f", "low", "high"])

    ends = known.select(*COUNTS).mapInArrow(part, "f int, low double, high double")
    got = sorted(ends.groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator())
    return np.array([[r.low for r in got], [r.high for r in got]]) if got else None


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, keep: float = KEEP) -> DataFrame:
    """doc_id, the COUNTS, path (mean path length), base_failed, kept, for every row. The features' cell and the threshold come from all
    labelled rows that pass the base rules, as calibrated() has them; the trees draw their LEAVES rows each from per_class of
    those labelled good, themselves drawn from all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = durable(scan(rows, lambda: lambda part, t: [part.column("doc_id"), *statistics(t)], SCHEMA))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    named = labels.select("doc_id", F.col(label).alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = durable(counted.where(~failed).join(named, "doc_id"))
    box = _box(known)
    good = known.where("label = 1") if not known.where("label = 1").isEmpty() else known
    forest = None
    if box is not None:
        drawn = _pool(good, per_class).toPandas().sort_values(["doc_id", *COUNTS])
        forest = grow(features(drawn[list(COUNTS)].to_numpy()), box)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c)) for c in COUNTS])
            path = model.value.path(features(x)) if model.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(path)], names=[*b.schema.names, "path"])

    scored = lambda df: df.select("doc_id", *COUNTS).mapInArrow(measure, SCHEMA + ", path double")
    least = quantile(durable(scored(good).select("path")), 1 - keep) if forest else 0.0
    return scored(counted).select("*", failed.alias("base_failed"), (~failed & (F.col("path") >= F.lit(least))).alias("kept"))
