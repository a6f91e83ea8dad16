"""Exact medians of very many values a group by counting passes.

A pass counts the values of each group in BINS bins of a bracket; the next bracket is the bin (or bins) that holds the middle ranks. Once
it holds LISTED values at most they are listed and the median is read off. So a group's values are neither sorted nor gathered, and
may be made anew in every pass, as all pairs of voxels are inside their tiles. A first bracket may be a guess: where the middle ranks prove
to be outside it, the whole range takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions.series import lists, matrix

#: Bins of a pass; values a group that may be listed; passes, enough to part any two doubles.
BINS, LISTED, PASSES = 4096, 50_000, 16

#: Width of a bracket from which bins are found by a division.
TINY = 1e-290

Brackets = dict[int, tuple[float, float]]


def edges(bracket: tuple[float, float]) -> np.ndarray:
    """The bins' edges; a value belongs to the bin that begins at or below it."""
    return np.linspace(*bracket, BINS + 1)


def histogram(x: np.ndarray, bracket: tuple[float, float]) -> np.ndarray:
    """How many values lie below the bracket, and in each of its bins (lower end included)."""
    e = edges(bracket)
    low, x = np.count_nonzero(x < e[0]), x[(x >= e[0]) & (x < e[-1])]
    guess = (x - e[0]) * (BINS / (e[-1] - e[0])) if e[-1] - e[0] > TINY else np.zeros(len(x))
    at = np.minimum(guess.astype(np.int64), BINS - 1)
    off = np.flatnonzero((x < e[at]) | (x >= e[at + 1]))  # next to an edge, by rounding
    at[off] = np.searchsorted(e, x[off], side="right") - 1
    return np.concatenate([[low], np.bincount(at, minlength=BINS)])


def summed(partial: DataFrame) -> dict[int, np.ndarray]:
    """The groups' histograms from partial ones: subject_id, hist."""

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            total = total + matrix(b.column("hist")).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), lists(total[None, :])], names=["subject_id", "hist"])

    got = partial.select("subject_id", F.col("hist").cast("array<double>").alias("hist")).groupBy("subject_id").applyInArrow(join, "subject_id int, hist array<double>")
    return {r.subject_id: np.array(r.hist, np.int64) for r in got.toLocalIterator()}


def exact_medians(brackets: Brackets, count: Callable[[Brackets], dict[int, np.ndarray]], values: Callable[[Brackets], dict[int, np.ndarray]], guess: Brackets | None = None) -> dict[int, float]:
    """The median of each group that has values. brackets: from at most its least value to above its largest; count: the histogram() of
    each group in its bracket; values: what lies in it. guess: brackets to try first; count then adds how many lie above a bracket."""
    out, total, live = {}, {}, brackets | (guess or {})
    for _ in range(PASSES):
        listed: dict[int, tuple[float, float]] = {}
        below = {}
        for s, h in count(live).items():
            total.setdefault(s, int(h.sum()))
            upto = np.cumsum(h)
            a, b = (int(np.searchsorted(upto, rank, side="right")) for rank in ((total[s] - 1) // 2, total[s] // 2))
            if a == 0 or b > BINS:  # guessed wrong
                live[s] = brackets[s]
                continue
            e = edges(live[s])
            live[s], below[s] = (e[a - 1], e[b]), int(upto[a - 1])
            if a == b and e[b] <= np.nextafter(e[a - 1], np.inf):
                out[s] = float(e[a - 1])  # a bin of one double
            elif upto[b] - below[s] <= LISTED:
                listed[s] = live[s]
        for s, x in (values(listed) if listed else {}).items():
            out[s] = float(np.sort(x)[[(total[s] - 1) // 2 - below[s], total[s] // 2 - below[s]]].mean())
        live = {s: b for s, b in live.items() if s in total and s not in out}
        if not live:
            return out
    raise RuntimeError("medians not found")


def table_medians(rows: DataFrame, value: str = "w") -> dict[int, float]:
    """The median of the positive finite values of each subject_id."""
    x = rows.where((F.col(value) > 0) & (F.col(value) < float("inf"))).select(F.col("subject_id").cast("int").alias("subject_id"), F.col(value).alias("x"))
    ends = {r.subject_id: (r.lo, np.nextafter(r.hi, np.inf)) for r in x.groupBy("subject_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).toLocalIterator()}

    def count(brackets: Brackets) -> dict[int, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                s, v = np.asarray(b.column(0)), np.asarray(b.column(1))
                for k in np.unique(s):
                    if int(k) in brackets:
                        held[int(k)] = held.get(int(k), 0) + histogram(v[s == k], brackets[int(k)])
            for k, h in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), lists(h[None, :].astype(float))], names=["subject_id", "hist"])

        return summed(x.mapInArrow(part, "subject_id int, hist array<double>"))

    def values(brackets: Brackets) -> dict[int, np.ndarray]:
        spans = x.sparkSession.createDataFrame([(s, float(a), float(b)) for s, (a, b) in brackets.items()], "subject_id int, a double, b double")
        got = x.join(F.broadcast(spans), "subject_id").where("x >= a and x < b").select("subject_id", "x").toPandas()  # LISTED a subject
        return {int(s): g["x"].to_numpy() for s, g in got.groupby("subject_id")}

    return exact_medians(ends, count, values) if ends else {}
