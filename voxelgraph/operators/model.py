"""Spectral clustering with all that it found: eigenvalues, eigenvectors, centres and active nodes as tables, and mini-batch k-means.

The spectrum comes from one task a subject up to spectral.DENSE nodes and from Chebyshev filters over the edge table beyond. Mini-batch
k-means draws its batches by hash: a subject's batches reach one task in order, a bounded number of rows whatever its size, and each
centre moves towards a batch's members by a rate that decays with how many it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.functions.series import lists, matrix
from voxelgraph.operators import spectral
from voxelgraph.operators.eigen import settled_eigenvectors
from voxelgraph.operators.graph import degrees, normalized
from voxelgraph.operators.tiled import TiledGraph
from voxelgraph.storage import durable, release


@dataclass
class SpectralModel:
    labels: DataFrame  # subject_id, voxel_id, label (1..K by smallest node; 0: not active)
    eigenvalues: DataFrame  # subject_id, component, eigenvalue
    vectors: DataFrame  # subject_id, voxel_id, vector
    centres: DataFrame  # subject_id, label, centre
    active: DataFrame  # subject_id, voxel_id, strength


def spectrum(norm: DataFrame | TiledGraph, sizes: dict[int, int], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Written tables subject_id, component, eigenvalue and subject_id, voxel_id, vector: the k largest of each subject. norm: normalised
    edges, a written table, or a normal graph of tiles; sizes: nodes of each subject."""
    tiled, most = isinstance(norm, TiledGraph), {s for s, n in sizes.items() if n > spectral.DENSE}
    spark = (norm.rows if tiled else norm).sparkSession
    large = spark.createDataFrame([(s,) for s in sorted(most)], "subject_id int")
    few = normalized(norm.only(set(sizes) - most).edges()) if tiled else norm.join(F.broadcast(large), "subject_id", "left_anti")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["i_idx"], pdf["j_idx"]]))
        s = np.zeros((len(nodes), len(nodes)))
        a, b = np.searchsorted(nodes, pdf["i_idx"]), np.searchsorted(nodes, pdf["j_idx"])
        s[a, b] = s[b, a] = pdf["w"]
        value, vector = np.linalg.eigh(s)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[0], "voxel_id": [-1, *nodes], "vector": [value, *vector]})

    dense = few.groupBy("subject_id").applyInPandas(solve, "subject_id int, voxel_id long, vector array<double>")
    dense = durable(dense)
    values = dense.where("voxel_id = -1").select("subject_id", F.posexplode("vector").alias("component", "eigenvalue"))
    vectors = dense.where("voxel_id >= 0")
    if most:
        value, y, _ = settled_eigenvectors(norm.only(most) if tiled else norm.join(F.broadcast(large), "subject_id"), k, seed=seed)
        more = spark.createDataFrame([(s, c, float(x)) for s, v in value.items() for c, x in enumerate(v)], "subject_id int, component int, eigenvalue double")
        values = values.unionByName(more)
        vectors = vectors.unionByName(y.select("subject_id", "voxel_id", F.array(*[f"y{c}" for c in range(k)]).alias("vector")))
    return durable(values.withColumn("component", F.col("component") + 1)), durable(vectors)


def units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where((length == 0) | ~np.isfinite(length), 1, length)


class MiniBatch:
    """Centres of one subject, batch by batch."""

    def __init__(self, k: int, starts: int, patience: int, seed: int):
        self.k, self.starts, self.patience, self.rng = k, starts, patience, np.random.default_rng(seed)
        self.centres, self.best, self.idle = None, np.inf, 0

    def take(self, x: np.ndarray) -> None:
        """The first batch seeds (the best of several k-means++ draws); each later one moves the centres."""
        if self.centres is None:
            seeds = [spectral.spread(x, self.k, self.rng) for _ in range(self.starts)]
            self.centres = min(seeds, key=lambda c: np.maximum(spectral.squares(x, c).min(1), 0).sum())
            self.seen = np.zeros(self.k)
            return
        if self.idle >= self.patience:
            return
        d = spectral.squares(x, self.centres)
        own = d.argmin(1)
        n = np.bincount(own, minlength=self.k)
        total = np.zeros_like(self.centres)
        np.add.at(total, own, x)
        self.seen += n
        hit = n > 0
        rate = (n[hit] / self.seen[hit])[:, None]  # as if the members came one by one, each with a rate of one over those seen
        self.centres[hit] += rate * (total[hit] / n[hit][:, None] - self.centres[hit])
        inertia = np.maximum(d[np.arange(len(x)), own], 0).mean()
        self.idle = 0 if inertia < self.best else self.idle + 1
        self.best = min(self.best, inertia)


def mini_batch_centres(vectors: DataFrame, k: int, batch: int = 5000, starts: int = 10, steps: int = 100, seed: int = 42, patience: int = 10) -> DataFrame:
    """subject_id, cluster (from 0), centre from the normalised rows of vectors (a written table): one task a subject, in which `steps`
    batches of about `batch` rows follow each other."""
    n = vectors.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n"))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "voxel_id"), F.lit(1 << 40)) / float(1 << 40) * F.col("_n") < batch
    when = F.explode(F.filter(F.sequence(F.lit(0), F.lit(steps)), draw)).alias("step")
    rows = vectors.join(F.broadcast(n), "subject_id").select("subject_id", when, "voxel_id", "vector")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at, held = MiniBatch(k, starts, patience, seed), None, []
        for b in batches:
            steps_here = np.asarray(b.column("step"))
            for t in np.unique(steps_here):
                if t != at and held:
                    made.take(np.concatenate(held))
                    held = []
                at = t
                held.append(units(matrix(b.filter(pa.array(steps_here == t)).column("vector"))))
        if held:
            made.take(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, key), pa.int32()), pa.array(np.arange(k), pa.int32()), lists(made.centres)], names=["subject_id", "cluster", "centre"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            for b in batches:
                s = np.asarray(b.column("subject_id"))
                for key in np.unique(s):
                    yield int(key), b.filter(pa.array(s == key))

        from itertools import groupby

        for key, group in groupby(runs(), lambda r: r[0]):
            yield from run(key, (b for _, b in group))

    ordered = rows.repartition("subject_id").sortWithinPartitions("subject_id", "step", "voxel_id")
    return ordered.mapInArrow(each, "subject_id int, cluster int, centre array<double>")


def assigned(vectors: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """subject_id, voxel_id, label by the nearest centre, numbered by their smallest node; and subject_id, label, centre (null: a centre that
    no node is nearest to). centres: a written table of k rows a subject, which are broadcast."""
    held: dict[int, list] = {}
    for r in centres.orderBy("subject_id", "cluster").toLocalIterator():
        held.setdefault(r.subject_id, []).append(r.centre)
    shared = vectors.sparkSession.sparkContext.broadcast({s: np.array(c) for s, c in held.items()})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.asarray(b.column("subject_id"))
            for key in np.unique(s):
                part = b.filter(pa.array(s == key))
                near = spectral.squares(units(matrix(part.column("vector"))), shared.value[int(key)]).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("subject_id"), part.column("voxel_id"), pa.array(near.astype("int32"))], names=["subject_id", "voxel_id", "cluster"])

    got = durable(vectors.select("subject_id", "voxel_id", "vector").mapInArrow(own, "subject_id int, voxel_id long, cluster int"))
    first = got.groupBy("subject_id", "cluster").agg(F.min("voxel_id").alias("_first"))
    number = durable(first.select("subject_id", "cluster", F.row_number().over(Window.partitionBy("subject_id").orderBy("_first")).alias("label")))
    return got.join(F.broadcast(number), ["subject_id", "cluster"]).drop("cluster"), centres.join(number, ["subject_id", "cluster"], "left").select("subject_id", "label", "centre")


def spectral_model(weights: DataFrame | TiledGraph, voxels: DataFrame, n_clusters: int, batch: int = 5000, kmeans_nstart: int = 10, kmeans_itermax: int = 100, random_state: int = 42) -> SpectralModel:
    """Normalised-cut clustering of each subject by mini-batch k-means, with its spectrum, centres and active nodes."""
    if isinstance(weights, TiledGraph) and weights.largest() <= spectral.DENSE:
        weights = weights.edges()
    tiled = isinstance(weights, TiledGraph)
    if tiled:
        norm, active = weights.positive().normal()
    else:
        w = durable(weights.where("w > 0").select(F.col("subject_id").cast("int").alias("subject_id"), "i_idx", "j_idx", "w"))
        active = durable(degrees(w).select("subject_id", "voxel_id", "strength"))
    sizes = {r.subject_id: r.n for r in active.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if n_clusters <= 0 or any(n <= n_clusters for n in sizes.values()):
        raise ValueError("n_clusters must be positive and smaller than the number of active nodes")
    norm = norm if tiled else durable(normalized(w))
    values, vectors = spectrum(norm, sizes, n_clusters, random_state)
    if not tiled:
        release(w, norm)
    centres = durable(mini_batch_centres(vectors, n_clusters, batch, kmeans_nstart, kmeans_itermax, random_state))
    labels, named = assigned(vectors, centres)
    every = voxels.select(F.col("subject_id").cast("int").alias("subject_id"), "voxel_id").join(labels, ["subject_id", "voxel_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return SpectralModel(every, values, vectors, named, active)
