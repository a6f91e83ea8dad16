"""Group consensus: how often two voxels share a cluster over subjects, its clustering, and leave-one-out scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.operators import kernels, metrics
from voxelgraph.operators.pairs import edges26, tiles
from voxelgraph.operators import spectral
from voxelgraph.operators.spectral import spectral_clustering
from voxelgraph.operators.tables import align
from voxelgraph.storage import durable


def for_each_subject(rows: DataFrame, subjects: DataFrame, name: str = "subject_id") -> DataFrame:
    """rows once for each subject_id of the other table."""
    ids = sorted(r[0] for r in subjects.select("subject_id").distinct().toLocalIterator())
    return rows.withColumn(name, F.explode(F.array(*[F.lit(i) for i in ids])))


def consensus_on_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """i_idx, j_idx, agree, cnt, w: subjects that put both ends in one cluster, subjects that assign both, their ratio."""
    a = metrics.edge_agreement(labels, edges).groupBy("i_idx", "j_idx").agg(F.sum("agree").alias("agree"), F.sum("use").alias("cnt"))
    return a.withColumn("w", F.when(F.col("cnt") > 0, F.col("agree") / F.col("cnt")))


def label_rows(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """subject_id (0), voxel_id, labels of each assigned voxel, one place a subject (0: unassigned); and subject_id, place."""
    places = labels.select("subject_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("subject_id")) - 1)  # one row a subject
    places = durable(places)
    n = places.count()
    own = labels.where("label > 0").join(F.broadcast(places), "subject_id").groupBy("voxel_id", "place").agg(F.max("label").alias("label"))
    by = own.groupBy("voxel_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "label"))).alias("m"))  # one entry a subject, at most
    every = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0)).cast("double"))
    return by.select(F.lit(0).alias("subject_id"), "voxel_id", every.alias("labels")), places


def _together(x: np.ndarray, y: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one subject: which pairs share a cluster, which are both assigned."""
    use = (x[:, s, None] > 0) & (y[None, :, s] > 0)
    return use & (x[:, s, None] == y[None, :, s]), use


def _counted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all subjects: how often pairs share a cluster, how often both are assigned (a product of indicators)."""
    agree = np.zeros((len(x), len(y)), np.int32)
    for s in range(x.shape[1]):
        agree += _together(x, y, s)[0]
    return agree, ((x > 0).astype(np.float32) @ (y > 0).astype(np.float32).T).astype(np.int32)


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of labels of a block, and which of them each voxel has."""
    kinds, own = np.unique(x, axis=0, return_inverse=True)
    return kinds, own.ravel()


def _cells(i: np.ndarray, own: np.ndarray, j: np.ndarray | None, other: np.ndarray, on: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Smaller id, larger id, values of the pairs of two blocks' voxels (j None: of one block's) whose kinds are on. on and values: a
    number for two kinds, so what is made is the pairs kept, whatever the others."""
    to, parts = i if j is None else j, []
    for a in range(len(on)):
        rows, at = i[own == a], np.flatnonzero(on[a][other])
        parts.append((np.repeat(rows, len(at)), np.tile(to[at], len(rows)), *[np.tile(v[a][other[at]], len(rows)) for v in values]))
    u, v, *values = (np.concatenate(c) for c in zip(*parts))
    if j is None:
        once = u < v
        u, v, *values = (c[once] for c in (u, v, *values))
    return [np.minimum(u, v), np.maximum(u, v), *values]


def consensus_all_pairs(labels: DataFrame, block_size: int = 2048) -> DataFrame:
    """The same over all pairs that agree in some subject. Two blocks of voxels meet with the labels of all subjects and are counted
    there, so neither clusters nor subjects are keys: a cluster with a third of all voxels is dealt over tiles like any other. Voxels
    with the same labels in all subjects are counted once."""
    rows, _ = label_rows(labels)

    def make(subject, i, x, j, y):
        x, own = _kinds(x)
        y, other = (x, own) if y is None else _kinds(y)
        agree, cnt = _counted(x, y)
        return _cells(i, own, j, other, agree > 0, agree, cnt)

    out = tiles(rows, make, "i_idx long, j_idx long, agree long, cnt long", block_size)
    return out.withColumn("w", F.col("agree") / F.col("cnt"))


def leave_one_out(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """held_out, i_idx, j_idx, agree, cnt, w: the consensus without each subject, by subtraction from the totals."""
    own = metrics.edge_agreement(labels, edges).select(F.col("subject_id").alias("held_out"), "i_idx", "j_idx", F.col("agree").alias("a"), F.col("use").alias("u"))
    t = own.join(consensus_on_edges(labels, edges), ["i_idx", "j_idx"])
    t = t.select("held_out", "i_idx", "j_idx", (F.col("agree") - F.col("a")).alias("agree"), (F.col("cnt") - F.col("u")).alias("cnt"))
    return t.withColumn("w", F.when(F.col("cnt") > 0, F.col("agree") / F.col("cnt")))


def leave_one_out_all_pairs(labels: DataFrame, block_size: int = 1024) -> DataFrame:
    """held_out, i_idx, j_idx, agree, cnt, w over pairs that still agree somewhere: each tile subtracts a subject at a time from its counts."""
    rows, places = label_rows(labels)

    def make(subject, i, x, j, y):
        x, own = _kinds(x)
        y, other = (x, own) if y is None else _kinds(y)
        agree, cnt = _counted(x, y)
        parts = []
        for s in range(x.shape[1]):
            both, use = _together(x, y, s)
            u, v, *counts = _cells(i, own, j, other, agree > both, agree - both, cnt - use)
            parts.append((np.full(len(u), s), u, v, *counts))
        return [np.concatenate(p) for p in zip(*parts)]

    out = tiles(rows, make, "place int, i_idx long, j_idx long, agree long, cnt long", block_size)
    out = out.join(F.broadcast(places), "place").select(F.col("subject_id").alias("held_out"), "i_idx", "j_idx", "agree", "cnt")
    return out.withColumn("w", F.col("agree") / F.col("cnt"))


def _kind_vectors(kinds: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvectors of the normalised consensus graph of all pairs, a row for a voxel of each kind, and which kinds have
    edges. kinds: distinct rows of labels by subject (0: unassigned); n: voxels of each. Voxels of a kind have the same weights, so a
    vector of a positive eigenvalue is constant on a kind, and the quotient by kinds has them all; those that aren't have negative
    ones. NaN where fewer than k are positive."""
    agree, cnt = _counted(kinds, kinds)
    w = np.where(agree > 0, agree / np.maximum(cnt, 1), 0.0)
    strength = w @ n - np.diag(w)
    live = strength > 0
    w, m, d = w[live][:, live], n[live].astype(float), strength[live]
    q = w * np.sqrt(m[:, None] * m) / np.sqrt(d[:, None] * d)
    q[np.diag_indices(len(q))] -= np.diag(w) / d
    value, vector = np.linalg.eigh(q)
    out = np.full((len(n), k), np.nan)
    if len(value) >= k and value[-k] > 1e-9:
        out[live] = vector[:, ::-1][:, :k] / np.sqrt(m)[:, None]
    return out, live


def consensus_clusters(labels: DataFrame, voxels: DataFrame, n_clusters: int, left_out: bool = False, kmeans_nstart: int = 10, kmeans_itermax: int = 100, random_state: int = 42) -> DataFrame | None:
    """spectral_clustering() of consensus_all_pairs() (subject_id 0), or with left_out of each held-out subject's leave_one_out_all_pairs()
    (subject_id: the held-out one), without a pair: voxels with the same labels in all subjects are one row of a small matrix. None
    where that doesn't serve: graphs of up to spectral.DENSE voxels, more kinds of voxels than that, too few positive eigenvalues."""
    rows, places = label_rows(labels)
    rows = durable(rows.select("voxel_id", "labels"))
    if rows.count() <= spectral.DENSE:
        return None
    if left_out:
        each = places.select(F.col("subject_id").cast("int").alias("subject_id"), "place")
        rows = rows.crossJoin(F.broadcast(each)).select("subject_id", "voxel_id", F.transform("labels", lambda x, p: F.when(p == F.col("place"), 0.0).otherwise(x)).alias("labels"))
    else:
        rows = rows.select(F.lit(0).alias("subject_id"), "voxel_id", "labels")
    rows = durable(rows)
    kinds = durable(rows.groupBy("subject_id", "labels").agg(F.count(F.lit(1)).alias("n")))
    if kinds.groupBy("subject_id").count().agg(F.max("count")).first()[0] > spectral.DENSE:
        return None

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("labels", key=lambda c: c.map(tuple))
        y, live = _kind_vectors(np.stack(pdf["labels"]), pdf["n"].to_numpy(), n_clusters)
        return pd.DataFrame({"subject_id": pdf["subject_id"], "labels": pdf["labels"], "y": list(y)})[live]

    solved = durable(kinds.groupBy("subject_id").applyInPandas(solve, "subject_id int, labels array<double>, y array<double>"))
    if solved.where(F.isnan(F.col("y")[0])).limit(1).count():
        return None
    y = rows.join(F.broadcast(solved), ["subject_id", "labels"]).select("subject_id", "voxel_id", *[F.col("y")[c].alias(f"y{c}") for c in range(n_clusters)])
    out = spectral.clustered(durable(y), n_clusters, kmeans_nstart, kmeans_itermax, random_state)
    return voxels.select(F.col("subject_id").cast("int").alias("subject_id"), "voxel_id").join(out, ["subject_id", "voxel_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def edge_weights(voxels: DataFrame, edges: DataFrame, weight: str | Callable = "correlation") -> DataFrame:
    """subject_id, i_idx, j_idx, w by name: correlation, cosine, partial, or l2, srvf, srvf_dtw, srvf_elastic (distances scaled by each subject's
    median); or by a function of voxels and edges."""
    if callable(weight):
        return weight(voxels, edges)
    similar = {"correlation": kernels.edge_correlation, "cosine": kernels.edge_cosine, "partial": kernels.edge_partial_correlation}
    if weight in similar:
        return similar[weight](voxels, edges)
    if weight == "l2":
        far = kernels.edge_l2(voxels, edges)
    elif weight in ("srvf", "srvf_dtw", "srvf_elastic"):
        far = kernels.edge_srvf(voxels, edges, warp=weight.removeprefix("srvf").strip("_") or "none")
    else:
        raise ValueError(f"unknown kernel {weight}")
    return kernels.distance_to_weight(durable(far), "rbf")  # read for the median and for the weights


@dataclass
class Parcellation:
    mode: str  # "26" or "all pairs"
    group_labels: DataFrame
    group_graph: DataFrame
    subject_labels: DataFrame
    edges: DataFrame | None


def group_parcellation(voxels: DataFrame, n_clusters: int, mode: str = "26", weight: str | Callable = "correlation", r_min: float | None = None, reference: int = 0, kmeans_nstart: int = 5, kmeans_itermax: int = 300, random_state: int = 2025) -> Parcellation:
    """Cluster each subject's graph, count agreement, cluster the agreement graph. All subjects run at once: subject_id is a key.
    weight: as edge_weights() takes it with the 26-neighbour graph, as kernels.all_pairs() does otherwise."""
    v = durable(align(voxels, reference))
    edges = durable(edges26(v.where(F.col("subject_id") == reference))) if mode == "26" else None
    if mode == "26":
        w = kernels.finish(edge_weights(v, edges, weight), r_min, "auto")
    else:
        w = kernels.all_pairs_graph(v, weight, r_min)
    opts = {"kmeans_nstart": kmeans_nstart, "kmeans_itermax": kmeans_itermax, "random_state": random_state}
    labels = durable(spectral_clustering(w, v, n_clusters, **opts))
    agreed = consensus_on_edges(labels, edges) if mode == "26" else consensus_all_pairs(labels)
    graph = agreed.where("w > 0").select(F.lit(0).alias("subject_id"), "i_idx", "j_idx", "w")
    nodes = v.where(F.col("subject_id") == reference).select(F.lit(0).alias("subject_id"), "voxel_id")
    group = consensus_clusters(labels, nodes, n_clusters, **opts) if mode != "26" else None
    if group is None:
        graph = durable(graph)
        group = spectral_clustering(graph, nodes, n_clusters, **opts)
    group = durable(group.select("voxel_id", "label"))
    return Parcellation(mode, group, graph, labels, edges)


def loocv_dice(out: Parcellation, n_clusters: int, kmeans_nstart: int = 10, kmeans_itermax: int = 1000, random_state: int = 2025) -> DataFrame:
    """subject_id, dice: each subject's labels against the clustering of the consensus of all others. Held-out subjects are the
    groups of one clustering job. Edge Dice with the 26-neighbour graph, pair Dice otherwise."""
    opts = {"kmeans_nstart": kmeans_nstart, "kmeans_itermax": kmeans_itermax, "random_state": random_state}
    again = consensus_clusters(out.subject_labels, out.subject_labels, n_clusters, True, **opts) if out.edges is None else None
    if again is None:
        left = leave_one_out(out.subject_labels, out.edges) if out.edges is not None else leave_one_out_all_pairs(out.subject_labels)
        graph = left.where("w > 0").select(F.col("held_out").alias("subject_id"), "i_idx", "j_idx", "w")
        again = spectral_clustering(graph, out.subject_labels, n_clusters, **opts)
    if out.edges is not None:
        return metrics.dice_edge(again, out.subject_labels, out.edges)
    return metrics.overlap(again, out.subject_labels).withColumnRenamed("overlap", "dice")


def silhouette_per_subject(weights: DataFrame, group_labels: DataFrame) -> DataFrame:
    """subject_id, label, n_k, a, b, s: the group's labels judged on each subject's own graph."""
    return metrics.silhouette_strict(weights, for_each_subject(group_labels, weights))
