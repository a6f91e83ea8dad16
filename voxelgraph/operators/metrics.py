"""Silhouettes, Dice overlaps, modularity, scree numbers and summaries, as joins and aggregations.

Labels are 1..K with 0 unassigned. Undefined values are NULL, so that averages skip them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelgraph.functions.series import lists, matrix
from voxelgraph.operators.graph import mirrored


def _ends(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of both ends."""
    l = labels.select("subject_id", "voxel_id", "label")
    a, b = l.toDF("subject_id", "i_idx", "li"), l.toDF("subject_id", "j_idx", "lj")
    return weights.join(a, ["subject_id", "i_idx"]).join(b, ["subject_id", "j_idx"])


def silhouette_strict(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """subject_id, label, n_k, a, b, s: mean similarity inside a cluster against that to all other voxels, over all pairs (a pair
    without an edge counts 0; unassigned voxels count among the others)."""
    return silhouette_of_ends(_ends(weights, labels), labels)


def silhouette_of_ends(e: DataFrame, labels: DataFrame) -> DataFrame:
    """silhouette_strict() from weights with the labels of both ends (li, lj), or their sums by these, as kernels.correlation_ends() makes
    them in tiles."""
    inner = e.where("li = lj and li > 0").groupBy("subject_id", F.col("li").alias("label")).agg((2 * F.sum("w")).alias("inner"))
    both = F.explode(F.array(F.col("li"), F.col("lj"))).alias("label")
    degree = e.select("subject_id", both, "w").where("label > 0").groupBy("subject_id", "label").agg(F.sum("w").alias("deg"))
    size = labels.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    n_k = labels.where("label > 0").groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("n_k"))
    t = n_k.join(inner, ["subject_id", "label"], "left").join(degree, ["subject_id", "label"], "left").join(size, "subject_id")
    t = t.fillna(0.0, ["inner", "deg"])
    defined = (F.col("n_k") > 1) & (F.col("n_k") < F.col("n"))
    t = t.withColumn("a", F.when(defined, F.col("inner") / (F.col("n_k") * (F.col("n_k") - 1)))).withColumn("b", F.when(defined, (F.col("deg") - F.col("inner")) / (F.col("n_k") * (F.col("n") - F.col("n_k")))))
    top = F.greatest("a", "b")
    return t.select("subject_id", "label", "n_k", "a", "b", F.when((top != 0) & ~F.isnan(top) & (F.abs(top) != float("inf")), (F.col("a") - F.col("b")) / top).alias("s"))


def silhouette_all_pairs(voxels: DataFrame, labels: DataFrame, kind: str = "correlation") -> DataFrame:
    """silhouette_strict() of the graph of all pairs without a threshold, correlation or cosine, without making a pair: sums of products over
    two groups are products of the groups' sums, so one pass over the voxels suffices. Columns as there."""
    if kind not in ("correlation", "cosine"):
        raise ValueError("kind is correlation or cosine")

    def unit(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(1, keepdims=True) if kind == "correlation" else x
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where((length == 0) | ~np.isfinite(length), np.inf, length)

    def part(batches):
        held: dict = {}
        for b in batches:
            s, g = np.asarray(b.column("subject_id")), np.asarray(b.column("label"))
            x = unit(matrix(b.column("series")))
            for key in set(zip(s.tolist(), g.tolist())):
                on = (s == key[0]) & (g == key[1])
                n, total, own = held.get(key, (0, 0, 0))
                held[key] = n + int(on.sum()), total + x[on].sum(0), own + float((x[on] ** 2).sum())
        for (s, g), (n, total, own) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([g], pa.int32()), pa.array([n], pa.int64()), pa.array([own]), lists(total[None, :])], names=["subject_id", "label", "n", "own", "total"])

    rows = voxels.select(F.col("subject_id").cast("int").alias("subject_id"), "voxel_id", "series").join(labels.select("subject_id", "voxel_id", F.col("label").cast("int").alias("label")), ["subject_id", "voxel_id"])
    sums = rows.mapInArrow(part, "subject_id int, label int, n long, own double, total array<double>")
    flat = sums.select("subject_id", "label", "n", "own", F.posexplode("total").alias("t", "x"))
    flat = flat.groupBy("subject_id", "label", "t").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("x").alias("x"))
    whole = W.partitionBy("subject_id", "t")  # a row a cluster
    flat = flat.withColumn("all", F.sum("x").over(whole)).withColumn("n_all", F.sum("n").over(whole))
    g = flat.groupBy("subject_id", "label").agg(F.max("n").alias("n_k"), F.max("n_all").alias("_n"), F.max("own").alias("_own"), F.sum(F.col("x") * F.col("x")).alias("_in"), F.sum(F.col("x") * F.col("all")).alias("_all"))
    a = F.try_divide(F.col("_in") - F.col("_own"), F.col("n_k") * (F.col("n_k") - 1))
    b = F.try_divide(F.col("_all") - F.col("_in"), F.col("n_k") * (F.col("_n") - F.col("n_k")))
    if kind == "cosine":
        a, b = 0.5 * (a + 1), 0.5 * (b + 1)
    defined = (F.col("n_k") > 1) & (F.col("n_k") < F.col("_n"))
    out = g.where("label > 0").select("subject_id", "label", "n_k", F.when(defined, a).alias("a"), F.when(defined, b).alias("b"))
    top = F.greatest("a", "b")
    return out.withColumn("s", F.when(top != 0, (F.col("a") - F.col("b")) / top))


def overall(per_cluster: DataFrame, value: str = "s") -> DataFrame:
    """subject_id, overall: mean over clusters."""
    return per_cluster.groupBy("subject_id").agg(F.avg(value).alias("overall"))


def mean_sd(per_subject: DataFrame, value: str = "overall") -> DataFrame:
    """One row: n, mean, sd (ddof 1; NULL for fewer than two)."""
    return per_subject.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def silhouette_graph(weights: DataFrame, labels: DataFrame, rest: str = "nearest") -> DataFrame:
    """subject_id, voxel_id, label, s from edges between assigned voxels: mean weight to the own cluster against the largest mean to
    another one (rest "nearest"), or the mean over all edges to other clusters ("all")."""
    l = labels.where("label > 0").select("subject_id", "voxel_id", "label")
    m = mirrored(weights).join(l.toDF("subject_id", "node", "label"), ["subject_id", "node"]).join(l.toDF("subject_id", "other", "near"), ["subject_id", "other"])
    return silhouette_of_near(m.groupBy("subject_id", "node", "label", "near").agg(F.sum("w").alias("sum"), F.count(F.lit(1)).alias("n")), rest)


def silhouette_of_near(each: DataFrame, rest: str = "nearest") -> DataFrame:
    """silhouette_graph() from each node's weights to each cluster, summed and counted: subject_id, node, label, near, sum, n."""
    mean, own = F.col("sum") / F.col("n"), F.col("label") == F.col("near")
    b = F.max(F.when(~own, mean)) if rest == "nearest" else F.sum(F.when(~own, F.col("sum"))) / F.sum(F.when(~own, F.col("n")))
    t = each.groupBy("subject_id", F.col("node").alias("voxel_id"), "label").agg(F.max(F.when(own, mean)).alias("a"), b.alias("b"))
    t = t.where("a is not null and b is not null").withColumn("top", F.greatest("a", "b")).where("top > 0")
    return t.select("subject_id", "voxel_id", "label", ((F.col("a") - F.col("b")) / F.col("top")).alias("s"))


def edge_agreement(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """subject_id, i_idx, j_idx, agree, use: same cluster, and both ends assigned."""
    l = labels.select("subject_id", "voxel_id", "label")
    e = edges.join(l.toDF("subject_id", "i_idx", "li"), "i_idx").join(l.toDF("subject_id", "j_idx", "lj"), ["subject_id", "j_idx"])
    use = (F.col("li") > 0) & (F.col("lj") > 0)
    return e.select("subject_id", "i_idx", "j_idx", (use & (F.col("li") == F.col("lj"))).cast("long").alias("agree"), use.cast("long").alias("use"))


def _ratio(top: Column, bottom: Column, empty: float | None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def dice_edge(first: DataFrame, second: DataFrame, edges: DataFrame, empty: float | None = None) -> DataFrame:
    """subject_id, dice of which edges lie inside a cluster, in two labellings."""
    a = edge_agreement(first, edges).select("subject_id", "i_idx", "j_idx", F.col("agree").alias("a"))
    b = edge_agreement(second, edges).select("subject_id", "i_idx", "j_idx", F.col("agree").alias("b"))
    t = a.join(b, ["subject_id", "i_idx", "j_idx"]).groupBy("subject_id").agg(F.sum(F.col("a") * F.col("b")).alias("x"), F.sum(F.col("a") + F.col("b")).alias("n"))
    return t.select("subject_id", _ratio(2 * F.col("x"), F.col("n"), empty).alias("dice"))


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum(n * (n - 1)), F.lit(0)) / 2


def pair_counts(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, both, in_first, in_second: numbers of voxel pairs inside one cluster, from the contingency table alone. first and second:
    keys, voxel_id, label; voxels of both count."""
    if not keys:
        return pair_counts(first.withColumn("_all", F.lit(0)), second.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    t = first.select(*keys, "voxel_id", F.col("label").alias("l1")).join(second.select(*keys, "voxel_id", F.col("label").alias("l2")), [*keys, "voxel_id"])
    cells = t.groupBy(*keys, "l1", "l2").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    by = lambda df: df.groupBy(*keys)
    total = by(cells).agg(F.sum("n").alias("n"))
    both = by(cells.where("l1 > 0 and l2 > 0")).agg(_pairs(n).alias("both"))
    one = [by(cells.where(f"{c} > 0").groupBy(*keys, c).agg(F.sum("n").alias("n"))).agg(_pairs(n).alias(name)) for c, name in (("l1", "in_first"), ("l2", "in_second"))]
    return reduce(lambda a, b: a.join(b, keys, "left"), [total, both, *one]).fillna(0.0, ["both", "in_first", "in_second"])


def overlap(first: DataFrame, second: DataFrame, keys: list[str] | None = None, dice: bool = True, empty: float | None = None) -> DataFrame:
    """keys, overlap: Dice of the pairs inside clusters, or (dice False) shared pairs over the sum, half of it."""
    keys = ["subject_id"] if keys is None else keys
    t = pair_counts(first, second, keys)
    return t.select(*keys, _ratio((2 if dice else 1) * F.col("both"), F.col("in_first") + F.col("in_second"), empty).alias("overlap"))


def dice_vs_atlas(pred: DataFrame, atlas: DataFrame, zero_is_background: bool = True) -> DataFrame:
    """n_nodes, n_edges_ref, n_edges_pred, tp_edges, dice_edge over coordinates that both have. pred: i, j, k, label; atlas: i, j, k, roi.
    Labels are compared through contingency counts, not through matrices of voxel pairs."""
    shift = 0 if zero_is_background else 1
    p = pred.select("i", "j", "k", (F.col("label") + shift).alias("label")).distinct()
    r = atlas.select("i", "j", "k", (F.col("roi") + shift).alias("roi")).distinct()
    t = p.join(r, ["i", "j", "k"]).withColumn("voxel_id", F.concat_ws("_", "i", "j", "k"))
    c = pair_counts(t.select("voxel_id", F.coalesce("roi", F.lit(0)).alias("label")), t.select("voxel_id", F.coalesce("label", F.lit(0)).alias("label")), [])
    return c.select(F.col("n").alias("n_nodes"), F.col("in_first").cast("long").alias("n_edges_ref"), F.col("in_second").cast("long").alias("n_edges_pred"), F.col("both").cast("long").alias("tp_edges"), _ratio(2 * F.col("both"), F.col("in_first") + F.col("in_second"), None).alias("dice_edge"))


def overlap_matrix(outs: DataFrame, dice: bool = True) -> DataFrame:
    """a, b, overlap for every ordered pair of results, 1 on the diagonal. outs: result, voxel_id, label."""
    one = outs.select(F.col("result").alias("a"), "voxel_id", F.col("label").alias("l1"))
    two = outs.select(F.col("result").alias("b"), "voxel_id", F.col("label").alias("l2"))
    t = one.join(two, "voxel_id").where("a < b")
    first, second = t.select("a", "b", "voxel_id", F.col("l1").alias("label")), t.select("a", "b", "voxel_id", F.col("l2").alias("label"))
    half = overlap(first, second, ["a", "b"], dice)
    names = outs.select(F.col("result").alias("a")).distinct()
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap")).unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("overlap")))


def modularity(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """subject_id, modularity: weighted Newman modularity of any labelling (label 0 is a cluster too)."""
    return modularity_of_ends(_ends(weights, labels))


def modularity_of_ends(e: DataFrame) -> DataFrame:
    """modularity() from weights with the labels of both ends, or their sums by these."""
    m = e.groupBy("subject_id").agg(F.sum("w").alias("m"))
    inner = e.where("li = lj").groupBy("subject_id", F.col("li").alias("label")).agg(F.sum("w").alias("inner"))
    deg = e.select("subject_id", F.explode(F.array("li", "lj")).alias("label"), "w").groupBy("subject_id", "label").agg(F.sum("w").alias("deg"))
    t = deg.join(inner, ["subject_id", "label"], "left").fillna(0.0, ["inner"]).join(m, "subject_id")
    part = F.col("inner") / F.col("m") - (F.col("deg") / (2 * F.col("m"))) * (F.col("deg") / (2 * F.col("m")))
    return t.groupBy("subject_id").agg(F.sum(part).alias("modularity"))


def scree(values: DataFrame, normalize: str = "possum", keys: list[str] | None = None) -> DataFrame:
    """keys, component, eigenvalue, share, cumulative: values largest first, as percentages of the sum of positive ones (possum) or
    of absolute ones (absum), or raw (none, or where that sum isn't positive). values: keys, eigenvalue."""
    keys = keys or []
    base = W.partitionBy(*keys)
    size = {"possum": F.greatest("eigenvalue", F.lit(0.0)), "absum": F.abs("eigenvalue")}.get(normalize)
    order = base.orderBy(F.desc("eigenvalue"))
    t = values.withColumn("component", F.row_number().over(order))
    if size is not None:
        t = t.withColumn("_d", F.sum(size).over(base)).withColumn("share", F.when(F.col("_d") > 0, 100 * F.col("eigenvalue") / F.col("_d")).otherwise(F.col("eigenvalue")))
    else:
        t = t.withColumn("share", F.col("eigenvalue"))
    running = base.orderBy("component").rowsBetween(W.unboundedPreceding, 0)
    return t.withColumn("cumulative", F.sum("share").over(running)).select(*keys, "component", "eigenvalue", "share", "cumulative")


def cluster_summary(labels: DataFrame) -> DataFrame:
    """subject_id, n_voxels, n_assigned, n_clusters."""
    on = F.when(F.col("label") > 0, F.col("label"))
    return labels.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_voxels"), F.count(on).alias("n_assigned"), F.countDistinct(on).alias("n_clusters"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(voxels: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of distinct values of each column."""
    return voxels.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def summary_table(reports: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """method, dice_mean, dice_sd, si_mean, si_sd from each method's per-subject dice (column dice) and silhouette (column overall)."""
    rows = []
    for name, (dice, silhouette) in reports.items():
        d = mean_sd(dice, "dice").select(F.lit(name).alias("method"), F.col("mean").alias("dice_mean"), F.col("sd").alias("dice_sd"))
        rows.append(d.join(mean_sd(silhouette).select(F.lit(name).alias("method"), F.col("mean").alias("si_mean"), F.col("sd").alias("si_sd")), "method"))
    return reduce(lambda a, b: a.unionByName(b), rows)
