"""Weighted graphs as tables of upper-triangle edges (subject_id, i_idx < j_idx, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mirrored(weights: DataFrame) -> DataFrame:
    """Both orientations, for sums over a node's edges."""
    ends = F.explode(F.array(F.struct(F.col("i_idx").alias("a"), F.col("j_idx").alias("b")), F.struct(F.col("j_idx").alias("a"), F.col("i_idx").alias("b")))).alias("e")
    return weights.select("subject_id", ends, "w").select("subject_id", F.col("e.a").alias("node"), F.col("e.b").alias("other"), "w")


def symmetrized(entries: DataFrame) -> DataFrame:
    """Mean of both orientations; a missing one counts as zero. Loops go."""
    up = entries.where("i_idx <> j_idx").select("subject_id", F.least("i_idx", "j_idx").alias("i_idx"), F.greatest("i_idx", "j_idx").alias("j_idx"), "w")
    return up.groupBy("subject_id", "i_idx", "j_idx").agg((F.sum("w") / 2).alias("w"))


def simplified(entries: DataFrame) -> DataFrame:
    """Parallel edges become one with the largest weight; loops go."""
    up = entries.where("i_idx <> j_idx").select("subject_id", F.least("i_idx", "j_idx").alias("i_idx"), F.greatest("i_idx", "j_idx").alias("j_idx"), "w")
    return up.groupBy("subject_id", "i_idx", "j_idx").agg(F.max("w").alias("w"))


def symmetrized_pairs(pairs: DataFrame) -> DataFrame:
    """symmetrized() where both entries of a pair are one row: subject_id, i_idx < j_idx, up, down (null: no entry), each pair once, as tiles
    make them. No entry is shuffled."""
    w = (F.coalesce("up", F.lit(0.0)) + F.coalesce("down", F.lit(0.0))) / 2
    return pairs.where("up is not null or down is not null").select("subject_id", "i_idx", "j_idx", w.alias("w"))


def simplified_pairs(pairs: DataFrame) -> DataFrame:
    """simplified() of such rows."""
    return pairs.where("up is not null or down is not null").select("subject_id", "i_idx", "j_idx", F.greatest("up", "down").alias("w"))


def degrees(weights: DataFrame) -> DataFrame:
    """subject_id, voxel_id, degree (edges), strength (sum of weights), of nodes with edges."""
    return mirrored(weights).groupBy("subject_id", F.col("node").alias("voxel_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def active(voxels: DataFrame, weights: DataFrame) -> DataFrame:
    """Voxels whose strength is positive."""
    return voxels.join(degrees(weights).where("strength > 0"), ["subject_id", "voxel_id"], "left_semi")


def normalized(weights: DataFrame) -> DataFrame:
    """w / sqrt(strength_i * strength_j) among nodes of positive strength."""
    d = degrees(weights).where("strength > 0").select("subject_id", "voxel_id", "strength")
    a, b = d.toDF("subject_id", "i_idx", "_di"), d.toDF("subject_id", "j_idx", "_dj")
    return weights.join(a, ["subject_id", "i_idx"]).join(b, ["subject_id", "j_idx"]).select("subject_id", "i_idx", "j_idx", (F.col("w") / F.sqrt(F.col("_di") * F.col("_dj"))).alias("w"))


def top_k(weights: DataFrame, k: int = 200, clamp_negative: bool = True, symmetry: str = "upper") -> DataFrame:
    """Of each column the k largest weights (ties: lower row first). "upper" keeps edge i < j if i is among column j's, as the
    reference does; "union" if either end has the other."""
    w = weights.where("w > 0") if clamp_negative else weights
    m = mirrored(w)
    ranked = m.withColumn("_n", F.row_number().over(W.partitionBy("subject_id", "node").orderBy(F.desc("w"), "other"))).where(F.col("_n") <= k)
    return chosen(ranked, symmetry)


def chosen(ranked: DataFrame, symmetry: str = "upper") -> DataFrame:
    """Edges from each node's chosen others, as top_k() has them."""
    if symmetry == "union":
        return ranked.select("subject_id", F.least("node", "other").alias("i_idx"), F.greatest("node", "other").alias("j_idx"), "w").distinct()
    return ranked.where("other < node").select("subject_id", F.col("other").alias("i_idx"), F.col("node").alias("j_idx"), "w")


def summary(weights: DataFrame, voxels: DataFrame) -> DataFrame:
    """subject_id, n_nodes, n_edges, nnz, mean_degree."""
    n = voxels.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = weights.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = n.join(e, "subject_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("nnz", 2 * F.col("n_edges")).withColumn("mean_degree", F.col("nnz") / F.col("n_nodes"))
