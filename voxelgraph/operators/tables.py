"""Checks, keys and alignment of voxel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelgraph.storage import durable, release


def validation(voxels: DataFrame) -> DataFrame:
    """subject_id, n_voxels, n_distinct, shortest, longest, n_no_coord, valid: one row for each subject."""
    out = voxels.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.countDistinct("voxel_id").alias("n_distinct"),
        F.min(F.size("series")).cast("long").alias("shortest"),
        F.max(F.size("series")).cast("long").alias("longest"),
        F.count_if(F.col("i").isNull() | F.col("j").isNull() | F.col("k").isNull()).alias("n_no_coord"),
    )
    ok = (F.col("shortest") == F.col("longest")) & (F.col("shortest") > 0) & (F.col("n_no_coord") == 0) & (F.col("n_voxels") == F.col("n_distinct"))
    return out.withColumn("valid", ok)


def validate(voxels: DataFrame) -> DataFrame:
    """voxels again, or ValueError: every subject needs whole coordinates, one series length, and the same number of voxels."""
    bad = validation(voxels).agg(F.count_if(~F.col("valid")).alias("bad"), F.countDistinct("n_voxels").alias("sizes"), F.countDistinct("shortest").alias("lengths")).first()
    if bad.bad or bad.sizes > 1 or bad.lengths > 1:
        raise ValueError(f"invalid voxel table: {bad.bad} bad subjects, {bad.sizes} voxel counts, {bad.lengths} series lengths")
    return voxels


def ijk(*columns: str) -> Column:
    return F.concat_ws("_", *(columns or ("i", "j", "k")))


def from_wide(df: DataFrame, time_columns: list[str]) -> DataFrame:
    """One series column from columns of samples."""
    return df.withColumn("series", F.array(*[F.col(f"`{c}`").cast("double") for c in time_columns])).drop(*time_columns)


def long_series(voxels: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """subject_id, voxel_id, t (from 0), value."""
    return voxels.select("subject_id", "voxel_id", F.posexplode(series).alias("t", value))


def common_voxels(voxels: DataFrame) -> DataFrame:
    """Rows whose coordinates every subject has."""
    n = voxels.select("subject_id").distinct().count()
    both = voxels.groupBy("i", "j", "k").agg(F.countDistinct("subject_id").alias("_n")).where(F.col("_n") == n)
    return voxels.join(both, ["i", "j", "k"], "left_semi")


def alignment(voxels: DataFrame, reference: int) -> DataFrame:
    """subject_id, n_common, n_missing, n_extra of each subject's coordinates against the reference subject's."""
    ref = voxels.where(F.col("subject_id") == reference).select("i", "j", "k").distinct().withColumn("_ref", F.lit(1))
    each = voxels.select("subject_id").distinct()
    n = ref.count()
    hits = voxels.select("subject_id", "i", "j", "k").distinct().join(ref, ["i", "j", "k"], "left").groupBy("subject_id")
    got = hits.agg(F.count("_ref").alias("n_common"), F.count_if(F.col("_ref").isNull()).alias("n_extra"))
    return each.join(got, "subject_id").select("subject_id", "n_common", (F.lit(n) - F.col("n_common")).alias("n_missing"), "n_extra")


def align(voxels: DataFrame, reference: int) -> DataFrame:
    """voxel_id of every subject set to the reference subject's at the same coordinates; ValueError unless all subjects have the
    same coordinates."""
    if alignment(voxels, reference).where("n_missing > 0 or n_extra > 0").limit(1).count():
        raise ValueError("subjects differ in their coordinates")
    ref = voxels.where(F.col("subject_id") == reference).select("i", "j", "k", F.col("voxel_id").alias("_id"))
    return voxels.join(ref, ["i", "j", "k"]).withColumn("voxel_id", F.col("_id")).drop("_id").select(voxels.columns)


def with_atlas(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Inner join on coordinates; adds roi. Spark broadcasts an atlas that is small by its statistics."""
    return voxels.join(atlas.select("i", "j", "k", "roi"), ["i", "j", "k"]).select(*voxels.columns, "roi")


def with_labels(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on subject and voxel; a voxel without label gets 0."""
    return voxels.join(labels.select("subject_id", "voxel_id", "label"), ["subject_id", "voxel_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def labelled(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """with_labels() as a written table, or ValueError if the join changed the number of voxels (a voxel with two labels). Both counts are
    observed by the write itself; no other job runs."""
    before, after = Observation(), Observation()
    out = with_labels(voxels.observe(before, F.count(F.lit(1)).alias("n")), labels).observe(after, F.count(F.lit(1)).alias("n"))
    table = durable(out)
    if before.get["n"] != after.get["n"]:
        release(table)
        raise ValueError(f"labels don't fit: {before.get['n']} voxels became {after.get['n']} rows")
    return table


def edges_checked(weights: DataFrame, voxels: DataFrame) -> DataFrame:
    """weights as a written table, or ValueError for an edge with an end that isn't a voxel of its subject, or with itself. Observed by the
    write, as in labelled()."""
    seen, known = Observation(), voxels.select("subject_id", "voxel_id").distinct()
    e = weights
    for c in ("i_idx", "j_idx"):
        e = e.join(known.toDF("subject_id", c).withColumn(f"_{c}", F.lit(1)), ["subject_id", c], "left")
    bad = F.count_if(F.col("_i_idx").isNull() | F.col("_j_idx").isNull()).alias("strange")
    table = durable(e.observe(seen, bad, F.count_if(F.col("i_idx") == F.col("j_idx")).alias("loops")).select(weights.columns))
    if seen.get["strange"] or seen.get["loops"]:
        release(table)
        raise ValueError(f"{seen.get['strange']} edges without a voxel, {seen.get['loops']} loops")
    return table


def small_clusters(labels: DataFrame, min_cluster_size: int = 50) -> DataFrame:
    """group: "isolated(0)" for label 0 and for clusters with fewer voxels than min_cluster_size, else the label."""
    n = labels.groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    small = (F.col("label") == 0) | (F.col("_n") < min_cluster_size)
    return labels.join(n, ["subject_id", "label"]).select("subject_id", "voxel_id", "label", F.when(small, "isolated(0)").otherwise(F.col("label").cast("string")).alias("group"))


def unassigned_to_zero(labels: DataFrame, unassigned: tuple[int, ...] = (-1, 0)) -> DataFrame:
    return labels.withColumn("label", F.when(F.col("label").isin(*unassigned), 0).otherwise(F.col("label")))


def to_base(labels: DataFrame, label_base: int = 0) -> DataFrame:
    """Labels are kept as 1..K with 0 unassigned; label_base 0 gives 0..K-1 with -1."""
    return labels.withColumn("label", F.col("label") - 1) if label_base == 0 else labels


def palette(labels: DataFrame, size: int = 24) -> DataFrame:
    """subject_id, label, colour: rank of the distinct label, modulo the palette's size."""
    d = labels.select("subject_id", "label").distinct()
    return d.withColumn("colour", (F.dense_rank().over(W.partitionBy("subject_id").orderBy("label")) - 1) % size)


def by_frequency(labels: DataFrame) -> DataFrame:
    """subject_id, label, n, place: clusters by size, largest first, label on ties."""
    n = labels.groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("subject_id").orderBy(F.desc("n"), "label")))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, for plots."""
    return df.orderBy(F.rand(seed)).limit(n)


def plot_frame(voxels: DataFrame, labels: DataFrame, include_unassigned: bool = True, unassigned: tuple[int, ...] = (0,), palette_size: int = 24, subject_id: int | None = None) -> DataFrame:
    """subject_id, voxel_id, i, j, k, label, colour: what a 3-D scatter of clusters draws. An unknown subject raises IndexError."""
    shown = labels if include_unassigned else labels.where(~F.col("label").isin(*unassigned))
    if subject_id is not None:
        shown = shown.where(F.col("subject_id") == subject_id)
        if not shown.limit(1).count():
            raise IndexError(f"no subject {subject_id}")
    coloured = shown.join(palette(shown, palette_size), ["subject_id", "label"])
    return coloured.join(voxels.select("subject_id", "voxel_id", "i", "j", "k"), ["subject_id", "voxel_id"]).select("subject_id", "voxel_id", "i", "j", "k", "label", "colour")
