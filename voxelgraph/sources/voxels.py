"""Sources of voxel tables (subject_id, voxel_id, i, j, k, series), atlases and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgraph.functions.series import lists
from voxelgraph.sources.numpy_files import PARTITION, VOXELS, NumpyVoxels

ATLAS = "i int, j int, k int, roi int"


def from_arrays(spark: SparkSession, data: np.ndarray, coord: np.ndarray) -> DataFrame:
    """From data (subjects, voxels, times) and coordinates (voxels, 3 or more) in memory."""
    data, coord = np.asarray(data, float), np.asarray(coord)
    if data.ndim != 3 or coord.ndim != 2 or len(coord) != data.shape[1]:
        raise ValueError("data is (subjects, voxels, times) and coordinates (voxels, axes), with as many voxels")
    if coord.shape[1] < 3:
        raise ValueError("three coordinates are needed")
    s, v, _ = data.shape
    columns = {"subject_id": np.repeat(np.arange(s), v).astype("int32"), "voxel_id": np.tile(np.arange(v), s)} | {n: np.tile(coord[:, c].astype("int32"), s) for c, n in enumerate("ijk")}
    return spark.createDataFrame(pa.table(columns | {"series": lists(data.reshape(s * v, -1))}), VOXELS)


def read_numpy(spark: SparkSession, data_path: str, coord_path: str, partition: int = PARTITION) -> DataFrame:
    """.npy or .npz files of data (subjects, voxels, times) and coordinates (voxels, 3 or more), read by byte ranges of about `partition`
    bytes; see numpy_files."""
    for path in (data_path, coord_path):
        if not path.endswith((".npy", ".npz")):
            raise ValueError(f"{path} is neither .npy nor .npz")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NumpyVoxels)
    return spark.read.format(NumpyVoxels.name()).option("data", data_path).option("coord", coord_path).option("partition", str(partition)).load()


def read_subject_csv(spark: SparkSession, paths: str | list[str], samples: int, header: bool = True) -> DataFrame:
    """One CSV for each subject: label, flag, i, j, k, then `samples` columns. The subject is the number in the file's name; voxel_id is
    made from the coordinates, so that it is the same in every file."""
    fields = [T.StructField("label", T.StringType()), T.StructField("flag", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in "ijk"], *[T.StructField(f"t{n}", T.DoubleType()) for n in range(samples)]]
    df = spark.read.schema(T.StructType(fields)).csv(paths, header=header)
    subject = F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).cast("int")
    bits = lambda c: F.col(c).cast("long") + (1 << 20)  # noqa: E731  coordinates up to a million either way
    voxel = F.shiftleft(bits("i"), 42).bitwiseOR(F.shiftleft(bits("j"), 21)).bitwiseOR(bits("k"))
    return df.select(subject.alias("subject_id"), voxel.alias("voxel_id"), "i", "j", "k", F.array(*[f"t{n}" for n in range(samples)]).alias("series"))


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATLAS).csv(path, header=True)


def synthetic(spark: SparkSession, subjects: int = 3, voxels: int = 1000, samples: int = 500, seed: int = 0) -> DataFrame:
    """Normal series at random coordinates below 100, made where they are used."""
    v = spark.range(subjects * voxels).select((F.col("id") / voxels).cast("int").alias("subject_id"), (F.col("id") % voxels).alias("voxel_id"))
    at = lambda axis: F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), F.col("voxel_id")), F.lit(100)).cast("int").alias(axis)
    u = lambda tag, t: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), t, "subject_id", "voxel_id"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    series = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda t: F.sqrt(-2 * F.log(u("a", t))) * F.cos(2 * np.pi * u("b", t)))
    return v.select("subject_id", "voxel_id", *[at(a) for a in "ijk"], series.alias("series"))


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as one subject's voxels on an 8 x 8 x n lattice."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [(F.col("vec_id") % 8).cast("int").alias("i"), (F.expr("vec_id div 8") % 8).cast("int").alias("j"), F.expr("vec_id div 64").cast("int").alias("k")]
    return e.select(F.lit(0).alias("subject_id"), F.col("vec_id").alias("voxel_id"), *at, F.transform("embedding", lambda x: x.cast("double")).alias("series"))


def subjects_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three subjects on the same voxels: overlapping windows of 32 samples."""
    v = from_embeddings(spark, sf_dir)
    windows = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(1 + 16 * s).alias("at")) for s in range(3)])).alias("o")
    return v.select("voxel_id", "i", "j", "k", "series", windows).select(F.col("o.s").alias("subject_id"), "voxel_id", "i", "j", "k", F.slice("series", F.col("o.at"), 32).alias("series"))


def series_from_events(spark: SparkSession, sf_dir: str, first: str = "2024-01-01", last: str = "2024-01-30") -> DataFrame:
    """user_id, series: each user's daily sums of value, days without events as zero."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts").cast("date"), F.lit(first).cast("date"))
    sums = e.groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("v"))
    by = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))  # at most one entry a day
    days = F.sequence(F.lit(0), F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")))
    return by.select("user_id", F.transform(days, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("series"))
