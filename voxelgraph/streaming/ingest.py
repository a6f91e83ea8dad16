"""Subjects that arrive as Parquet files, prepared as they come.

Preparation is a map over rows, so the stream keeps no state: every micro-batch is standardised or smoothed and appended by
subject. The checkpoint makes each file count once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelgraph.sources.voxels import VOXELS


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(VOXELS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepare(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing step(stream) to out; once: take what is there and stop."""
    writer = step(stream).writeStream.format("parquet").partitionBy("subject_id").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
