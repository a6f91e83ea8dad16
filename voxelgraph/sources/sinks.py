"""Where results go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_voxels(voxels: DataFrame, path: str) -> None:
    """Parquet by subject, so that a query on some subjects reads only theirs."""
    voxels.write.mode("overwrite").partitionBy("subject_id").parquet(path)


def write_csv(report: DataFrame, path: str) -> None:
    """A report (subject_id, method, k_level, dice, say) as CSV with a header."""
    report.write.mode("overwrite").csv(path, header=True)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def history_rows(spark: SparkSession, history: list[dict]) -> DataFrame:
    """step, ts (UTC, to the second, with Z), payload (JSON)."""
    rows = [(h["step"], h["ts"], json.dumps(h["payload"], default=str)) for h in history]
    return spark.createDataFrame(rows, "step string, ts string, payload string")


def append_history(spark: SparkSession, step: str, payload: dict, path: str) -> None:
    row = spark.createDataFrame([(step, json.dumps(payload, default=str))], "step string, payload string")
    row.select("step", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "payload").write.mode("append").parquet(path)
