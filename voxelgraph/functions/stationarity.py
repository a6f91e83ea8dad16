"""Augmented Dickey-Fuller test of every series: batches of regressions with intercept, trend and lagged differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions.series import matrix

# Critical values of the statistic with intercept and trend, by sample size (rows) and lower-tail probability (columns).
SIZES = [25, 50, 100, 250, 500, 100_000]
PROBABILITIES = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
CRITICAL = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]


def lags(n: int) -> int:
    """The usual number of lagged differences for a series of n samples."""
    return int(np.floor((n - 1) ** (1 / 3) + 1e-9))


def statistics(x: np.ndarray, k: int | None = None) -> np.ndarray:
    """The test statistic of each row of x; NaN where the regression has no unique answer (a constant series, or one too short)."""
    n = x.shape[1]
    k = lags(n) if k is None else k
    d = np.diff(x, axis=1)
    rows, columns = d.shape[1] - k, 3 + k
    out = np.full(len(x), np.nan)
    if rows <= columns or not len(x):
        return out
    design = np.empty((len(x), rows, columns))
    design[:, :, 0] = x[:, k : k + rows] - x[:, k : k + rows].mean(1, keepdims=True)  # the statistic doesn't depend on the level
    design[:, :, 1] = 1
    design[:, :, 2] = np.linspace(-1, 1, rows)
    for lag in range(1, k + 1):
        design[:, :, 2 + lag] = d[:, k - lag : k - lag + rows]
    y = d[:, k:]
    size = np.linalg.norm(design, axis=1)
    ok = (size > 0).all(1) & np.isfinite(x).all(1)
    scaled = design[ok] / size[ok][:, None, :]
    gram = np.einsum("irc,ird->icd", scaled, scaled)
    fits = np.linalg.cond(gram) < 1e12
    at = np.flatnonzero(ok)[fits]
    gram, scaled, y = gram[fits], scaled[fits], y[at]
    inverse = np.linalg.inv(gram)
    beta = np.einsum("icd,id->ic", inverse, np.einsum("irc,ir->ic", scaled, y))
    rest = ((y - np.einsum("irc,ic->ir", scaled, beta)) ** 2).sum(1) / (rows - columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[at] = beta[:, 0] / np.sqrt(rest * inverse[:, 0, 0])
    return out


def p_values(stat: np.ndarray, n: int) -> np.ndarray:
    """Interpolated from the table, by size and by probability; at most 0.99 and at least 0.01."""
    table = [np.interp(n, SIZES, c) for c in np.array(CRITICAL).T]
    return np.where(np.isnan(stat), np.nan, np.interp(stat, table, PROBABILITIES))


def adf_test(voxels: DataFrame, k: int | None = None, batch: int = 512) -> DataFrame:
    """subject_id, voxel_id, statistic, p_value of each series, against the alternative that it is stationary. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = matrix(part.column("series"))
                stat = statistics(x, k)
                yield pa.RecordBatch.from_arrays([part.column("subject_id"), part.column("voxel_id"), pa.array(stat), pa.array(p_values(stat, x.shape[1] - 1))], names=["subject_id", "voxel_id", "statistic", "p_value"])

    return voxels.select(F.col("subject_id").cast("int").alias("subject_id"), F.col("voxel_id").cast("long").alias("voxel_id"), "series").mapInArrow(run, "subject_id int, voxel_id long, statistic double, p_value double")


def stationary_counts(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """subject_id, n, n_stationary: series with a p-value below level; those without one don't count."""
    p = F.col("p_value")
    return tests.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan(p) & (p < level)).alias("n_stationary"))
