"""Functions on a series column (ARRAY<DOUBLE>): native ones as Column expressions, heavy ones as Arrow batch maps.

A scalar that a lambda needs (a mean, say) is passed as an array beside the series, since the optimiser would otherwise put the
scalar's own aggregation inside the lambda and compute it for every element.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FWHM of a Gaussian in standard deviations, as the reference spells it.
FWHM = 2.354820045


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def minus(x: Column, scalar: Column) -> Column:
    return F.zip_with(x, F.array_repeat(scalar, F.size(x)), lambda v, m: v - m)


def over(x: Column, scalar: Column) -> Column:
    return F.zip_with(x, F.array_repeat(scalar, F.size(x)), lambda v, m: v / m)


def with_standardized(df: DataFrame, series: str = "series", out: str = "z", eps: float = 1e-8) -> DataFrame:
    """(x - mean) / sd with ddof 1; a standard deviation that is zero or not finite counts as eps, so a constant row gives zeros."""
    c = df.withColumn("_c", minus(F.col(series), total(F.col(series)) / F.size(series)))
    sd = F.sqrt(dot(F.col("_c"), F.col("_c")) / (F.size("_c") - 1))
    guarded = F.when(sd.isNull() | F.isnan(sd) | (sd == 0) | (sd == float("inf")), F.lit(eps)).otherwise(sd)
    return c.withColumn(out, over(F.col("_c"), guarded)).drop("_c")


def srvf(x: Column, dt: float = 1.0, eps: float = 1e-8) -> Column:
    """Square-root velocity: central differences (one-sided at both ends, so the length stays) over sqrt(|d| + eps)."""
    n = F.size(x)
    at = F.sequence(F.lit(1), n)
    up = F.transform(at, lambda t: F.element_at(x, F.least(t + 1, n).cast("int")))
    down = F.transform(at, lambda t: F.element_at(x, F.greatest(t - 1, F.lit(1)).cast("int")))
    span = F.transform(at, lambda t: F.when((t == 1) | (t == n), 1.0).otherwise(2.0))
    d = F.transform(F.arrays_zip(up.alias("u"), down.alias("l"), span.alias("s")), lambda r: (r["u"] - r["l"]) / r["s"] / dt)
    return F.transform(d, lambda v: v / F.sqrt(F.abs(v) + eps))


def moving_average3(x: Column) -> Column:
    """Three-point moving average; both ends keep the raw value."""
    n = F.size(x)
    return F.transform(F.sequence(F.lit(1), n), lambda t: F.when((t == 1) | (t == n), F.element_at(x, t.cast("int"))).otherwise((F.element_at(x, F.greatest(t - 1, F.lit(1)).cast("int")) + F.element_at(x, t.cast("int")) + F.element_at(x, F.least(t + 1, n).cast("int"))) / 3))


def fwhm_to_sigma(fwhm: float) -> float:
    return fwhm / FWHM


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> np.ndarray:
    if sigma <= 0:
        return np.ones(1)
    r = math.ceil(truncate * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def smoothing_matrix(n: int, kernel: np.ndarray, edge_mode: str = "mirror") -> np.ndarray:
    """(n, n): smoothed = M @ x. mirror: half-sample mirror at both ends; r_compat: the last samples are appended unreversed."""
    r, out = len(kernel) // 2, np.zeros((n, n))
    for t in range(n):
        for o in range(-r, r + 1):
            q = t + o
            if edge_mode == "r_compat" and q >= n:
                q = max(0, q - min(r, n))  # the appended tail is the last r samples in order
            m = q % (2 * n)
            out[t, m if m < n else 2 * n - 1 - m] += kernel[o + r]
    return out


def matrix(col: pa.Array) -> np.ndarray:
    """(rows, T) float64 from lists of one length; nulls inside become NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    size = np.asarray(col.value_lengths().fill_null(-1))
    if (size != size[0]).any() or size[0] < 0:
        raise ValueError("series of a table must have one length")
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), size[0])


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32), pa.array(np.ascontiguousarray(x).ravel()))


def map_series(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], series: str = "series") -> DataFrame:
    """The same table with fn applied to the series of a batch of rows, as a (rows, T) matrix. Map only: no shuffle."""
    at = df.columns.index(series)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = b.columns
                columns[at] = lists(np.asarray(fn(matrix(columns[at])), float))
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    schema = ", ".join(f"`{n}` {'array<double>' if n == series else t}" for n, t in df.dtypes)
    return df.mapInArrow(run, schema)


def gaussian_smooth(df: DataFrame, fwhm_samples: float = 3.0, truncate: float = 3.0, edge_mode: str = "mirror", series: str = "series") -> DataFrame:
    """Gaussian smoothing along time. The banded matrix depends on T alone and is built once in a task."""
    kernel, made = gaussian_kernel(fwhm_to_sigma(fwhm_samples), truncate), {}

    def fn(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n not in made:
            made[n] = smoothing_matrix(n, kernel, edge_mode).T
        return x @ made[n]

    return map_series(df, fn, series)


def linear_map(df: DataFrame, m: np.ndarray, series: str = "series") -> DataFrame:
    """series <- m @ series. m is (out, T): its size is fixed by T, so it travels with the job."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(m, float))
    return map_series(df, lambda x: x @ shared.value.T, series)
