"""B-spline bases and functional principal components: small matrices on the driver, projections as linear maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelgraph.functions.series import linear_map, lists, matrix


def bspline(points: np.ndarray, interior: int, order: int = 4, derivative: int = 0) -> np.ndarray:
    """(points, interior + order) values, or derivatives, of the B-splines of that order on [0, 1] with equal breaks."""
    breaks = np.linspace(0, 1, interior + 2)
    knots = np.concatenate([np.zeros(order - 1), breaks, np.ones(order - 1)])
    x = np.asarray(points, float)
    cell = np.clip(np.searchsorted(knots, x, side="right") - 1, order - 1, len(knots) - order - 1)
    b = np.zeros((len(x), len(knots) - 1))
    b[np.arange(len(x)), cell] = 1
    for k in range(2, order - derivative + 1):  # Cox-de Boor up to the order that is left
        n = len(knots) - k
        a, c = knots[k - 1 : k - 1 + n] - knots[:n], knots[k : k + n] - knots[1 : 1 + n]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(a > 0, (x[:, None] - knots[:n]) / a, 0)
            right = np.where(c > 0, (knots[k : k + n] - x[:, None]) / c, 0)
        b = left * b[:, :n] + right * b[:, 1 : n + 1]
    for k in range(order - derivative + 1, order + 1):  # then differentiate
        n = len(knots) - k
        a, c = knots[k - 1 : k - 1 + n] - knots[:n], knots[k : k + n] - knots[1 : 1 + n]
        with np.errstate(divide="ignore", invalid="ignore"):
            b = np.where(a > 0, (k - 1) / a, 0) * b[:, :n] - np.where(c > 0, (k - 1) / c, 0) * b[:, 1 : n + 1]
    return b


def bspline_projection(t: int, interior: int = 60, order: int = 4, penalty: float = 1e-8, penalised: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """coefficients = P @ series, and the basis at the t sample points. Penalised least squares; the roughness matrix is the
    integral of products of derivatives, exact by Gauss quadrature in each break interval."""
    phi = bspline(np.linspace(0, 1, t), interior, order)
    node, weight = np.polynomial.legendre.leggauss(order)
    breaks = np.linspace(0, 1, interior + 2)
    half = np.diff(breaks) / 2
    x = (breaks[:-1] + half)[:, None] + half[:, None] * node
    d = bspline(x.ravel(), interior, order, penalised)
    rough = d.T @ (d * (half[:, None] * weight).ravel()[:, None])
    return np.linalg.solve(phi.T @ phi + penalty * rough, phi.T), phi


def _length(df: DataFrame, series: str) -> int:
    first = df.select(series).where(f"{series} is not null").first()
    return len(first[0]) if first else 0


def bspline_coefficients(df: DataFrame, interior: int = 60, order: int = 4, penalty: float = 1e-8, penalised: int = 2, series: str = "series") -> DataFrame:
    """series becomes its interior + order coefficients."""
    t = _length(df, series)
    return linear_map(df, bspline_projection(t, interior, order, penalty, penalised)[0], series) if t else df


def bspline_reconstruction(df: DataFrame, t: int, interior: int = 60, order: int = 4, series: str = "series") -> DataFrame:
    """Coefficients back to t samples."""
    return linear_map(df, bspline(np.linspace(0, 1, t), interior, order), series)


def grams(df: DataFrame, series: str = "series") -> DataFrame:
    """subject_id, n, sums (T), gram (T x T, row by row) of each subject: one partial result a batch and subject, then summed.
    A partial is T x T whatever the number of voxels, so the shuffle doesn't grow with the rows of a task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if b.num_rows:
                s = np.asarray(b.column(0))
                for k in np.unique(s):
                    y = matrix(b.column(1).filter(pa.array(s == k)))  # subjects may differ in length
                    old = held.get(int(k), (0, 0, 0))
                    held[int(k)] = (old[0] + len(y), old[1] + y.sum(0), old[2] + y.T @ y)
        for k, (n, total, g) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), lists(total[None, :]), lists(g.reshape(1, -1))], names=["subject_id", "n", "sums", "gram"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, g = 0, 0, 0
        for b in batches:
            n, total, g = n + sum(b.column("n").to_pylist()), total + matrix(b.column("sums")).sum(0), g + matrix(b.column("gram")).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), lists(total[None, :]), lists(g[None, :])], names=["subject_id", "n", "sums", "gram"])

    schema = "subject_id int, n long, sums array<double>, gram array<double>"
    partial = df.selectExpr("cast(subject_id as int) subject_id", series).mapInArrow(part, schema)
    return partial.groupBy("subject_id").applyInArrow(join, schema)


def principal_components(df: DataFrame, components: int = 60, center: bool = False, scale: bool = False, series: str = "series") -> dict[int, dict]:
    """For each subject: vectors (T x K), eigenvalues, var_explained, mu, sd. The second moment is X'X / (n - 1) of the series as they are, or centred or
    scaled on request; signs make each vector's largest entry positive. T x T numbers of each subject reach the driver."""
    out = {}
    for row in grams(df, series).toLocalIterator():
        n, total, t = row.n, np.array(row.sums), len(row.sums)
        g = np.array(row.gram).reshape(t, t)
        mu = total / n if center else np.zeros(t)
        second = g - np.outer(total, mu) - np.outer(mu, total) + n * np.outer(mu, mu)
        sd = np.ones(t)
        if scale:
            mean = total / n
            sd = np.sqrt(np.maximum(np.diag(g) - n * mean**2, 0) / max(n - 1, 1))
            sd[(sd == 0) | ~np.isfinite(sd)] = 1
        s = second / np.outer(sd, sd) / max(n - 1, 1)
        value, vector = np.linalg.eigh(s)
        k = min(components, t)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(k)] < 0, -1, 1)
        out[row.subject_id] = {"vectors": vector, "eigenvalues": value, "var_explained": value / np.trace(s), "mu": mu, "sd": sd}
    return out


def fpca_loadings(df: DataFrame, components: int = 60, center: bool = False, scale: bool = False, series: str = "series", models: dict | None = None) -> DataFrame:
    """series becomes its loadings on its subject's components."""
    return _by_subject(df, models or principal_components(df, components, center, scale, series), series, lambda x, m: ((x - m["mu"]) / m["sd"]) @ m["vectors"])


def fpca_reconstruction(df: DataFrame, models: dict, series: str = "series") -> DataFrame:
    """Series projected on the components and back; the mean is left aside, as the reference does."""
    return _by_subject(df, models, series, lambda x, m: (x @ m["vectors"]) @ m["vectors"].T)


def _by_subject(df: DataFrame, models: dict, series: str, fn) -> DataFrame:
    shared, at = df.sparkSession.sparkContext.broadcast(models), df.columns.index(series)
    who = df.columns.index("subject_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.asarray(b.column(who))
            for k in np.unique(s):
                part = b.filter(pa.array(s == k))
                columns = part.columns
                columns[at] = lists(fn(matrix(columns[at]), shared.value[int(k)]))
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {'array<double>' if n == series else t}" for n, t in df.dtypes))


def fpca_table(spark, models: dict) -> DataFrame:
    """subject_id, component, eigenvalue, var_explained, vector."""
    rows = [(int(s), c + 1, float(m["eigenvalues"][c]), float(m["var_explained"][c]), m["vectors"][:, c].tolist()) for s, m in models.items() for c in range(len(m["eigenvalues"]))]
    return spark.createDataFrame(rows, "subject_id int, component int, eigenvalue double, var_explained double, vector array<double>")
