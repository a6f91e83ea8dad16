"""Similarity kernels: on an edge list as Column expressions, over all pairs as matrix products of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions.basis import grams
from voxelgraph.functions.series import dot, map_series, matrix, moving_average3, over, srvf, total, with_standardized
from voxelgraph.operators import medians
from voxelgraph.operators.elastic import elastic_distance
from voxelgraph.operators.graph import chosen, degrees
from voxelgraph.operators.pairs import STRIP, dealt, grid, on_edges, packed, tiled_ends, tiled_ends_of, tiled_near, tiled_top, tiled_weights
from voxelgraph.operators.tiled import ROUNDING, TiledGraph
from voxelgraph.storage import durable, release

#: Voxels of a subject whose distances guess where its median is; ranks to either side of the middle that the guess takes in.
GUESS, GUESSED = 4000, 0.015


def kept(r_min: float | None = None, clamp_negative: bool = False) -> Column:
    """One predicate for clamping, threshold and dropping: finite, not zero, at least r_min, positive if clamped."""
    w = F.col("w")
    ok = (w != 0) & ~F.isnan(w) & (F.abs(w) != float("inf"))
    if r_min is not None:
        ok &= w >= r_min
    return ok & (w > 0) if clamp_negative else ok


def finish(weights: DataFrame, r_min: float | None = None, clamp_negative: bool | str = False) -> DataFrame:
    """Weights that are kept. clamp_negative "auto": only in subjects with a negative weight, as the 26-neighbour graph does;
    dropping what isn't positive then equals clamping everywhere, since clamped weights are zero and go."""
    return weights.where(kept(r_min, clamp_negative in (True, "auto")))


def standardize(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    c = x - x.mean(1, keepdims=True)
    sd = np.sqrt((c * c).sum(1, keepdims=True) / max(1, x.shape[1] - 1))
    return c / np.where((sd == 0) | ~np.isfinite(sd), eps, sd)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of standardised rows."""
    w = a @ b.T
    w /= a.shape[1] - 1
    return w


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.clip(0.5 * (a @ b.T / (length + 1e-12) + 1), 0, 1)


def rms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0) / a.shape[1])


def _predicate(r_min: float | None, clamp_negative: bool) -> Callable[[np.ndarray], np.ndarray]:
    def keep(w: np.ndarray) -> np.ndarray:
        if r_min is not None and r_min > 0:
            return (w >= r_min) & (w < np.inf)
        ok = np.isfinite(w) & (w != 0)
        if r_min is not None:
            ok &= w >= r_min
        return ok & (w > 0) if clamp_negative else ok

    return keep


def _far_medians(base: DataFrame, block_size: int) -> dict[int, float]:
    """The exact median of each subject's positive RMS distances over all pairs, counted inside the tiles."""
    longest = base.groupBy("subject_id").agg(F.max(dot(F.col("series"), F.col("series")) / F.size("series")).alias("q"))
    brackets = {int(r.subject_id): (np.nextafter(0, 1), 2 * np.sqrt(r.q) * (1 + 1e-9) + 1e-300) for r in longest.toLocalIterator() if r.q and np.isfinite(r.q)}
    if not brackets:
        return {}
    most, subjects = base.groupBy("subject_id").count().agg(F.max("count"), F.count(F.lit(1))).first()
    parts, n = grid(most, block_size)
    blocks = durable(packed(base.select("subject_id", "voxel_id", "series"), n))  # read in every pass

    def count(now: medians.Brackets) -> dict[int, np.ndarray]:
        def make(subject, i, x, j, y):
            return subject, tile_histogram(i, x, j, y, now[subject]) if subject in now else None

        def fold(made):
            held: dict = {}
            for subject, h in made:
                if h is not None:
                    held[subject] = held.get(subject, 0) + h
            for subject, h in held.items():
                yield [subject], [h]

        return medians.summed(dealt(blocks, make, "subject_id int, hist array<long>", parts, subjects, fold))

    def values(now: medians.Brackets) -> dict[int, np.ndarray]:
        def make(subject, i, x, j, y):
            found = [d for _, _, d in _inside(i, x, j, y, now[subject])] if subject in now else []
            d = np.concatenate([np.zeros(0), *found])
            return np.full(len(d), subject), d[(d >= now[subject][0]) & (d < now[subject][1])] if len(d) else d

        def kept(made):
            for subject, d in made:
                yield subject[: len(d)], d

        got = dealt(blocks, make, "subject_id int, x double", parts, subjects, kept).toPandas()  # medians.LISTED a subject
        return {int(s): g["x"].to_numpy() for s, g in got.groupby("subject_id")}

    out = medians.exact_medians(brackets, count, values, _guessed(base, brackets) if most > 2 * GUESS else None)
    release(blocks)
    return out


def _guessed(base: DataFrame, brackets: medians.Brackets) -> medians.Brackets:
    """Brackets in which the medians of the larger subjects probably lie: quantiles of the distances among about GUESS voxels of each, chosen
    by hash. Where one lies elsewhere, the count finds out."""
    n = base.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * GUESS)
    draw = F.pmod(F.xxhash64("voxel_id", F.lit("guess")), F.lit(1 << 40)) / float(1 << 40)
    some = base.join(F.broadcast(n), "subject_id").where(draw * F.col("_n") < GUESS).select(F.col("subject_id").cast("int").alias("subject_id"), "voxel_id", "series")

    def ends(key: tuple, t: pa.Table) -> pa.Table:
        x = matrix(t.column("series"))
        d = rms(x, x)[np.triu_indices(len(x), 1)]
        d = d[(d > 0) & (d < np.inf)]
        lo, hi = np.quantile(d, [0.5 - GUESSED, 0.5 + GUESSED]) if len(d) else (0.0, 0.0)
        return pa.table({"subject_id": pa.array([key[0].as_py()], pa.int32()), "lo": [float(lo)], "hi": [float(hi)]})

    got = some.groupBy("subject_id").applyInArrow(ends, "subject_id int, lo double, hi double")
    return {r.subject_id: (r.lo, float(np.nextafter(r.hi, np.inf))) for r in got.toLocalIterator() if r.subject_id in brackets and 0 < r.lo < r.hi}


def _inside(i: np.ndarray, x: np.ndarray, j: np.ndarray | None, y: np.ndarray | None, bracket: tuple[float, float]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Strip by strip of a tile's pairs, each once: how many positive distances lie below and above a bracket widened by rounding, and those
    in it. Only of these are roots taken."""
    y, alone = (x, True) if y is None else (y, False)
    t = x.shape[1]
    own, other = (x * x).sum(1), (y * y).sum(1)
    lo, hi = (t * e * e * (1 + off) for e, off in zip(bracket, (-1e-12, 1e-12)))
    for s in range(0, len(x), STRIP):
        rows = slice(s, s + STRIP)
        d = x[rows] @ y.T
        d *= -2
        d += own[rows, None] + other
        if alone:
            d[i[rows, None] >= i[None, :]] = 0  # counted from the other side, or a voxel and itself
        above, least = d >= hi, d >= lo if lo > 0 else d > 0
        low = np.count_nonzero(d > 0) - np.count_nonzero(least)
        yield low, np.count_nonzero(above), np.sqrt(d[least & ~above] / t)


def tile_histogram(i: np.ndarray, x: np.ndarray, j: np.ndarray | None, y: np.ndarray | None, bracket: tuple[float, float]) -> np.ndarray:
    """medians.histogram() of the positive distances of a tile's pairs, and how many lie above the bracket."""
    out = np.zeros(medians.BINS + 2, np.int64)
    for low, above, d in _inside(i, x, j, y, bracket):
        h = medians.histogram(d, bracket)
        out[:-1] += h
        out[0] += low
        out[-1] += above + len(d) - h.sum()
    return out


def _prepared(voxels: DataFrame, method: str | Callable, prestandardized: bool, block_size: int, sigma: float | None, shape: str, ridge: float) -> tuple[DataFrame, Callable, Callable | None]:
    """What tiles work on, their kernel, and what becomes of its values."""
    if callable(method):
        return voxels, method, None
    if method not in ("correlation", "cosine", "l2", "srvf", "partial"):
        raise ValueError(f"unknown kernel {method}")
    if shape not in ("rbf", "inv", "none"):
        raise ValueError("shape is rbf, inv or none")
    base = voxels
    if method in ("correlation", "l2") and not prestandardized:
        base = map_series(voxels, standardize)
    if method == "correlation":
        return base, correlation, None
    if method == "cosine":
        return base, cosine, None
    if method == "partial":
        z = base if prestandardized else map_series(voxels, standardize)
        solved = partial_solved(z, ridge)
        root = F.sqrt(F.greatest(1 - F.col("a") / ridge, F.lit(1e-12)))
        both = F.concat(over(F.col("u"), root), over(F.col("st"), root * ridge))
        half = lambda a, b: np.clip(a[:, : a.shape[1] // 2] @ b[:, a.shape[1] // 2 :].T, -1, 1)
        return solved.select("subject_id", "voxel_id", both.alias("series")), half, None
    if method == "srvf":
        base = voxels.withColumn("series", srvf(F.col("series")))
    if shape == "none":
        return base, rms, None
    base = durable(base.select("subject_id", "voxel_id", "series"))  # read for the median and for the weights
    scale = {} if sigma is not None else _far_medians(base, block_size)
    size = lambda s: float(sigma) if sigma is not None else scale.get(s, 1.0)
    if shape == "inv":
        return base, rms, lambda s, d: 1 / (1 + d / size(s))
    return base, rms, lambda s, d: np.exp(-(d * d) / (2 * size(s) ** 2))


def all_pairs(voxels: DataFrame, method: str | Callable = "correlation", r_min: float | None = None, clamp_negative: bool = False, prestandardized: bool = False, block_size: int = 2048, sigma: float | None = None, shape: str = "rbf", ridge: float = 1.0) -> DataFrame:
    """subject_id, i_idx, j_idx, w over all pairs. method: correlation, cosine, partial (with ridge), l2 (of standardised series), srvf
    (of square-root velocities), or a function of two matrices. Distances become weights by shape (rbf, inv or none), scaled by sigma or
    the subject's exact median. Series are prepared once, before they are dealt to tiles."""
    base, kernel, finish = _prepared(voxels, method, prestandardized, block_size, sigma, shape, ridge)
    return tiled_weights(base, kernel, _predicate(r_min, clamp_negative), block_size, finish=finish)


def all_pairs_graph(voxels: DataFrame, method: str | Callable = "correlation", r_min: float | None = None, clamp_negative: bool = False, prestandardized: bool = False, block_size: int = 2048, sigma: float | None = None, shape: str = "rbf", ridge: float = 1.0) -> TiledGraph:
    """The graph of all_pairs() without its edges: what spectral clustering multiplies."""
    base, kernel, finish = _prepared(voxels, method, prestandardized, block_size, sigma, shape, ridge)
    error = _rounding(method, shape, finish)
    return TiledGraph(durable(base.select("subject_id", "voxel_id", "series")), kernel, _predicate(r_min, clamp_negative), finish, block_size, error=error, cut=r_min)


def _rounding(method: str | Callable, shape: str, finish: Callable | None) -> Callable[[int, np.ndarray, np.ndarray], float] | None:
    """How far a kernel's weights of two matrices may be off in single precision: a bound from the rows' lengths. None: not known."""
    longest = lambda x: float(np.sqrt((x * x).sum(1).max()))
    if method == "correlation":
        return lambda s, x, y: ROUNDING * (x.shape[1] + 4) * longest(x) * longest(y) / (x.shape[1] - 1)
    if method in ("l2", "srvf") and shape == "rbf":  # exp(-t / 2 scale^2) changes by t's change over 2 scale^2 at most
        return lambda s, x, y: ROUNDING * (8 - np.log(finish(s, 1.0)) * (x.shape[1] + 8) * (longest(x) + longest(y)) ** 2 / x.shape[1])
    return None


def all_pairs_top(voxels: DataFrame, k: int, method: str | Callable = "correlation", r_min: float | None = None, symmetry: str = "upper", block_size: int = 2048, **more) -> DataFrame:
    """graph.top_k() of all_pairs() with positive weights, chosen inside the tiles: no more rows than k times blocks a voxel are made."""
    given = {"prestandardized": False, "sigma": None, "shape": "rbf", "ridge": 1.0} | more
    base, kernel, finish = _prepared(voxels, method, block_size=block_size, **given)
    return chosen(tiled_top(base, kernel, _predicate(r_min, True), k, block_size, finish=finish), symmetry)


def correlation_ends(voxels: DataFrame, labels: DataFrame, r_min: float | None = None, block_size: int = 2048) -> DataFrame:
    """subject_id, li, lj, w: weights of the Pearson graph of each subject, summed by the clusters of both ends (see metrics)."""
    return tiled_ends(map_series(voxels, standardize), labels, correlation, _predicate(r_min, False), block_size)


def correlation_ends_of(voxels: DataFrame, labellings: list[DataFrame], r_min: float | None = None, block_size: int = 2048) -> list[DataFrame]:
    """correlation_ends() of several labellings, written in one pass over the pairs."""
    ends = durable(tiled_ends_of(map_series(voxels, standardize), labellings, correlation, _predicate(r_min, False), block_size))
    return [ends.where(F.col("labelling") == n).drop("labelling") for n in range(len(labellings))]


def correlation_near(voxels: DataFrame, labels: DataFrame, r_min: float | None = None, block_size: int = 2048) -> DataFrame:
    """subject_id, node, label, near, sum, n of the Pearson graph of each subject: each node's weights by the cluster of the other end."""
    return tiled_near(map_series(voxels, standardize), labels, correlation, _predicate(r_min, False), block_size)


def correlation_normalized(voxels: DataFrame, r_min: float | None = None, block_size: int = 2048) -> DataFrame:
    """graph.normalized() of the Pearson graph: strengths are summed first, then travel with the series, so that no edge is shuffled."""
    base = durable(map_series(voxels, standardize).select("subject_id", "voxel_id", "series"))
    strength = degrees(tiled_weights(base, correlation, _predicate(r_min, False), block_size)).where("strength > 0").select("subject_id", "voxel_id", "strength")
    rows = base.join(durable(strength), ["subject_id", "voxel_id"]).select("subject_id", "voxel_id", F.concat("series", F.array("strength")).alias("series"))

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w = correlation(a[:, :-1], b[:, :-1])
        return np.where(_predicate(r_min, False)(w), w / np.sqrt(a[:, -1][:, None] * b[:, -1][None, :]), 0.0)

    return tiled_weights(rows, kernel, _predicate(None, False), block_size)


def _two_samples(voxels: DataFrame) -> None:
    short = voxels.agg(F.min(F.size("series"))).first()[0]
    if short is not None and short < 2:
        raise ValueError("series need two samples at least")


def correlation_graph(voxels: DataFrame, *, prestandardized: bool = False, block_size: int | None = None, chunk_size: int | None = None, n_jobs: int | None = None, r_min: float | None = None, clamp_negative: bool = False) -> TiledGraph:
    """correlation_adjacency() without its edges."""
    _two_samples(voxels)
    return all_pairs_graph(voxels, "correlation", r_min, clamp_negative, prestandardized, chunk_size or block_size or 2048)


def correlation_adjacency(voxels: DataFrame, *, prestandardized: bool = False, block_size: int | None = None, chunk_size: int | None = None, n_jobs: int | None = None, r_min: float | None = None, clamp_negative: bool = False) -> DataFrame:
    """Pearson graph of each subject, upper triangle. chunk_size is another name of block_size and wins here; n_jobs is accepted
    and ignored: Spark schedules. A series of fewer than two samples is refused."""
    _two_samples(voxels)
    return all_pairs(voxels, "correlation", r_min, clamp_negative, prestandardized, chunk_size or block_size or 2048)


def resolve_correlation_hyper(hyper: dict | None) -> dict:
    """Defaults filled in; chunk_size stands for block_size only where that is absent."""
    known = {"prestandardized": False, "block_size": 512, "n_jobs": None, "r_min": None, "clamp_negative": False}
    given = dict(hyper or {})
    if "chunk_size" in given and "block_size" not in given:
        given["block_size"] = given.pop("chunk_size")
    if unknown := set(given) - set(known) - {"chunk_size"}:
        raise TypeError(f"unknown hyperparameters: {sorted(unknown)}")
    return known | given


# Edge lists.


def edge_correlation(voxels: DataFrame, edges: DataFrame, prestandardized: bool = False) -> DataFrame:
    z = voxels.withColumn("z", F.col("series")) if prestandardized else with_standardized(voxels)
    e = on_edges(z, edges, ["z"])
    return e.select("subject_id", "i_idx", "j_idx", (dot(F.col("z_i"), F.col("z_j")) / (F.size("z_i") - 1)).alias("w"))


def edge_cosine(voxels: DataFrame, edges: DataFrame, standardized: bool = False) -> DataFrame:
    z = with_standardized(voxels) if standardized else voxels.withColumn("z", F.col("series"))
    z = z.withColumn("q", dot(F.col("z"), F.col("z")))
    e = on_edges(z, edges, ["z", "q"])
    c = dot(F.col("z_i"), F.col("z_j")) / (F.sqrt("q_i") * F.sqrt("q_j") + 1e-12)
    return e.select("subject_id", "i_idx", "j_idx", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (c + 1))).alias("w"))


def _squares(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def edge_l2(voxels: DataFrame, edges: DataFrame, standardized: bool = True) -> DataFrame:
    """RMS distance as w: see distance_to_weight."""
    z = with_standardized(voxels) if standardized else voxels.withColumn("z", F.col("series"))
    e = on_edges(z, edges, ["z"])
    return e.select("subject_id", "i_idx", "j_idx", F.sqrt(_squares(F.col("z_i"), F.col("z_j")) / F.size("z_i")).alias("w"))


def edge_srvf(voxels: DataFrame, edges: DataFrame, smooth: bool = False, eps: float = 1e-8, warp: str = "none", penalty: float = 0.0) -> DataFrame:
    """RMS distance of square-root velocities, unaligned, along the best time warp (warp "dtw"), or least over warps that stretch the
    velocities with them ("elastic", with a penalty on warping; see elastic)."""
    x = moving_average3(F.col("series")) if smooth else F.col("series")
    q = voxels.withColumn("_x", x).withColumn("q", srvf(F.col("_x"), eps=eps))
    e = on_edges(q, edges, ["q"])
    if warp == "none":
        return e.select("subject_id", "i_idx", "j_idx", F.sqrt(_squares(F.col("q_i"), F.col("q_j")) / F.size("q_i")).alias("w"))
    if warp not in ("dtw", "elastic"):
        raise ValueError("warp is none, dtw or elastic")
    far = dtw_rms if warp == "dtw" else lambda a, b: elastic_distance(a, b, penalty=penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = far(matrix(b.column("q_i")), matrix(b.column("q_j")))
                yield pa.RecordBatch.from_arrays([b.column("subject_id"), b.column("i_idx"), b.column("j_idx"), pa.array(w)], names=["subject_id", "i_idx", "j_idx", "w"])

    kinds = dict(e.dtypes)
    return e.select("subject_id", "i_idx", "j_idx", "q_i", "q_j").mapInArrow(run, f"subject_id {kinds['subject_id']}, i_idx long, j_idx long, w double")


def dtw_rms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row pair: root mean square difference along the symmetric2 warp (a diagonal step counts its cost twice). All pairs
    of a batch advance together, cell by cell; a batch is cut so that its tables hold four million cells at most, or one pair."""
    n, t, s = len(a), a.shape[1], b.shape[1]
    most = max(1, 4_000_000 // max(1, t * s))
    if n > most:
        return np.concatenate([dtw_rms(a[at : at + most], b[at : at + most]) for at in range(0, n, most)])
    cost = np.abs(a[:, :, None] - b[:, None, :])
    best, came = np.full((n, t, s), np.inf), np.zeros((n, t, s), np.int8)
    best[:, 0, 0] = cost[:, 0, 0]
    for i in range(t):
        for j in range(s):
            if i or j:
                steps = np.stack([best[:, i - 1, j - 1] + 2 * cost[:, i, j] if i and j else np.full(n, np.inf), best[:, i - 1, j] + cost[:, i, j] if i else np.full(n, np.inf), best[:, i, j - 1] + cost[:, i, j] if j else np.full(n, np.inf)])
                came[:, i, j] = steps.argmin(0)
                best[:, i, j] = steps.min(0)
    rows, i, j = np.arange(n), np.full(n, t - 1), np.full(n, s - 1)
    square, length = cost[rows, i, j] ** 2, np.ones(n)
    while (live := (i > 0) | (j > 0)).any():
        c = came[rows, i, j]
        i, j = np.where(live & (c != 2), i - 1, i), np.where(live & (c != 1), j - 1, j)
        square += np.where(live, cost[rows, i, j] ** 2, 0)
        length += live
    return np.sqrt(square / length)


def pilot_scale(distances: DataFrame) -> DataFrame:
    """subject_id, scale: exact median of positive distances, 1 where there is none. The same for any blocking, unlike a sample; found by
    counting, so no subject's distances are gathered."""
    found = medians.table_medians(distances)
    scales = distances.sparkSession.createDataFrame([(s, m) for s, m in found.items()], "subject_id int, _m double")
    subjects = distances.select("subject_id").distinct()
    return subjects.join(F.broadcast(scales), "subject_id", "left").select("subject_id", F.coalesce("_m", F.lit(1.0)).alias("scale"))


def distance_to_weight(distances: DataFrame, method: str = "rbf", scale: float | None = None) -> DataFrame:
    """rbf: exp(-d^2 / 2 scale^2); inv: 1 / (1 + d / scale); none: d. Without a scale, each subject's median."""
    if method == "none":
        return distances
    d = distances.withColumn("scale", F.lit(float(scale))) if scale is not None else distances.join(F.broadcast(pilot_scale(distances)), "subject_id")
    w = {"rbf": F.exp(-F.col("w") * F.col("w") / (2 * F.col("scale") * F.col("scale"))), "inv": 1 / (1 + F.col("w") / F.col("scale"))}[method]
    return d.withColumn("w", w).drop("scale")


def partial_solved(z: DataFrame, ridge: float = 1.0) -> DataFrame:
    """subject_id, voxel_id, u, st, a of standardised series: what partial correlations of any pair are made of. By the Woodbury identity
    only B = I + U'U / ridge (T x T, U = Z / sqrt(T - 1)) is inverted, on the driver; solving is then a row-wise linear map."""
    inverse = {}
    for row in grams(z).toLocalIterator():
        t = len(row.sums)
        inverse[row.subject_id] = np.linalg.inv(np.eye(t) + np.array(row.gram).reshape(t, t) / (t - 1) / ridge)
    shared = z.sparkSession.sparkContext.broadcast(inverse)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voxelgraph.functions.series import lists

        for b in batches:
            s = np.asarray(b.column(0))
            for k in np.unique(s):
                part = b.filter(pa.array(s == k))
                u = matrix(part.column(2))
                u = u / np.sqrt(u.shape[1] - 1)
                st = u @ shared.value[int(k)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(u), lists(st), pa.array((u * st).sum(1))], names=["subject_id", "voxel_id", "u", "st", "a"])

    return z.selectExpr("cast(subject_id as int) subject_id", "voxel_id", "series").mapInArrow(solve, "subject_id int, voxel_id long, u array<double>, st array<double>, a double")


def edge_partial_correlation(voxels: DataFrame, edges: DataFrame, prestandardized: bool = True, ridge: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Ridge partial correlation of the pairs in edges."""

    def guard(x: np.ndarray) -> np.ndarray:
        c = x - x.mean(1, keepdims=True)
        return c / np.sqrt(np.maximum((c * c).sum(1, keepdims=True) / max(1, x.shape[1] - 1), 1e-12))

    z = voxels if prestandardized else map_series(voxels, guard)
    solved = partial_solved(z, ridge)
    e = on_edges(solved, edges, ["u", "st", "a"])
    free = lambda a: F.greatest(1 - F.col(a) / ridge, F.lit(eps))
    w = dot(F.col("u_i"), F.col("st_j")) / ridge / F.sqrt(free("a_i") * free("a_j"))
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))
    return e.select("subject_id", "i_idx", "j_idx", F.when(F.col("i_idx") == F.col("j_idx"), 0.0).otherwise(w).alias("w"))
