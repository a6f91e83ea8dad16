"""Kernels, graphs, clustering and metrics on small hand-made fixtures, against numpy; every semantic decision has a case."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelgraph.functions import basis
from voxelgraph.functions.series import gaussian_kernel, gaussian_smooth, matrix, smoothing_matrix, with_standardized
from voxelgraph.operators import consensus, graph, greedy, kernels, metrics, pairs, spectral, tables
from voxelgraph.operators.pairs import edges26
from voxelgraph.operators.spectral import eigenvectors, randomized_eigenvectors, resolve_spectral_hyper, spectral_clustering
from voxelgraph.plans import queries as registered, registry
from voxelgraph.plans.pipeline import Pipeline
from voxelgraph.sources import sinks, voxels as sources
from voxelgraph.streaming import ingest

NAN = float("nan")


def make(spark, x, coord=None):
    x = np.asarray(x, float)
    x = x if x.ndim == 3 else x[None]
    coord = coord if coord is not None else [(n, 0, 0) for n in range(x.shape[1])]
    return sources.from_arrays(spark, x, np.array(coord))


def small(seed=7, v=12, t=20, s=1):
    return np.random.default_rng(seed).normal(size=(s, v, t))


def edge_map(df):
    return {(r.i_idx, r.j_idx): r.w for r in df.collect()}


def blocks(spark, subjects=1):
    """Three dense blocks of six nodes, weak links between them, and node 18 alone."""
    rows = []
    for s in range(subjects):
        for a in range(18):
            for b in range(a + 1, 18):
                if a // 6 == b // 6:
                    rows.append((s, a, b, 0.9))
                elif (a + b) % 7 == 0:
                    rows.append((s, a, b, 0.05))
    w = spark.createDataFrame(rows, "subject_id int, i_idx long, j_idx long, w double")
    v = spark.range(19).select(F.explode(F.sequence(F.lit(0), F.lit(subjects - 1))).alias("subject_id"), F.col("id").alias("voxel_id"))
    return w, v


def planted(labels):
    got = {r.voxel_id: r.label for r in labels.where("subject_id = 0").collect()}
    return got[18] == 0 and [got[n] for n in range(18)] == [1] * 6 + [2] * 6 + [3] * 6


def test_correlation_matches_numpy_for_any_tiling(spark):
    x = small(s=2)
    want = [np.corrcoef(y) for y in x]
    for size in (3, 100):
        got = kernels.correlation_adjacency(make(spark, x), block_size=size).collect()
        assert len(got) == 2 * 66
        assert all(r.i_idx < r.j_idx and abs(r.w - want[r.subject_id][r.i_idx, r.j_idx]) < 1e-9 for r in got)


def test_constant_and_nan_rows_make_no_edges(spark):
    x = small(v=4, t=6)
    x[0, 1], x[0, 2, 3] = 5, NAN
    assert set(edge_map(kernels.correlation_adjacency(make(spark, x)))) == {(0, 3)}
    z = {r.voxel_id: r.z for r in with_standardized(make(spark, x)).collect()}
    assert z[1] == [0.0] * 6
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "i_idx long, j_idx long")
    assert set(edge_map(kernels.finish(kernels.edge_correlation(make(spark, x), e)))) == {(0, 3)}


def test_thresholds_keep_ties_and_drop_zero(spark):
    w = spark.createDataFrame([(0, 0, n, v) for n, v in enumerate([0.5, 0.4999, -0.2, 0.0, NAN, float("inf")], 1)], "subject_id int, i_idx long, j_idx long, w double")
    keys = lambda **k: {r.j_idx for r in kernels.finish(w, **k).collect()}
    assert keys() == {1, 2, 3} and keys(r_min=0.5) == {1} and keys(r_min=0.0) == {1, 2}
    assert keys(clamp_negative=True) == {1, 2} == keys(clamp_negative="auto")


def test_correlation_hyperparameters(spark):
    assert kernels.resolve_correlation_hyper({"chunk_size": 9})["block_size"] == 9
    assert kernels.resolve_correlation_hyper({"chunk_size": 9, "block_size": 4})["block_size"] == 4
    with pytest.raises(TypeError):
        kernels.resolve_correlation_hyper({"colour": 1})
    with pytest.raises(ValueError):
        kernels.correlation_adjacency(make(spark, small(t=1)))
    assert kernels.correlation_adjacency(make(spark, small(v=1))).count() == 0


def test_smoothing_mirrors_and_keeps_means(spark):
    x = np.zeros((1, 2, 5))
    x[0, 0, 0] = x[0, 1, 4] = 1
    got = {r.voxel_id: r.series for r in gaussian_smooth(make(spark, x)).collect()}
    k = gaussian_kernel(3 / 2.354820045)
    r = len(k) // 2
    want = np.convolve(np.pad(x[0, 0], r, mode="symmetric"), k, "valid")
    assert np.allclose(got[0], want) and np.allclose(got[1], want[::-1])
    flat = smoothing_matrix(5, k)
    assert np.allclose(flat.sum(1), 1)
    compat = smoothing_matrix(6, np.ones(5) / 5, "r_compat") @ np.arange(6.0)
    assert np.allclose(compat, np.convolve(np.r_[1, 0, np.arange(6), 4, 5], np.ones(5) / 5, "valid"))
    assert gaussian_kernel(0).tolist() == [1]


def test_neighbours(spark):
    coord = [(0, 0, 0), (1, 1, 1), (0, 0, 0), (3, 0, 0), (2, 1, 0)]
    got = {(r.i_idx, r.j_idx) for r in edges26(make(spark, small(v=5), coord)).collect()}
    assert got == {(0, 1), (1, 2), (1, 4), (3, 4)}  # equal coordinates aren't linked


def test_edge_kernels_match_numpy(spark):
    x, v = small(), make(spark, small())
    e = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "i_idx long, j_idx long")
    a, c = x[0], np.linalg.norm(x[0], axis=1)
    for (i, j), w in edge_map(kernels.edge_cosine(v, e)).items():
        assert w == pytest.approx(0.5 * (a[i] @ a[j] / (c[i] * c[j] + 1e-12) + 1))
    z = kernels.standardize(a)
    d = edge_map(kernels.edge_l2(v, e))
    assert all(w == pytest.approx(np.sqrt(((z[i] - z[j]) ** 2).mean())) for (i, j), w in d.items())
    rbf, scale = edge_map(kernels.distance_to_weight(kernels.edge_l2(v, e))), np.median(list(d.values()))
    assert all(w == pytest.approx(np.exp(-(d[k] ** 2) / 2 / scale**2)) for k, w in rbf.items())
    g = np.gradient(a, axis=1)
    q = g / np.sqrt(np.abs(g) + 1e-8)
    srvf = edge_map(kernels.edge_srvf(v, e))
    assert all(w == pytest.approx(np.sqrt(((q[i] - q[j]) ** 2).mean())) for (i, j), w in srvf.items())
    dtw = edge_map(kernels.edge_srvf(v, e, warp="dtw"))
    assert len(dtw) == 66 and kernels.dtw_rms(q[:3], q[:3]).tolist() == [0, 0, 0]
    shifted = kernels.dtw_rms(np.array([[0, 0, 1, 5, 1.0]]), np.array([[0, 1, 5, 1, 1.0]]))
    assert shifted[0] == 0


def test_partial_correlation_is_the_ridge_inverse(spark):
    z = kernels.standardize(small(v=8, t=15)[0])
    e = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)], "i_idx long, j_idx long")
    got = edge_map(kernels.edge_partial_correlation(make(spark, z[None]), e, ridge=0.7))
    p = np.linalg.inv(np.corrcoef(z) + 0.7 * np.eye(8))
    assert all(w == pytest.approx(-p[i, j] / np.sqrt(p[i, i] * p[j, j]), abs=1e-9) for (i, j), w in got.items())


def test_bases_reproduce_what_they_span(spark):
    t = np.linspace(0, 1, 40)
    x = np.stack([1 + t, t**3 - t, np.cos(2 * t)])[None]
    v = make(spark, x)
    back = basis.bspline_reconstruction(basis.bspline_coefficients(v, 6, penalty=1e-10), 40, 6)
    got = {r.voxel_id: r.series for r in back.collect()}
    assert all(np.allclose(got[n], x[0, n], atol=1e-4) for n in range(3))
    y = small(v=30, t=8, s=2)
    models = basis.principal_components(make(spark, y), 8)
    for s in range(2):
        value = np.linalg.eigvalsh(y[s].T @ y[s] / 29)[::-1]
        assert np.allclose(models[s]["eigenvalues"], value) and models[s]["var_explained"].sum() == pytest.approx(1)
    loaded = basis.fpca_loadings(make(spark, y), 8, models=models)
    assert all(np.allclose(r.series, y[r.subject_id, r.voxel_id] @ models[r.subject_id]["vectors"]) for r in loaded.collect())
    again = basis.fpca_reconstruction(make(spark, y), models)
    assert all(np.allclose(r.series, y[r.subject_id, r.voxel_id]) for r in again.collect())
    assert basis.fpca_table(spark, models).count() == 16


def test_spectral_clustering_finds_planted_blocks(spark):
    w, v = blocks(spark, 2)
    assert planted(spectral_clustering(w, v, 3))
    assert planted(tables.to_base(spectral_clustering(w, v, 3), 0).withColumn("label", F.col("label") + 1))
    got = {r.voxel_id: r.label for r in spectral_clustering(*[d.where("subject_id = 0") for d in (w, v)], 3, eig_solver="randomized", randomized_oversample=8).collect()}
    assert got[18] == 0 and len({got[n] for n in range(18)}) == 3 and all(got[n] == got[n // 6 * 6] for n in range(18))


def test_randomized_eigenvalues_match_dense(spark):
    w, _ = blocks(spark)
    n = graph.normalized(w)
    s = np.zeros((18, 18))
    for r in n.collect():
        s[r.i_idx, r.j_idx] = s[r.j_idx, r.i_idx] = r.w
    value, _ = randomized_eigenvectors(n.drop("subject_id"), 3, oversample=10)
    assert np.allclose(value, np.linalg.eigvalsh(s)[::-1][:3], atol=1e-6)


@pytest.mark.parametrize("solver", ["eigsh", "randomized", "auto"])
def test_larger_subjects_go_through_as_tables_together(spark, solver, monkeypatch):
    from voxelgraph.operators import spectral

    w, v = blocks(spark, 2)
    small = {(r.subject_id, r.voxel_id): r.label for r in spectral_clustering(w, v, 3).collect()}
    monkeypatch.setattr(spectral, "DENSE", 2)
    opts = {"eig_solver": solver, "randomized_oversample": 8, "randomized_n_iter": 4, "kmeans_nstart": 4}
    large = {(r.subject_id, r.voxel_id): r.label for r in spectral_clustering(w, v, 3, **opts).collect()}
    assert large == small and len({s for s, _ in small}) > 1  # the same numbers, too


def test_table_eigenvectors_settle(spark):
    w, _ = blocks(spark, 2)
    n = graph.normalized(w)
    value, y = eigenvectors(n, 3, oversample=8, tolerance=1e-6)
    rows = y.toPandas()
    for s, part in n.toPandas().groupby("subject_id"):
        nodes = sorted(set(part.i_idx) | set(part.j_idx))
        m = np.zeros((len(nodes), len(nodes)))
        for a, b, x in zip(part.i_idx, part.j_idx, part.w):
            m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = x
        u = rows[rows.subject_id == s].sort_values("voxel_id")[["y0", "y1", "y2"]].to_numpy()
        assert np.allclose(value[s], np.linalg.eigvalsh(m)[::-1][:3], atol=1e-6)
        assert np.linalg.norm(m @ u - u * value[s], axis=0).max() < 1e-5


def test_spectral_refusals(spark):
    w, v = blocks(spark)
    for bad in ({"n_clusters": 0}, {"n_clusters": 18}, {"n_clusters": 40}, {"n_clusters": 3, "remove_isolated": False}, {"n_clusters": 3, "eig_solver": "magic"}):
        with pytest.raises(ValueError):
            spectral_clustering(w, v, **bad).collect()
    assert {r.label for r in spectral_clustering(w.limit(0), v, 3).collect()} == {0}
    assert resolve_spectral_hyper({"K": 4, "seed": 1})["n_clusters"] == 4
    assert resolve_spectral_hyper({"K": 4, "n_clusters": 5, "method": "spectral"})["n_clusters"] == 5
    with pytest.raises(ValueError):
        resolve_spectral_hyper({})
    with pytest.raises(TypeError):
        resolve_spectral_hyper({"K": 4, "depth": 1})


def test_greedy_modularity(spark):
    w, v = blocks(spark)
    table = greedy.dendrogram(w).cache()
    assert planted(greedy.cut_labels(table, v, w)) and planted(greedy.cut_labels(table, v, w, 3))
    best = table.agg(F.max("modularity")).first()[0]
    labels = greedy.cut_labels(table, v, w)
    assert metrics.modularity(w, labels).first().modularity == pytest.approx(best)
    assert greedy.dendrogram(w.limit(0)).count() == 0


def sequential_best(i, j, w):
    """Modularity of merging the single best pair each time."""
    m, near = w.sum(), {}
    deg = np.bincount(np.concatenate([i, j]), np.concatenate([w, w]))
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist()):
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = x
    q = best = -((deg / (2 * m)) ** 2).sum()
    while True:
        pairs = [(near[a][b] / m - deg[a] * deg[b] / (2 * m * m), -a, -b) for a in near for b in near[a] if a < b]
        if not pairs:
            return best
        gain, a, b = max(pairs)
        a, b, q = -a, -b, q + gain
        best = max(best, q)
        deg[a] += deg[b]
        for c, x in near.pop(b).items():
            del near[c][b]
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + x


def test_greedy_rounds_come_near_sequential_merges(spark):
    rng = np.random.default_rng(4)
    rows, plain = [], {}
    for s in range(2):
        group = rng.integers(0, 6, 90)
        i, j = np.triu_indices(90, 1)
        on = rng.random(len(i)) < np.where(group[i] == group[j], 0.4, 0.05)
        w = rng.uniform(0.2, 1, on.sum())
        plain[s] = sequential_best(i[on], j[on], w)
        rows += [(s, int(a), int(b), float(x)) for a, b, x in zip(i[on], j[on], w)]
    weights = spark.createDataFrame(rows, "subject_id int, i_idx long, j_idx long, w double")
    voxels = spark.range(90).selectExpr("explode(array(0, 1)) subject_id", "id voxel_id")
    table = greedy.dendrogram(weights)
    labels = greedy.cut_labels(table, voxels, weights)
    for r in metrics.modularity(weights, labels).collect():
        top = table.where(F.col("subject_id") == r.subject_id).agg(F.max("modularity")).first()[0]
        assert r.modularity == pytest.approx(top) and r.modularity > 0.95 * plain[r.subject_id]
    assert table.count() == 2 * 89 and table.agg(F.max("step")).first()[0] == 89
    for r in greedy.cut_labels(table, voxels, weights, 4).groupBy("subject_id").agg(F.countDistinct("label").alias("k")).collect():
        assert r.k == 4


def lattice(spark, n, subjects=1, seed=0):
    """Normalised 26-neighbour graphs of smooth series."""
    rng, frames = np.random.default_rng(seed), []
    for s in range(subjects):
        x = rng.normal(size=(n, n, n, 40))
        for axis in (0, 1, 2, 0, 1, 2):
            x = (np.roll(x, 1, axis) + x + np.roll(x, -1, axis)) / 3
        x = x.reshape(n**3, -1)
        x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True) / np.sqrt(x.shape[1])
        at = np.stack(np.unravel_index(np.arange(n**3), (n, n, n)), 1)
        i, j = [], []
        for o in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]:
            to = at + o
            ok = ((to >= 0) & (to < n)).all(1)
            i.append(np.flatnonzero(ok))
            j.append(np.ravel_multi_index(to[ok].T, (n, n, n)))
        i, j = np.concatenate(i), np.concatenate(j)
        w = (x[i] * x[j]).sum(1)
        i, j, w = i[w > 0], j[w > 0], w[w > 0]
        d = np.bincount(i, w, n**3) + np.bincount(j, w, n**3)
        frames.append(pd.DataFrame({"subject_id": s, "i_idx": i, "j_idx": j, "w": w / np.sqrt(d[i] * d[j])}))
    frame = pd.concat(frames)
    return spark.createDataFrame(frame, "subject_id int, i_idx long, j_idx long, w double"), frame


@pytest.mark.parametrize(("n", "k", "subjects", "size"), [(20, 20, 1, 200_000), (20, 121, 1, 200_000), (6, 5, 2, 700)])
def test_large_lattices_settle(spark, n, k, subjects, size):
    from voxelgraph.operators.eigen import settled_eigenvectors

    norm, frame = lattice(spark, n, subjects)
    value, y, products = settled_eigenvectors(norm, k, size=size)
    assert max(products.values()) <= 60
    rows = y.toPandas()
    for s, edges in frame.groupby("subject_id"):
        v = rows[rows["subject_id"] == s].sort_values("voxel_id")[[f"y{c}" for c in range(k)]].to_numpy()
        i, j, w = (edges[c].to_numpy() for c in ("i_idx", "j_idx", "w"))
        product = np.zeros_like(v)
        np.add.at(product, i, w[:, None] * v[j])
        np.add.at(product, j, w[:, None] * v[i])
        assert np.linalg.norm(product - v * value[s], axis=0).max() <= 1.1e-4
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-8
        if n == 6:
            dense = np.zeros((n**3, n**3))
            dense[i, j] = dense[j, i] = w
            assert np.allclose(value[s], np.linalg.eigvalsh(dense)[::-1][:k], atol=1e-6)


@pytest.mark.parametrize("listed", [50_000, 3])
def test_medians_by_counting(spark, monkeypatch, listed):
    from voxelgraph.operators import medians

    monkeypatch.setattr(medians, "LISTED", listed)
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=501), 1: rng.exponential(size=200), 2: np.full(40, 0.3), 3: np.array([-1.0, 0.0]), 4: np.concatenate([np.full(50, 2.0), [1.0, np.nan, np.inf]])}
    rows = spark.createDataFrame([(s, float(x)) for s, g in groups.items() for x in g], "subject_id int, w double")
    want = {s: np.median(g[(g > 0) & np.isfinite(g)]) for s, g in groups.items() if ((g > 0) & np.isfinite(g)).any()}
    assert medians.table_medians(rows) == pytest.approx(want)
    assert {r.subject_id: r.scale for r in kernels.pilot_scale(rows).collect()} == pytest.approx(want | {3: 1.0})


def test_all_pairs_of_distances_find_their_own_scale(spark, monkeypatch):
    from voxelgraph.operators import medians

    monkeypatch.setattr(medians, "LISTED", 20)
    x = small(s=2, v=14, t=20)
    v = make(spark, x)
    i, j = np.triu_indices(14, 1)
    for s in range(2):
        z = (x[s] - x[s].mean(1, keepdims=True)) / x[s].std(1, ddof=1, keepdims=True)
        d = np.sqrt(((z[i] - z[j]) ** 2).mean(1))
        for shape, want in (("rbf", np.exp(-(d**2) / (2 * np.median(d) ** 2))), ("inv", 1 / (1 + d / np.median(d)))):
            got = edge_map(kernels.all_pairs(v.where(f"subject_id = {s}"), "l2", block_size=5, shape=shape))
            assert [got[a, b] for a, b in zip(i, j)] == pytest.approx(want.tolist())
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(i, j)], "i_idx long, j_idx long")
    whole = {(r.subject_id, r.i_idx, r.j_idx): r.w for r in kernels.edge_partial_correlation(v, edges, prestandardized=False).collect()}
    tiled = {(r.subject_id, r.i_idx, r.j_idx): r.w for r in kernels.all_pairs(v, "partial", block_size=5).collect()}
    assert tiled == pytest.approx(whole)


@pytest.mark.parametrize("symmetry", ["upper", "union"])
def test_top_k_inside_tiles(spark, symmetry):
    x = np.round(small(s=2, v=25, t=6), 0)  # many equal weights
    v = make(spark, x)
    rows = lambda df: sorted((r.subject_id, r.i_idx, r.j_idx, round(r.w, 9)) for r in df.collect())
    dots = lambda a, b: a @ b.T  # noqa: E731  exact, so ties are ties
    for k in (1, 3, 40):
        assert rows(kernels.all_pairs_top(v, k, dots, symmetry=symmetry, block_size=7)) == rows(graph.top_k(kernels.all_pairs(v, dots, block_size=7), k, symmetry=symmetry))


def test_graph_rules(spark):
    rows = [(0, 0, 1, 0.9), (0, 0, 2, 0.8), (0, 1, 2, 0.1), (0, 2, 3, 0.7), (0, 1, 3, -0.5)]
    w = spark.createDataFrame(rows, "subject_id int, i_idx long, j_idx long, w double")
    assert set(edge_map(graph.top_k(w, 1))) == {(0, 1), (0, 2), (2, 3)}
    assert set(edge_map(graph.top_k(w, 1, symmetry="union"))) == {(0, 1), (0, 2), (2, 3)}
    asym = spark.createDataFrame([(0, 0, 1, 0.9), (0, 0, 2, 0.5), (0, 1, 2, 0.4)], w.schema)
    assert set(edge_map(graph.top_k(asym, 1))) == {(0, 1), (0, 2)}
    twice = spark.createDataFrame([(0, 0, 1, 0.4), (0, 1, 0, 0.8), (0, 2, 2, 1.0), (0, 0, 2, 0.6)], w.schema)
    assert edge_map(graph.symmetrized(twice)) == {(0, 1): pytest.approx(0.6), (0, 2): pytest.approx(0.3)}
    assert edge_map(graph.simplified(twice)) == {(0, 1): 0.8, (0, 2): 0.6}


@pytest.mark.parametrize("repeated", [False, True])
def test_entries_of_a_pair_are_folded_without_a_shuffle(spark, tmp_path, repeated):
    x = np.random.default_rng(4).normal(size=(40, 6))
    ids = [*range(39), 0 if repeated else 39]
    spark.createDataFrame([(n, e.tolist()) for n, e in zip(ids, x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, fold in (("symmetrize", graph.symmetrized), ("simplify", graph.simplified)):
        got = registered.queries()[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(subject_id" in plan and "i_idx" in plan.split("hashpartitioning(subject_id")[1].split(")")[0]) == repeated
        want = fold(registered._entries(spark, str(tmp_path)))
        rows = lambda df: sorted((r.i_idx, r.j_idx, round(r.w, 6)) for r in df.collect())
        assert rows(got) == rows(want) and got.count() > 50
    part = spark.createDataFrame([(0, 1, 2, 0.4, 0.8), (0, 1, 3, None, -0.6), (0, 2, 3, 0.2, None), (0, 3, 4, None, None)], "subject_id int, i_idx long, j_idx long, up double, down double")
    assert edge_map(graph.symmetrized_pairs(part)) == {(1, 2): pytest.approx(0.6), (1, 3): -0.3, (2, 3): 0.1}
    assert edge_map(graph.simplified_pairs(part)) == {(1, 2): 0.8, (1, 3): -0.6, (2, 3): 0.2}


def test_histogram_bins_are_those_of_the_edges():
    from voxelgraph.operators import medians

    rng = np.random.default_rng(6)
    for bracket in ((np.nextafter(0, 1), 3.0), (1.2, 1.3), (1.0, np.nextafter(1.0, 2)), (1.0, 1.0 + 1e-13), (5e-324, 1e-300)):
        e = medians.edges(bracket)
        x = np.concatenate([rng.normal(size=5000) ** 2, e, np.nextafter(e, 9), np.nextafter(e, -9), rng.uniform(*bracket, 5000)])
        want = np.bincount(np.searchsorted(e, x, side="right"), minlength=medians.BINS + 2)[: medians.BINS + 1]
        assert (medians.histogram(x, bracket) == want).all()


def test_kmeans_runs_are_light_and_the_same_as_tasks(spark):
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60_000, 8)) + 4 * np.eye(8)[rng.integers(0, 8, 60_000)]
    tracemalloc.start()
    labels = spectral.kmeans(x, 8, 1, 3)
    assert tracemalloc.get_traced_memory()[1] < 8 * x.nbytes  # no number for each row, centre and column
    tracemalloc.stop()
    assert len(np.unique(labels)) == 8
    rows = [(s, n, *map(float, x[s * 300 + n])) for s in range(2) for n in range(300)]
    y = spark.createDataFrame(rows, "subject_id int, voxel_id long, " + ", ".join(f"y{c} double" for c in range(8)))
    got = {(r.subject_id, r.voxel_id): r.label for r in spectral.clustered(y, 8, 4, 50, 3).collect()}
    for s in range(2):
        own = x[s * 300 : s * 300 + 300]
        want = spectral.numbered(spectral.kmeans(own / np.linalg.norm(own, axis=1, keepdims=True), 8, 4, 50, 3))
        assert [got[s, n] for n in range(300)] == want.tolist()


def test_silhouettes(spark):
    w, v = blocks(spark)
    labels = v.withColumn("label", F.when(F.col("voxel_id") < 18, (F.col("voxel_id") / 6).cast("int") + 1).otherwise(0))
    s = np.zeros((19, 19))
    for (i, j), x in edge_map(w).items():
        s[i, j] = s[j, i] = x
    for r in metrics.silhouette_strict(w, labels).collect():
        z = np.array([6 * (r.label - 1) <= n < 6 * r.label for n in range(19)], float)
        a, b = z @ s @ z / 30, (z @ s @ np.ones(19) - z @ s @ z) / (6 * 13)
        assert (r.n_k, r.a, r.b, r.s) == (6, pytest.approx(a), pytest.approx(b), pytest.approx((a - b) / max(a, b)))
    lone = labels.withColumn("label", F.when(F.col("voxel_id") == 0, 9).otherwise(F.col("label")))
    assert metrics.silhouette_strict(w, lone).where("label = 9").first().s is None
    assert metrics.silhouette_graph(w, labels).agg(F.min("s")).first()[0] > 0.8
    assert metrics.mean_sd(metrics.overall(metrics.silhouette_strict(w, labels))).first().sd is None


def test_dice(spark):
    lab = lambda v: spark.createDataFrame([(0, n, x) for n, x in enumerate(v)], "subject_id int, voxel_id long, label int")
    a, b, none = lab([1, 1, 1, 2, 2, 0]), lab([2, 2, 2, 1, 1, 0]), lab([0] * 6)
    assert metrics.overlap(a, b).first().overlap == 1.0 and metrics.overlap(a, b, dice=False).first().overlap == 0.5
    assert metrics.overlap(none, none).first().overlap is None and metrics.overlap(none, none, empty=0.0).first().overlap == 0.0
    e = spark.createDataFrame([(0, 1), (2, 3), (3, 4), (4, 5)], "i_idx long, j_idx long")
    assert metrics.dice_edge(a, b, e).first().dice == 1.0 and metrics.dice_edge(a, none, e).first().dice == 0.0
    summary = metrics.cluster_summary(a).first()
    assert (summary.n_voxels, summary.n_assigned, summary.n_clusters) == (6, 5, 2)


def test_consensus_and_leave_one_out(spark):
    rng = np.random.default_rng(3)
    lab = rng.integers(0, 3, (4, 9))
    labels = spark.createDataFrame([(s, v, int(lab[s, v])) for s in range(4) for v in range(9)], "subject_id int, voxel_id long, label int")
    for r in consensus.consensus_all_pairs(labels).collect():
        use = (lab[:, r.i_idx] > 0) & (lab[:, r.j_idx] > 0)
        agree = use & (lab[:, r.i_idx] == lab[:, r.j_idx])
        assert (r.agree, r.cnt) == (agree.sum(), use.sum())
    for size in (1024, 4):
        seen = 0
        for r in consensus.leave_one_out_all_pairs(labels, size).collect():
            o = np.delete(lab, r.held_out, 0)
            use = (o[:, r.i_idx] > 0) & (o[:, r.j_idx] > 0)
            assert (r.agree, r.cnt) == ((use & (o[:, r.i_idx] == o[:, r.j_idx])).sum(), use.sum())
            seen += 1
        i, j = np.triu_indices(9, 1)
        both = (lab[:, i] > 0) & (lab[:, i] == lab[:, j])
        assert seen == sum((np.delete(both, s, 0).sum(0) > 0).sum() for s in range(4))


def test_group_parcellation_repeats_itself(spark):
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(3, 30)), 9, axis=0)
    x = np.stack([base + 0.3 * rng.normal(size=base.shape) for _ in range(3)])
    coord = [(n % 3, n // 3 % 3, n // 9) for n in range(27)]
    v = make(spark, x, coord)
    for mode in ("26", "all pairs"):
        out = consensus.group_parcellation(v, 3, mode, r_min=0.3)
        got = [r.label for r in out.group_labels.orderBy("voxel_id").collect()]
        assert got == [1] * 9 + [2] * 9 + [3] * 9
        assert consensus.loocv_dice(out, 3).agg(F.min("dice")).first()[0] == pytest.approx(1.0)


def test_group_parcellation_with_distances_and_a_kernel_of_the_users(spark):
    # Blocks so thick that most edges, and with them the median distance, lie inside one.
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(2, 30)), 27, axis=0)
    x = np.stack([base + 0.15 * rng.normal(size=base.shape) for _ in range(2)])
    v = make(spark, x, [(n % 3, n // 3 % 3, n // 9) for n in range(54)])
    near = lambda voxels, edges: kernels.edge_l2(voxels, edges).withColumn("w", F.exp(-4 * F.col("w")))
    for weight in ("l2", "srvf", near):
        out = consensus.group_parcellation(v, 2, weight=weight)
        got = [r.label for r in out.group_labels.orderBy("voxel_id").collect()]
        assert got == [1] * 27 + [2] * 27
    with pytest.raises(ValueError):
        consensus.group_parcellation(v, 2, weight="nearest")


def test_alignment_and_checks(spark):
    v = make(spark, small(s=2))
    other = v.withColumn("voxel_id", F.when(F.col("subject_id") == 1, 100 - F.col("voxel_id")).otherwise(F.col("voxel_id")))
    back = tables.align(other, 0)
    assert back.exceptAll(v).count() == 0
    with pytest.raises(ValueError):
        tables.align(v.where("not (subject_id = 1 and voxel_id = 3)"), 0)
    with pytest.raises(ValueError):
        tables.validate(v.where("not (subject_id = 1 and voxel_id = 3)"))
    assert tables.common_voxels(v.where("not (subject_id = 1 and voxel_id = 3)")).count() == 22
    with pytest.raises(IndexError):
        tables.plot_frame(v, v.select("subject_id", "voxel_id", F.lit(1).alias("label")), subject_id=9)


def test_sources_and_sinks(spark, tmp_path):
    x, coord = small(s=2, v=5, t=4), np.arange(15).reshape(5, 3)
    np.savez(tmp_path / "d.npz", data=x)
    np.save(tmp_path / "c.npy", coord)
    v = sources.read_numpy(spark, f"{tmp_path}/d.npz", f"{tmp_path}/c.npy")
    assert v.exceptAll(sources.from_arrays(spark, x, coord)).count() == 0
    with pytest.raises(ValueError):
        sources.read_numpy(spark, "a.csv", "c.npy")
    with pytest.raises(ValueError):
        sources.from_arrays(spark, x[0], coord)
    (tmp_path / "007.csv").write_text("l,f,i,j,k,t0,t1\na,b,1,2,3,0.5,1.5\n")
    r = sources.read_subject_csv(spark, f"{tmp_path}/007.csv", 2).first()
    assert (r.subject_id, r.i, r.j, r.k, r.series) == (7, 1, 2, 3, [0.5, 1.5])
    sinks.write_voxels(v, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("subject_id = 1").count() == 5
    sinks.append_history(spark, "x", {"a": 1}, f"{tmp_path}/h")
    assert spark.read.parquet(f"{tmp_path}/h").first().ts.endswith("Z")
    assert sources.synthetic(spark, 2, 5, 7).agg(F.count("*"), F.min(F.size("series"))).first()[0] == 10
    q = ingest.prepare(ingest.arriving(spark, f"{tmp_path}/in"), gaussian_smooth, f"{tmp_path}/ready", f"{tmp_path}/cp") if v.write.parquet(f"{tmp_path}/in") is None else None
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/ready").count() == 10


def test_registry_and_staged_flow(spark):
    m = registry.get_method("similarity", "correlation")
    assert registry.parse(m, {"r_min": "0.5", "clamp_negative": "true"})["r_min"] == 0.5
    assert registry.parse(registry.get_method("visualization", "clusters_3d"), [False])["include_unassigned"] is True
    assert registry.cast("1, 2", "csv_int") == (1, 2) and registry.cast(" ", "int") is None and registry.cast('{"a": 1}', "json") == {"a": 1}
    for bad in (lambda: registry.get_method("similarity", "x"), lambda: registry.choices("x"), lambda: registry.parse(registry.get_method("clustering", "spectral"), {})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        registry.parse(m, {"colour": 1})
    p = Pipeline()
    for step in (p.preprocess, p.similarity, p.cluster, p.report, p.visualize):
        with pytest.raises(ValueError):
            step()
    p.validate(make(spark, small(s=2, v=20, t=30))).preprocess("gaussian_smoothing", {"fwhm_samples": 2}).similarity("correlation", {"r_min": 0.1}).cluster("spectral", {"n_clusters": 3})
    assert p.report()["clusters"].count() == 6 and p.visualize().count() == 40
    assert p.snapshot()["ready"]["labels"] and p.snapshot()["history"] == 6
    p.preprocess("none")
    assert p.weights is None and p.labels is None and not p.reports
    for method in ("correlation26", "cosine26", "l2_26", "srvf26", "partial26"):
        assert p.similarity(method).weights.count() > 0


def test_matrix_refuses_ragged_series():
    import pyarrow as pa

    with pytest.raises(ValueError):
        matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_numpy_files_are_read_by_ranges(spark, tmp_path):
    x, coord = small(s=3, v=11, t=6).astype("float32"), np.arange(44).reshape(11, 4)
    np.save(tmp_path / "d.npy", x)
    np.savez(tmp_path / "s.npz", other=np.zeros(3), arr_0=x)
    np.savez_compressed(tmp_path / "z.npz", data=x)
    np.save(tmp_path / "c.npy", coord)
    np.savez_compressed(tmp_path / "c.npz", coords=coord)
    want = {(s, v): (*coord[v, :3].tolist(), x[s, v].astype(float).tolist()) for s in range(3) for v in range(11)}
    rows = lambda df: {(r.subject_id, r.voxel_id): (r.i, r.j, r.k, r.series) for r in df.collect()}
    for data in ("d.npy", "s.npz", "z.npz"):
        for c in ("c.npy", "c.npz"):
            v = sources.read_numpy(spark, f"{tmp_path}/{data}", f"{tmp_path}/{c}", partition=100)
            assert rows(v) == want
            assert rows(v.where("subject_id = 1 and voxel_id > 3")) == {k: w for k, w in want.items() if k[0] == 1 and k[1] > 3}
            assert rows(v.where("subject_id in (0, 2)")) == {k: w for k, w in want.items() if k[0] != 1}
    v = sources.read_numpy(spark, f"file://{tmp_path}/d.npy", f"{tmp_path}/c.npy", partition=100)
    assert v.rdd.getNumPartitions() == 9  # four voxels of 24 bytes in each, none across subjects
    assert v.where("subject_id = 1").rdd.getNumPartitions() == 3
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    for bad in ("f.npy", "c.npy"):
        with pytest.raises(Exception, match="Fortran|data is"):
            sources.read_numpy(spark, f"{tmp_path}/{bad}", f"{tmp_path}/c.npy").collect()


def plain_adf(x, k):
    d = np.diff(x)
    n = len(d) - k
    design = np.column_stack([x[k : k + n], np.ones(n), np.arange(n), *[d[k - lag : k - lag + n] for lag in range(1, k + 1)]])
    beta, *_ = np.linalg.lstsq(design, d[k:], rcond=None)
    rest = d[k:] - design @ beta
    cov = np.linalg.inv(design.T @ design) * (rest @ rest) / (n - design.shape[1])
    return beta[0] / np.sqrt(cov[0, 0])


def test_stationarity(spark):
    from voxelgraph.functions import stationarity

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 8, 120))
    x[0, 4:7] = np.cumsum(x[0, 4:7], axis=1)
    x[0, 7] = 3.0
    rows = stationarity.adf_test(make(spark, x)).orderBy("voxel_id").collect()
    assert stationarity.lags(120) == 4 and stationarity.lags(65) == 4
    for n, r in enumerate(rows[:7]):
        assert r.statistic == pytest.approx(plain_adf(x[0, n], 4), rel=1e-6)
    assert all(r.p_value == 0.01 for r in rows[:4]) and all(r.p_value > 0.05 for r in rows[4:7]) and np.isnan(rows[7].p_value)
    assert stationarity.p_values(np.array([-3.45, 0.0]), 100) == pytest.approx([0.05, 0.99])
    got = stationarity.stationary_counts(stationarity.adf_test(make(spark, x))).first()
    assert (got.n, got.n_stationary) == (8, 4)
    assert np.isnan(stationarity.statistics(np.ones((2, 5)))).all()


@pytest.mark.parametrize("dense", [4000, 2])
def test_spectral_model(spark, monkeypatch, dense):
    from voxelgraph.operators import model, spectral

    monkeypatch.setattr(spectral, "DENSE", dense)
    w, v = blocks(spark, 2)
    out = model.spectral_model(w, v, 3, batch=12)
    assert planted(out.labels)
    norm = graph.normalized(w).toPandas()
    values = out.eigenvalues.toPandas()
    vectors = out.vectors.toPandas()
    for s, part in norm.groupby("subject_id"):
        m = np.zeros((18, 18))
        m[part["i_idx"], part["j_idx"]] = m[part["j_idx"], part["i_idx"]] = part["w"]
        value = values[values["subject_id"] == s].sort_values("component")["eigenvalue"].to_numpy()
        assert np.allclose(value, np.linalg.eigvalsh(m)[::-1][:3], atol=1e-6)
        y = np.stack(vectors[vectors["subject_id"] == s].sort_values("voxel_id")["vector"].to_list())
        assert np.abs(m @ y - y * value).max() < 1e-3
    assert out.centres.count() == 6 and {r.label for r in out.centres.collect()} == {1, 2, 3}
    assert out.active.count() == 36
    shares = metrics.scree(out.eigenvalues.select("subject_id", "eigenvalue"), keys=["subject_id"]).groupBy("subject_id").agg(F.max("cumulative").alias("c")).collect()
    assert all(r.c == pytest.approx(100) for r in shares)
    with pytest.raises(ValueError):
        model.spectral_model(w, v, 18)


def test_mini_batches_find_groups_of_many_rows():
    from voxelgraph.operators.model import MiniBatch

    rng = np.random.default_rng(0)
    centre = rng.normal(size=(5, 4)) * 5
    made = MiniBatch(5, 10, 10, 1)
    for _ in range(30):
        made.take(centre[rng.integers(0, 5, 400)] + 0.1 * rng.normal(size=(400, 4)))
    assert np.linalg.norm(made.centres[:, None] - centre[None], axis=2).min(0).max() < 0.05


@pytest.mark.parametrize("kind", ["correlation", "cosine"])
def test_silhouettes_without_pairs(spark, kind):
    v = make(spark, small(s=2, v=15, t=12))
    labels = v.select("subject_id", "voxel_id", F.when(F.col("voxel_id") == 14, 3).otherwise(F.col("voxel_id") % 3).cast("int").alias("label"))
    got = {(r.subject_id, r.label): r for r in metrics.silhouette_all_pairs(v, labels, kind).collect()}
    want = {(r.subject_id, r.label): r for r in metrics.silhouette_strict(kernels.all_pairs(v, kind), labels).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in ("n_k", "a", "b", "s"):
            assert got[k][c] == (None if r[c] is None else pytest.approx(r[c]))


def test_joins_that_change_counts_are_refused(spark):
    v = make(spark, small(s=1, v=6, t=5))
    labels = v.where("voxel_id < 4").select("subject_id", "voxel_id", F.lit(2).alias("label"))
    assert sorted(r.label for r in tables.labelled(v, labels).collect()) == [0, 0, 2, 2, 2, 2]
    with pytest.raises(ValueError, match="6 voxels became 10"):
        tables.labelled(v, labels.unionByName(labels))
    w = spark.createDataFrame([(0, 0, 1, 0.5), (0, 2, 5, 0.1)], "subject_id int, i_idx long, j_idx long, w double")
    assert tables.edges_checked(w, v).count() == 2
    for bad in ((0, 1, 9, 0.5), (1, 1, 2, 0.5), (0, 3, 3, 0.5)):
        with pytest.raises(ValueError):
            tables.edges_checked(w.unionByName(spark.createDataFrame([bad], w.schema)), v)


def test_kernels_by_name(spark, monkeypatch):
    for name in ("METHODS", "KERNELS"):
        held = getattr(registry, name)
        monkeypatch.setitem(held, "similarity", dict(held["similarity"])) if name == "METHODS" else None
    monkeypatch.setattr("voxelgraph.plans.registry.KERNELS", registry.KERNELS)
    registry.register_kernel("near", lambda v, power: kernels.all_pairs(v, lambda a, b: np.abs(a @ b.T) ** power), "powers of products", (registry.Param("power", "float", 2.0),))
    with pytest.raises(ValueError):
        registry.register_kernel("cosine", lambda v: v)
    x = small(s=1, v=6, t=5)
    p = Pipeline().validate(make(spark, x)).preprocess("none").similarity("near", {"power": "1"})
    assert edge_map(p.weights)[0, 3] == pytest.approx(abs(x[0, 0] @ x[0, 3]))
    for method in ("l2", "srvf", "partial"):
        assert p.similarity(method, {"r_min": "0.01"}).weights.count() > 0
    registry.KERNELS.pop("near")


def plain_elastic(p, q, reach, penalty):
    from math import gcd

    t = len(p)
    best = np.full((t, t), np.inf)
    best[0, 0] = 0
    for i in range(1, t):
        for j in range(1, t):
            for a in range(1, reach + 1):
                for b in range(1, reach + 1):
                    if gcd(a, b) == 1 and a <= i and b <= j:
                        cost = a * penalty * (1 - np.sqrt(b / a)) ** 2
                        for m in range(a):
                            cost += (p[i - a + m] - np.sqrt(b / a) * np.interp(j - b + m * b / a, np.arange(t), q)) ** 2
                        best[i, j] = min(best[i, j], best[i - a, j - b] + cost)
    return np.sqrt(best[-1, -1] / (t - 1))


@pytest.mark.parametrize(("reach", "penalty"), [(4, 0.0), (3, 0.5)])
def test_elastic_distance(spark, monkeypatch, reach, penalty):
    from voxelgraph.functions.series import srvf
    from voxelgraph.operators import elastic

    monkeypatch.setattr(elastic, "HELD", 500)
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(7, 13)), rng.normal(size=(7, 13))
    q[0] = p[0]
    got = elastic.elastic_distance(p, q, reach, penalty)
    assert got == pytest.approx([plain_elastic(a, b, reach, penalty) for a, b in zip(p, q)]) and got[0] == 0
    # A warped copy of a curve is nearer than its unaligned distance says.
    t = np.linspace(0, 1, 60)
    slope = lambda x: np.gradient(x, t)
    one, two = (slope(np.sin(6 * g)) for g in (t, t**1.5))
    one, two = (np.sign(x) * np.sqrt(np.abs(x)) for x in (one, two))
    assert elastic.elastic_distance(one[None], two[None])[0] < 0.4 * np.sqrt(((one - two) ** 2).mean())
    v = make(spark, small(s=1, v=8, t=9))
    e = spark.createDataFrame([(0, 1), (2, 5)], "i_idx long, j_idx long")
    for r in kernels.edge_srvf(v, e, warp="elastic").collect():
        x = {w.voxel_id: np.array(w.q) for w in v.withColumn("q", srvf(F.col("series"))).collect()}
        assert r.w == pytest.approx(plain_elastic(x[r.i_idx], x[r.j_idx], 4, 0.0))


def test_sums_made_in_tiles_equal_those_of_edges(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST", 2)
    monkeypatch.setattr(pairs, "WIDE", 3)
    rng = np.random.default_rng(12)
    v = sources.from_arrays(spark, rng.normal(size=(2, 40, 6)), np.array([[i, 0, 0] for i in range(40)]))
    labels = v.select("subject_id", "voxel_id", (F.col("voxel_id") % 4).cast("int").alias("label")).where("voxel_id <> 7")
    w = kernels.correlation_adjacency(v, r_min=0.2, block_size=64)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    ends = kernels.correlation_ends(v, labels, 0.2, block_size=5)
    assert rows(metrics.silhouette_of_ends(ends, labels)) == rows(metrics.silhouette_strict(w, labels))
    assert rows(metrics.modularity_of_ends(ends)) == rows(metrics.modularity(w, labels))
    near = kernels.correlation_near(v, labels.where("label > 0"), 0.2, block_size=5)
    for rest in ("nearest", "all"):
        assert rows(metrics.silhouette_of_near(near, rest)) == rows(metrics.silhouette_graph(w, labels, rest))
    assert rows(kernels.correlation_normalized(v, 0.2, block_size=5)) == rows(graph.normalized(w))
    assert rows(kernels.correlation_adjacency(v, r_min=0.2, block_size=5)) == rows(w)


def test_parts_of_all_pairs_travel_a_bounded_number_of_times(spark, monkeypatch):
    held = []
    real = pairs.F.sequence
    monkeypatch.setattr(pairs.F, "sequence", lambda a, b: held.append(b) or real(a, b))
    rows = spark.range(2000).select(F.lit(0).alias("subject_id"), F.col("id").alias("voxel_id"), F.array(F.lit(1.0)).alias("series"))
    out = pairs.tiles(rows, lambda s, i, x, j, y: ([len(i) * (len(i) - 1) // 2 if j is None else len(i) * len(j)],), "n long", 16)
    assert out.agg(F.sum("n")).first()[0] == 2000 * 1999 // 2  # every pair once
    assert spark.range(1).select(held[0]).first()[0] < 20  # parts; blocks of 16 would be 125


def test_last_rounds_of_merging_in_one_task_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pick = [(s, i, j, float(rng.integers(1, 9))) for s, n in ((0, 14), (1, 25)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
    w = spark.createDataFrame(pick + [(2, 0, i, 1.0) for i in range(1, 9)], "subject_id int, i_idx long, j_idx long, w double")
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in greedy.dendrogram(w).collect())
    tables = []
    monkeypatch.setattr(greedy, "durable", lambda df, real=greedy.durable: tables.append(df) or real(df))
    whole = rows()
    assert len(tables) < 6  # a star of nine took eight rounds of three tables
    monkeypatch.setattr(greedy, "HELD", 12)
    assert rows() == whole


def _lattice(spark, s=2, v=60, t=24):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, t))
    data = base[np.arange(v) % 3][None] + rng.normal(size=(s, v, t))
    return sources.from_arrays(spark, data, np.stack([np.arange(v), np.zeros(v), np.zeros(v)], axis=1))


def test_tiles_multiply_as_their_edges_do(spark):
    v = _lattice(spark)
    edges, norm = kernels.all_pairs(v, "correlation", 0.2).toPandas(), kernels.all_pairs_graph(v, "correlation", 0.2, block_size=16).normal()[0]
    y = norm.rows.select("subject_id", "voxel_id", F.array(F.lit(1.0), F.sin("voxel_id")).alias("cur"))
    got = norm.times(y).toPandas().sort_values("voxel_id")
    for s in (0, 1):
        e = edges[edges.subject_id == s]
        w = np.zeros((60, 60))
        w[e.i_idx, e.j_idx] = w[e.j_idx, e.i_idx] = e.w
        root = 1 / np.sqrt(w.sum(0))
        x = np.stack([np.ones(60), np.sin(np.arange(60))], axis=1)
        assert np.allclose(np.stack(got[got.subject_id == s].cur), root[:, None] * (w @ (root[:, None] * x)), atol=1e-12)


def test_consensus_clusters_need_no_pairs(spark, monkeypatch):
    from voxelgraph.operators import spectral

    rng = np.random.default_rng(5)
    labels = np.where(rng.random((3, 90)) < 0.8, np.arange(90)[None] % 3 + 1, rng.integers(0, 4, (3, 90)))
    table = spark.createDataFrame([(s, n, int(labels[s, n])) for s in range(3) for n in range(90)], "subject_id int, voxel_id long, label int")
    nodes = table.where("subject_id = 0").select("subject_id", "voxel_id")
    w = consensus.consensus_all_pairs(table).where("w > 0").select(F.lit(0).alias("subject_id"), "i_idx", "j_idx", "w")
    left = consensus.leave_one_out_all_pairs(table).where("w > 0").select(F.col("held_out").alias("subject_id"), "i_idx", "j_idx", "w")
    few = lambda d: {(r.subject_id, r.voxel_id): r.label for r in d.collect()}
    want = few(spectral_clustering(w, nodes, 3)), few(spectral_clustering(left, table, 3))
    assert consensus.consensus_clusters(table, nodes, 3) is None  # few voxels: the graph itself
    monkeypatch.setattr(spectral, "DENSE", 85)
    assert few(consensus.consensus_clusters(table, nodes, 3)) == want[0]
    assert few(consensus.consensus_clusters(table, table, 3, True)) == want[1]


def test_grams_of_subjects_that_differ_in_length(spark):
    rows = spark.createDataFrame([(s, [float(s + c + n) for c in range(s + 2)]) for n in range(4) for s in (0, 1)], "subject_id int, series array<double>").coalesce(1)
    got = {r.subject_id: r for r in basis.grams(rows).collect()}
    assert {s: (r.n, len(r.sums), len(r.gram)) for s, r in got.items()} == {0: (4, 2, 4), 1: (4, 3, 9)}
    assert got[0].sums == [6.0, 10.0] and got[1].sums == [10.0, 14.0, 18.0]


def test_a_tile_counts_kinds_of_voxels_and_makes_the_kept_pairs_only():
    rng = np.random.default_rng(4)
    ids = rng.permutation(400)
    i, j, x = ids[:200], ids[200:], rng.integers(0, 3, (400, 3)).astype(float)
    for left, right in ((i, None), (i, j)):
        to = left if right is None else right
        (a, own), (b, other) = consensus._kinds(x[left]), consensus._kinds(x[to])
        assert len(a) <= 27 and (a[own] == x[left]).all()
        agree, cnt = consensus._counted(a, b)
        got = consensus._cells(left, own, right, other, agree > 0, agree, cnt)
        pairs = {(min(u, v), max(u, v)) for u in left for v in to if u != v}
        want = {(u, v, n, int(((x[u] > 0) & (x[v] > 0)).sum())) for u, v in pairs if (n := int(((x[u] == x[v]) & (x[u] > 0)).sum()))}
        assert len(got[0]) == len(want) and set(zip(*(c.tolist() for c in got))) == want


@pytest.mark.parametrize("method", ["correlation", "l2"])
def test_rough_products_keep_the_weights_that_exact_ones_keep(spark, method):
    from voxelgraph.operators import tiled

    rng = np.random.default_rng(8)
    x = kernels.standardize(rng.normal(size=(300, 12)))
    side = kernels.standardize(rng.normal(size=(300, 12)))
    side -= (side * x).sum(1, keepdims=True) / 11 * x
    side *= np.sqrt(11) / np.linalg.norm(side, axis=1, keepdims=True)
    r = 0.3 + rng.choice([-1e-12, -1e-8, 1e-12, 1e-8], 300)[:, None]  # in single precision all of these are the cut
    y = r * x + np.sqrt(1 - r * r) * side
    finish = (lambda s, d: np.exp(-d * d / 2)) if method == "l2" else None
    cut = float(np.exp(-0.7)) if finish else 0.3  # of rows with r = 0.3 the squared distance over T is 1.4 * 11 / 12
    cut = float(np.exp(-0.7 * 11 / 12)) if finish else cut
    g = tiled.TiledGraph(None, kernels.rms if finish else kernels.correlation, kernels._predicate(cut, False), finish, error=kernels._rounding(method, "rbf", finish), cut=cut)
    exact, rough = (np.vstack([w for _, w in g.weigher(quick)(0, x, y)]) for quick in (False, True))
    assert exact.dtype == np.float64 and rough.dtype == np.float32
    assert ((exact > 0) == (rough > 0)).all() and np.abs(exact - rough).max() < 1e-5
    assert 100 < np.diag(exact > 0).sum() < 200 and np.abs(np.diag(exact)[np.diag(exact) > 0] - cut).max() < 1e-6
    norm = kernels.all_pairs_graph(_lattice(spark), method, 0.2, block_size=16).normal()[0]
    cur = norm.rows.select("subject_id", "voxel_id", F.array(F.lit(1.0), F.sin("voxel_id")).alias("cur"))
    a, b = (np.stack(norm.times(cur, quick).orderBy("subject_id", "voxel_id").toPandas().cur) for quick in (False, True))
    assert 0 < np.abs(a - b).max() < 1e-6


@pytest.mark.parametrize("wrong", [False, True])
def test_medians_of_all_pairs_from_a_guess(spark, monkeypatch, wrong):
    from voxelgraph.operators import medians

    monkeypatch.setattr(kernels, "GUESS", 12)
    monkeypatch.setattr(kernels, "GUESSED", 0.2)
    monkeypatch.setattr(medians, "LISTED", 20)
    if wrong:
        real = kernels._guessed
        monkeypatch.setattr(kernels, "_guessed", lambda *a: {s: (lo / 9, hi / 9) for s, (lo, hi) in real(*a).items()})
    base = kernels.map_series(_lattice(spark), kernels.standardize).select("subject_id", "voxel_id", "series")
    passes, counted = [], kernels.dealt
    monkeypatch.setattr(kernels, "dealt", lambda *a: passes.append(a[2]) or counted(*a))
    got = kernels._far_medians(base, 16)
    for s, rows in base.toPandas().groupby("subject_id"):
        x = np.stack(rows.series)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2))[np.triu_indices(60, 1)]
        assert got[s] == pytest.approx(np.median(d), rel=1e-12)
    assert len(passes) == (3 if wrong else 2)  # a count and a list, one count more where the guess was wrong
    x = np.stack(rows.series)
    assert kernels.tile_histogram(np.arange(60), x, None, None, (1.0, 1.2)).sum() == 60 * 59 // 2


@pytest.mark.parametrize(("full", "r_min"), [(0.15, 0.0), (2.0, None), (0.0, 0.5)])
def test_a_group_of_tiles_makes_k_candidates_a_voxel(spark, monkeypatch, full, r_min):
    monkeypatch.setattr(pairs, "FULL", full)
    monkeypatch.setattr(pairs, "MOST", 2)
    rng = np.random.default_rng(6)
    v = sources.from_arrays(spark, rng.integers(0, 3, (2, 70, 4)).astype(float), np.array([[i, 0, 0] for i in range(70)]))
    dots = lambda a, b: a @ b.T / 8  # noqa: E731  many ties
    made, real = [], pairs.dealt
    monkeypatch.setattr(pairs, "dealt", lambda *a: made.append(real(*a)) or made[-1])
    got = {(r.subject_id, r.i_idx, r.j_idx): r.w for r in kernels.all_pairs_top(v, 3, dots, r_min=r_min, block_size=8).collect()}
    monkeypatch.undo()
    assert got == {(r.subject_id, r.i_idx, r.j_idx): r.w for r in graph.top_k(kernels.all_pairs(v, dots, r_min=r_min), 3).collect()}
    sizes = [(r.first, len(r.ids) // 8, len(r.who) // 8) for r in made[0].collect()]
    assert all(b == 3 * a for _, a, b in sizes) and sum(b for *_, b in sizes) <= 2 * 70 * 2 * 3  # subjects, voxels, parts, k


def test_a_round_of_merging_sorts_the_edges_of_what_merges_only(monkeypatch):
    from voxelgraph.operators import greedy

    sorted_, real = [], greedy._joined
    monkeypatch.setattr(greedy, "_joined", lambda a, *more: sorted_.append(len(a)) or real(a, *more))

    class Rows:
        groupBy = lambda self, *a: self
        applyInPandas = lambda self, run, schema: run

    n = 60  # a hub that all its leaves prefer, one merge a round, and a ring that merges early
    a = np.concatenate([np.zeros(n - 1, int), n + np.arange(n - 1)])
    b = np.concatenate([np.arange(1, n), n + 1 + np.arange(n - 1)])
    w = np.concatenate([np.arange(n - 1) % 7 + 5.0, np.ones(n - 1)])
    deg = np.bincount(a, w, 2 * n) + np.bincount(b, w, 2 * n)
    out = greedy._finished(Rows(), 3)(pd.DataFrame({"subject_id": 4, "a": a, "b": b, "w": w, "da": deg[a], "db": deg[b], "m": w.sum()}))
    assert len(out) == 2 * n - 2 and out["round"].min() == 3 and out["round"].max() >= n  # down to the two parts
    ring = out[out["kept"] >= n]
    hub = out[out["kept"] < n].sort_values("round")
    assert len(ring) == n - 1 and (hub["kept"] == 0).all() and (hub["deg"].diff().dropna() > 0).all()
    left = 2 * n - 2 - np.cumsum(np.bincount(out["round"] - 3))  # each merge in a tree takes one edge away
    assert sorted_[0] == 2 * n - 2 and sum(sorted_[1:]) < (left.sum() + sorted_[0]) * 0.8


def test_ends_of_several_labellings_are_those_of_each(spark, monkeypatch):
    v = _lattice(spark)
    one = v.select("subject_id", "voxel_id", (F.col("voxel_id") % 4).cast("int").alias("label")).where("voxel_id <> 7")
    two = v.select("subject_id", "voxel_id", (F.col("voxel_id") % 3).cast("int").alias("label")).where("voxel_id > 11")
    either = lambda df: df.groupBy("subject_id", F.least("li", "lj"), F.greatest("li", "lj")).agg(F.round(F.sum("w"), 9))
    rows = lambda df: sorted(map(tuple, either(df).collect()))
    passes, real = [], pairs.tiles
    monkeypatch.setattr(pairs, "tiles", lambda *a, **k: passes.append(1) or real(*a, **k))
    got = [rows(e) for e in kernels.correlation_ends_of(v, [one, two], 0.2, block_size=16)]
    assert len(passes) == 1
    assert got == [rows(kernels.correlation_ends(v, labels, 0.2, block_size=64)) for labels in (one, two)]


def test_the_randomized_query_makes_no_edge(spark, monkeypatch):
    from voxelgraph.operators import spectral, tiled
    from voxelgraph.plans import queries

    run = lambda: {r.voxel_id: r.label for r in queries.queries()["spectral_randomized"](spark, "/root/testdata/sf0.001").collect()}
    whole = run()
    monkeypatch.setattr(spectral, "DENSE", 100)
    made, real = [], tiled.TiledGraph.edges
    monkeypatch.setattr(tiled.TiledGraph, "edges", lambda self: made.append(self.rows.count()) or real(self))
    assert run() == whole and made == [0]  # edges of no subject
