"""Cover-tree joins against all cosines."""

import numpy as np
import pytest

from voxelgraph.llm import cover_tree as ct
from voxelgraph.llm.cover_tree import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node string, cell int"


def groups(seed, n=600, dim=12, spread=0.25):
    """Vectors around few centres, some equal, some at the threshold's two sides."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dim))
    x[: n // 10] = x[n // 2 : n // 2 + n // 10]
    return x * rng.uniform(0.1, 10, n)[:, None]


def links(x, threshold=0.9):
    c = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]) >= threshold
    np.fill_diagonal(c, False)
    return c


def plain(ids, x, threshold=0.9):
    c = links(x, threshold)
    label = ct.roots(len(x), *np.nonzero(c))
    return {i: (int(c[n].sum()), ids[label[n]], ids[label[n]] == i) for n, i in enumerate(ids)}


def got(df, **more):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, **more).collect()}


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "n", 1) for i, v in zip(ids, x)], SCHEMA)


@pytest.mark.parametrize("threshold", [0.9, 0.99, 0.5, -0.2])
def test_walks_match_all_cosines(threshold):
    x = groups(1)
    top = ct.top_radius(float(ct.far(np.float64(threshold))))
    order, level = ct.grow(ct.units(x), top)
    assert sorted(order) == list(range(len(x)))
    tree = ct.Tree(x[order], level)
    for l in range(1, ct.LEVELS + 1):  # nested levels whose nodes keep within their radius
        assert set(tree.begin[l - 1]) <= set(tree.begin[l])
        assert tree.radius[l].max() <= top * 2.0 ** (1 - l) + 1e-3
    n, label = ct.Walk(tree, None, threshold).run()
    c = links(x[order], threshold)
    assert (n == c.sum(1)).all() and (label == ct.roots(len(x), *np.nonzero(c))).all()
    a, b = x[:250], x[250:]
    (oa, la), (ob, lb) = (ct.grow(ct.units(y), top) for y in (a, b))
    n, label = ct.Walk(ct.Tree(a[oa], la), ct.Tree(b[ob], lb), threshold).run()
    both = np.concatenate([a[oa], b[ob]])
    c = links(both, threshold)
    c[:250, :250] = c[250:, 250:] = False
    assert (n == c.sum(1)).all() and (label == ct.roots(len(x), *np.nonzero(c))).all()


def test_groups_of_copies_are_not_expanded():
    x = np.repeat(np.random.default_rng(2).normal(size=(3, 16)), 1000, axis=0) + 1e-3 * np.random.default_rng(3).normal(size=(3000, 16))
    order, level = ct.grow(ct.units(x))
    walk = ct.Walk(ct.Tree(x[order], level), None, 0.9)
    n, _ = walk.run()
    assert (n == 999).all() and walk.compared < 100


def test_edges_are_condensed(monkeypatch):
    monkeypatch.setattr(ct, "EDGES", 50)
    monkeypatch.setattr(ct, "PAIRS", 64)
    monkeypatch.setattr(ct, "STRIP", 100)
    x = groups(5, spread=0.45)
    order, level = ct.grow(ct.units(x))
    n, label = ct.Walk(ct.Tree(x[order], level), None, 0.9).run()
    c = links(x[order])
    assert (n == c.sum(1)).all() and (label == ct.roots(len(x), *np.nonzero(c))).all()


@pytest.mark.parametrize("block", [70, 8192])
def test_near_vectors_matches_all_cosines(spark, block):
    x = groups(7, 300)
    ids = [int(i) for i in np.random.default_rng(1).permutation(1000)[: len(x)]]
    order = np.argsort(ids)
    ids, x = [ids[i] for i in order], x[order]
    assert got(frame(spark, ids, x), block=block) == plain(ids, x)


def test_defined_edges(spark):
    one = [1.0, 0.0]
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, one), (8, [2.0, 0.1]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    out = got(frame(spark, *zip(*rows)))
    assert {i: v for i, v in out.items() if i not in (7, 8)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)}
    assert out[7] == (1, 7, True) and out[8] == (1, 7, False)
    again = near_vectors(frame(spark, [3, 3, None, None, 4], [one, one, one, None, [0.0, 1.0]])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in again) == [(-1, 0, 3, False), (-1, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)]
    lone = near_vectors(frame(spark, [None], [None])).first()
    assert (lone.vec_id, lone.n_links, lone.component_id) == (None, 0, None)
    assert got(frame(spark, [], [])) == {}
    with pytest.raises(ValueError):
        near_vectors(frame(spark, [], []), threshold=2)
