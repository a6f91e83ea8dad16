"""Near-duplicate vectors by dual traversal of cover trees: exactly the pairs whose cosine reaches a threshold.

Vectors are compared as points of the unit sphere, where a cosine is a distance. The top of the tree is a farthest-first net of a
bounded sample: each vector joins its nearest centre's cell, whose covering radius is measured over all its members, and pairs of
cells that are further apart than their radii allow are never brought together. A cell is dealt into blocks of about BLOCK vectors,
however many it holds. Each block grows a cover tree once: nested levels whose radii halve, every centre also a centre of all finer
levels. Laid out depth first with centres first, a vector's coarsest level is all that has to travel to rebuild the tree.

Two blocks meet in a task, and their trees are walked down together. A pair of nodes is dropped if its centres are further apart than
the threshold plus both covering radii (measured, not the level's bound), and taken whole if all its members must be near enough, so
groups of copies are never expanded into pairs; only what is left goes a level down, to single vectors at last, which are compared by
their cosine in double precision. Of a task only each vector's number of links and its component's smallest id leave.

Work: a tree can't prune what its radii don't separate. Unrelated vectors of many dimensions all lie about as far apart as the
covering radii, so blocks of them are compared in full, as matrix products: that part grows with the square of the distinct vectors.
The index isn't approximate: recall is 1.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths don't
either; rows that repeat a vec_id are vectors of their own (each with its links) that share a component, null ids likewise as one
largest id; equal vectors link; an empty table gives an empty result; other columns are not read. Vectors must fit a task BLOCK at a
time; a block holds fewer where vectors are long (BYTES).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions.series import matrix
from voxelgraph.llm.components import components
from voxelgraph.storage import durable, release

LAST = (1 << 63) - 1

#: Vectors of a block, and bytes of one as doubles; cells and the sample they are found on, at most.
BLOCK, BYTES, CELLS, SAMPLE = 8192, 128 << 20, 1024, 4096

#: Levels below a block's root, each of half the radius of the one before.
LEVELS = 5

#: What rounding may do to a distance near 0; closer calls are left to the vectors themselves.
MARGIN = 1e-7

#: Covering radii that part nodes into kinds.
WIDTHS = np.array([0.0, 0.1, 0.25, 0.5, 0.75])

#: Rows of a matrix product, node pairs compared at a time, and edges held before they are condensed.
STRIP, PAIRS, EDGES = 1024, 1 << 16, 1 << 21


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def far(c: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of cosine c."""
    return np.sqrt(np.maximum(2 - 2 * c, 0))


def net(x: np.ndarray, idx: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy net of the vectors idx: groups whose first is the centre and has all others within the radius, the first of them idx[0]'s.
    x may be single precision: covering radii are measured afterwards."""
    least, rest, out = 1 - radius * radius / 2, idx, []
    size = 1
    while len(rest):
        head = rest[:size]
        near = x[head] @ x[head].T >= least
        centre, covered = [], np.zeros(len(head), bool)
        for i in range(len(head)):
            if not covered[i]:
                centre.append(i)
                covered |= near[i]
        c = head[centre]
        cos = x[rest] @ x[c].T
        cos[np.arange(len(head))[centre], np.arange(len(c))] = 2  # a centre is its own, whatever rounding says
        own = cos.argmax(1)
        hit = cos[np.arange(len(rest)), own] >= least
        order = np.argsort(own[hit], kind="stable")
        members, cuts = rest[hit][order], np.searchsorted(own[hit][order], np.arange(1, len(c)))
        out += [np.concatenate([[a], m[m != a]]) for a, m in zip(c, np.split(members, cuts))]
        rest, size = rest[~hit], 256
    return out


def top_radius(tau: float) -> float:
    """The coarsest radius, a power of 1/2, at which two nodes can be further apart than tau and both radii: points of the sphere are 2
    apart at most, so coarser levels couldn't prune."""
    return 2.0 ** np.floor(np.log2(max(1 - tau / 2, 2.0**-20)))


def grow(x: np.ndarray, top: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """The cover tree of unit vectors x: their depth-first order, and in that order the coarsest level at which each is a centre (0: the
    root, LEVELS + 1: no centre, a leaf)."""
    quick, level, groups = x.astype(np.float32), np.full(len(x), LEVELS + 1), [np.arange(len(x))]
    level[0] = 0
    for l in range(1, LEVELS + 1):
        finer = []
        for g in groups:
            parts = net(quick, g, top * 2.0 ** (1 - l)) if len(g) > 1 else [g]
            level[[p[0] for p in parts[1:]]] = l
            finer += parts
        groups = finer
    order = np.concatenate(groups)
    return order, level[order]


@dataclass
class Tree:
    """A block in depth-first order: at each level where nodes begin and end and their covering radii."""

    raw: np.ndarray
    level: np.ndarray

    def __post_init__(self):
        self.n, self.length = len(self.raw), np.linalg.norm(self.raw, axis=1)
        self.x = self.raw / self.length[:, None]
        self.quick = self.x.astype(np.float32)
        self.begin, self.end, self.radius = [], [], []
        for l in range(LEVELS + 2):
            b = np.flatnonzero(self.level <= l)
            size = np.diff(np.append(b, self.n))
            d = far(np.einsum("ij,ij->i", self.x, self.x[np.repeat(b, size)]))
            d[b] = 0
            self.begin.append(b)
            self.end.append(b + size)
            self.radius.append(np.maximum.reduceat(d, b))
        self.links = np.zeros(self.n + 1, np.int64)  # steps of the number of links along the order
        self.joined = np.zeros(self.n + 1, np.int64)  # steps of how many wholly linked nodes cover this vector and the one before

    def children(self, l: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which node of level l + 1 the nodes p of level l have children."""
        return np.searchsorted(self.begin[l + 1], self.begin[l][p]), np.searchsorted(self.begin[l + 1], self.end[l][p])

    def add(self, l: int, p: np.ndarray, n: np.ndarray) -> None:
        """n links for each vector in the nodes p, which hang together."""
        b, e = self.begin[l][p], self.end[l][p]
        np.add.at(self.links, b, n)
        np.add.at(self.links, e, -n)
        many = e - b > 1
        np.add.at(self.joined, b[many] + 1, 1)
        np.add.at(self.joined, e[many], -1)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n items the smallest that can be reached over the edges u, v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def ragged(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run, and the place in it, of each item in runs of these sizes."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


class Walk:
    """Dual traversal of two trees, or of one with itself."""

    def __init__(self, a: Tree, b: Tree | None, threshold: float):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.threshold, self.tau = threshold, float(far(np.float64(threshold)))
        self.shift = 0 if self.same else a.n
        self.u, self.v, self.held = [], [], 0
        self.compared = 0  # pairs of nodes whose distance was taken

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of each vector and its component (the first in order), of tree a and then of tree b."""
        work = [(0, np.zeros(1, int), None if self.same else np.zeros(1, int))]
        while work:
            l, p, q = work.pop()
            work += self._within(l, p) if q is None else self._between(l, p, q)
        trees = [self.a] if self.same else [self.a, self.b]
        for base, t in zip((0, self.shift), trees):
            at = np.flatnonzero(np.cumsum(t.joined[: t.n]) > 0) + base
            self._edges(at, at - 1)
        n = sum(t.n for t in trees)
        return np.concatenate([np.cumsum(t.links[: t.n]) for t in trees]), roots(n, np.concatenate([*self.u, np.zeros(0, int)]), np.concatenate([*self.v, np.zeros(0, int)]))

    def _edges(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > EDGES:
            n = self.a.n + (0 if self.same else self.b.n)
            label = roots(n, np.concatenate(self.u), np.concatenate(self.v))
            at = np.flatnonzero(label != np.arange(n))
            self.u, self.v, self.held = [at], [label[at]], 0

    def _within(self, l: int, p: np.ndarray) -> list:
        """Nodes of level l against themselves."""
        t = self.a
        size = t.end[l][p] - t.begin[l][p]
        whole = (2 * t.radius[l][p] <= self.tau - MARGIN) & (size > 1)
        t.add(l, p[whole], size[whole] - 1)
        p = p[~whole & (size > 1)]
        work = []
        for one in p:
            c0, c1 = (int(c[0]) for c in t.children(l, np.array([one])))
            work.append((l + 1, np.arange(c0, c1), None))
            work += self._dense(l + 1, c0, c1, c0, c1)
        return work

    def _between(self, l: int, p: np.ndarray, q: np.ndarray) -> list:
        """Pairs of different nodes of level l, whose children are to be compared."""
        work = []
        (p0, p1), (q0, q1) = self.a.children(l, p), self.b.children(l, q)
        n = (p1 - p0) * (q1 - q0)
        for i in np.flatnonzero(n > PAIRS):
            work += self._dense(l + 1, p0[i], p1[i], q0[i], q1[i])
        few = np.flatnonzero(n <= PAIRS)
        cut = np.searchsorted(np.cumsum(n[few]), np.arange(PAIRS, n[few].sum() + PAIRS, PAIRS), side="right")
        for part in np.split(few, np.unique(cut[:-1])) if len(few) else []:
            which, place = ragged(n[part])
            width = (q1 - q0)[part][which]
            work += self._judge(l + 1, p0[part][which] + place // np.maximum(width, 1), q0[part][which] + place % np.maximum(width, 1))
        return work

    def _dense(self, l: int, p0: int, p1: int, q0: int, q1: int) -> list:
        """All pairs of two ranges of nodes of level l by matrix products; of a range with itself each pair once."""
        a, b, work = self.a, self.b, []
        same = self.same and p0 == q0 and p1 == q1
        radius = b.radius[l][q0:q1]
        kind = np.searchsorted(WIDTHS, radius)  # nodes of about one radius go together: most are single vectors, which bound best
        for one in np.unique(kind):
            columns = np.flatnonzero(kind == one) + q0
            widest, points = radius[columns - q0].max(), b.quick[b.begin[l][columns]]
            for s in range(p0, p1, STRIP):
                e = min(p1, s + STRIP)
                first = np.searchsorted(columns, s) if same else 0
                least = 1 - (self.tau + a.radius[l][s:e] + widest) ** 2 / 2 - 1e-5  # single precision
                p, q = np.nonzero(a.quick[a.begin[l][s:e]] @ points[first:].T >= least[:, None].astype(np.float32))
                p, q = p + s, columns[q + first]
                if same:
                    p, q = p[p < q], q[p < q]
                self.compared += (e - s) * (len(columns) - first)
                work += self._judge(l, p, q)
        return work

    def _judge(self, l: int, p: np.ndarray, q: np.ndarray) -> list:
        """Drop, take whole, or hand on pairs of nodes of level l."""
        a, b, work = self.a, self.b, []
        for s in range(0, len(p), PAIRS):
            i, j = p[s : s + PAIRS], q[s : s + PAIRS]
            self.compared += len(i)
            u, v = a.begin[l][i], b.begin[l][j]
            nu, nv = a.end[l][i] - u, b.end[l][j] - v
            d = far(np.einsum("ij,ij->i", a.x[u], b.x[v]))
            r = a.radius[l][i] + b.radius[l][j]
            alive = d <= self.tau + r + MARGIN
            take = d + r <= self.tau - MARGIN
            single = np.flatnonzero(alive & ~take & (nu == 1) & (nv == 1))
            cos = np.einsum("ij,ij->i", a.raw[u[single]], b.raw[v[single]]) / (a.length[u[single]] * b.length[v[single]])
            take[single] = cos >= self.threshold
            alive[single] = False
            a.add(l, i[take], nv[take])
            b.add(l, j[take], nu[take])
            self._edges(u[take], v[take] + self.shift)
            on = alive & ~take
            if on.any():
                work.append((l, i[on], j[on]))
        return work


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each the farthest from those before: a net at every radius on the way."""
    out, near = [0], x @ x[0]
    while len(out) < min(k, len(x)):
        at = int(near.argmin())
        if near[at] >= 1 - 1e-12:
            break
        out.append(at)
        near = np.maximum(near, x @ x[at])
    return x[out]


def _arrow(names: str, *columns) -> pa.Table:
    return pa.table(dict(zip(names.split(), columns)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of the threshold or more), component_id (the smallest vec_id reachable over links),
    kept (vec_id = component_id), for every row."""
    if not -1 < threshold <= 1:
        raise ValueError("threshold is a cosine above -1, at most 1")
    x = F.col(vector)
    wide = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    whole = F.coalesce(x.isNotNull() & (size(x) > 0) & (size(x) < float("inf")) & ~F.isnan(size(x)), F.lit(False))
    rows = durable(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.when(whole, x.cast(f"array<{wide}>")).alias("x")))
    good = rows.where("x is not null").select("rid", F.coalesce("vec_id", F.lit(LAST)).alias("node"), F.size("x").alias("dim"), "x")

    counts = {r.dim: r.n for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length of vector
    most = {d: max(64, min(block, BYTES // (8 * d))) for d in counts}
    share = {d: min(1.0, SAMPLE / n) for d, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit("centres"), "rid"), F.lit(1 << 30)) / float(1 << 30)
    split = {d: n for d, n in counts.items() if n > most[d]}
    centres: dict[int, np.ndarray] = {}
    for d in sorted(split, key=split.get)[-16:]:  # the commonest lengths; any other is one cell
        some = good.where((F.col("dim") == d) & (draw < share[d])).orderBy(F.xxhash64("rid")).limit(SAMPLE).select("x").toPandas()["x"]
        if len(some):
            centres[d] = farthest_first(units(np.stack(some.to_list()).astype(float)), min(cells, -(-counts[d] // most[d])))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def placed(table: pa.RecordBatch):
        """Batches of vectors of one length, with their cells and distances to the centres."""
        lengths = np.asarray(table.column("dim"))
        for d in np.unique(lengths):
            part = table.filter(pa.array(lengths == d))
            c = shared.value.get(int(d))
            if c is None:
                yield part, np.zeros(part.num_rows, "int32"), np.full(part.num_rows, 2.0)
            else:
                cos = units(matrix(part.column("x"))) @ c.T
                own = cos.argmax(1)
                yield part, own.astype("int32"), far(cos[np.arange(len(own)), own])

    def measure(batches):
        for batch in batches:
            for part, own, d in placed(batch):
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(own), pa.array(d)], names=["dim", "cell", "d"])

    found = good.mapInArrow(measure, "dim int, cell int, d double").groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()
    cell = {(r.dim, r.cell): (-(-r.n // most[r.dim]), r.r) for r in found}  # blocks, covering radius
    tau, near = float(far(np.float64(threshold))), []
    for d in counts:
        own = sorted(c for e, c in cell if e == d)
        r = np.array([cell[d, c][1] for c in own])
        apart = far(centres[d][own] @ centres[d][own].T) if d in centres else np.zeros((1, 1))
        ok = apart <= tau + r[:, None] + r[None, :] + MARGIN
        near += [(d, a, [(b, cell[d, b][0]) for b, o in zip(own, ok[i]) if o]) for i, a in enumerate(own)]
    parts = {k: n for k, (n, _) in cell.items()}

    def deal(batches):
        for batch in batches:
            for part, own, _ in placed(batch):
                rid, d = np.asarray(part.column("rid")), int(part.column("dim")[0].as_py())
                n = np.array([parts[d, c] for c in own.tolist()])
                sub = ((rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("node"), part.column("dim"), pa.array(own), pa.array(sub.astype("int32")), part.column("x")], names=["rid", "node", "dim", "cell", "sub", "x"])

    def plant(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("rid")
        order, level = grow(units(matrix(t.column("x"))), top_radius(tau))
        t = t.take(pa.array(order))
        return t.append_column("pos", pa.array(np.arange(len(order), dtype="int32"))).append_column("level", pa.array(level.astype("int32")))

    base = f"rid long, node long, dim int, cell int, sub int, x array<{wide}>"
    trees = durable(good.mapInArrow(deal, base).groupBy("dim", "cell", "sub").applyInArrow(plant, base + ", pos int, level int"))
    partners = vectors.sparkSession.createDataFrame(near, "dim int, cell int, near array<struct<cell: int, n: int>>")  # CELLS squared entries, at most
    every = trees.join(F.broadcast(partners), ["dim", "cell"])
    spread = F.flatten(F.transform("near", lambda c: F.transform(F.sequence(F.lit(0), c["n"] - 1), lambda s: F.struct(c["cell"].alias("cell"), s.alias("sub")))))
    here, there = F.struct("cell", "sub"), F.col("o")
    meets = every.withColumn("o", F.explode(spread))
    ends = lambda a, b: [F.struct(a.alias("a"), b.alias("b"), F.col("dim")).alias("tile"), "rid", "node", "x", "pos", "level"]
    left = meets.where(here <= there).select(*ends(here, there))
    right = meets.where(there < here).select(*ends(there, here)).toDF("tile2", "rid2", "node2", "x2", "pos2", "level2")

    def tree(t: pa.Table) -> tuple[pa.Table, Tree | None]:
        t = t.combine_chunks().sort_by("pos")
        return t, Tree(matrix(t.column("x")), np.asarray(t.column("level"))) if len(t) else None

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.rename_columns(a.column_names)
        alone = key[0].as_py()["a"] == key[0].as_py()["b"]
        (ta, left), (tb, right) = tree(a), tree(b)
        if left is None or right is None and not alone:
            return _arrow("rid node n root", *[pa.array([], pa.int64())] * 4)
        links, label = Walk(left, right, threshold).run()
        rid, node = (np.concatenate([np.asarray(t.column(c)) for t in ((ta,) if alone else (ta, tb))]) for c in ("rid", "node"))
        low = np.full(len(label), LAST)
        np.minimum.at(low, label, node)
        hit = links > 0
        return _arrow("rid node n root", rid[hit], node[hit], links[hit], low[label][hit])

    linked = durable(left.groupBy("tile").cogroup(right.groupBy("tile2")).applyInArrow(meet, "rid long, node long, n long, root long"))
    release(trees)
    reach = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = linked.groupBy("rid").agg(F.sum("n").alias("n_links"))
    out = rows.select("rid", "vec_id", F.coalesce("vec_id", F.lit(LAST)).alias("node")).join(total, "rid", "left").join(reach, "node", "left")
    own = F.coalesce("root", "node")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(own != LAST, own).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
