"""Density clustering at one radius or many, and the nested layers of a growing radius.

The rule, free of any visiting order. deg(i) counts the points within the radius of i, itself included. Points with
deg > minpts seed clusters; points with deg = minpts expand a cluster only if one of a smaller seed reaches them. Labels
start at the seeds, pass along edges into seeds, and into a semi-core point v where the label is below v; each point
keeps the smallest. Every other point takes the smallest label among its neighbours, or is noise. Clusters are numbered by
their labels in ascending order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.graph import components
from sylva.operators.knn import pairwise
from sylva.session import cut, ship

#: Radii that are clustered in one go, and batches of them that share one table of neighbours.
STEPS_AT_ONCE, BATCHES_AHEAD = 8, 2
#: Where no table of neighbours is needed, each batch has twice as many radii, up to so many rows times radii; of more rows than
#: this, those that tell nothing at its radii are left out.
ROWS_AT_ONCE, THIN_FROM = 1 << 22, 100_000
#: Cells along a radius where such rows are looked for.
FINE = 4
#: Up to so many neighbour pairs (32 MB) one task labels all points of a radius; beyond, joins do.
TASK_PAIRS = 2_000_000
#: Cells along a side of a tile (at least two rings), the ring of cells of its neighbours that it is given, and how far apart cells may touch.
TILE, RING, APART = 16, 4, 2
#: Distances that a tile looks at in one go, and up to how many between two cells are simply listed.
AT_ONCE, FEW = 1 << 21, 256
LABELLED = "step long, row_id long, label long, cluster int"


def neighbours(rows: DataFrame, radius: float, metric: str = "cosine", bits: int | None = None) -> DataFrame:
    """i, j, distance in both directions for pairs within the radius, self included unless its distance is NaN."""
    half = pairwise(rows, metric, bits, float(np.float32(radius)))
    flipped = half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")
    return half.unionByName(flipped)


def neighbours_on_grid(rows: DataFrame, radius: float) -> DataFrame:
    """The same for L2 in at most three dimensions: an equi-join on cells of the radius' width and their neighbours."""
    radius = float(np.float32(radius))
    first = rows.select(F.size("vector").alias("n")).first()
    n = first.n if first else 1
    if n > 3:
        raise ValueError("a grid serves at most three dimensions")
    cell = [F.floor(F.element_at("vector", d + 1) / radius) for d in range(n)]
    own = rows.select("row_id", "vector", *[c.alias(f"c{d}") for d, c in enumerate(cell)])
    near = own
    for d in range(n):
        near = near.withColumn(f"c{d}", F.explode(F.array(*[F.col(f"c{d}") + s for s in (-1, 0, 1)])))
    a, b = own.alias("a"), near.alias("b")
    same = [F.col(f"a.c{d}") == F.col(f"b.c{d}") for d in range(n)]
    square = sum(((F.element_at("a.vector", d + 1) - F.element_at("b.vector", d + 1)) * (F.element_at("a.vector", d + 1) - F.element_at("b.vector", d + 1)) for d in range(n)), F.lit(0.0))
    joined = a.join(b, same).select(F.col("a.row_id").alias("i"), F.col("b.row_id").alias("j"), F.sqrt(square).alias("distance"))
    return joined.where(F.col("distance") <= radius)


def degrees(nb: DataFrame) -> DataFrame:
    return nb.groupBy("i").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("i", "row_id")


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray, guard: np.ndarray) -> np.ndarray:
    """Pass labels along edges u to v until none falls; where guard holds only labels below v pass."""
    while True:
        pass_ = ~guard | (label[u] < v)
        after = label.copy()
        np.minimum.at(after, v[pass_], label[u[pass_]])
        if (after == label).all():
            return label
        label = after


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n is linked with, by links in both directions: hook to the smaller root, then jump."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[u], root[v])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _label(minpts: int):
    """The rule for all pairs of one radius, in one task.

    Without a column `degree` the pairs are all there are. With one they are those of tiles(), in one direction.
    """

    def run(table: pa.Table) -> pa.Table:
        step = table.column("step")[0].as_py()
        ids, at = np.unique(np.concatenate([np.array(table.column("i")), np.array(table.column("j"))]), return_inverse=True)
        i, j = at[: table.num_rows], at[table.num_rows :]
        n = len(ids)
        if "degree" in table.column_names:
            known = np.array(table.column("degree"))
            degree = np.zeros(n, np.int64)
            degree[i[known > 0]] = known[known > 0]
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        else:
            degree = np.bincount(i, minlength=n)
        seed, core = degree > minpts, degree >= minpts
        both = seed[i] & seed[j]
        root = _roots(n, i[both], j[both])
        none = n
        label = np.where(seed, root, none)
        inner = core[i] & core[j] & ~both & (i != j)
        a, b = np.where(seed[i], root[i], i)[inner], np.where(seed[j], root[j], j)[inner]
        label = _settle(label, a, b, ~seed[b])
        label = np.where(seed, label[root], label)
        settled = np.where(core, label, none)
        border = settled == none
        out = settled.copy()
        edge = border[j] & (settled[i] < none)
        np.minimum.at(out, j[edge], settled[i[edge]])
        got = np.flatnonzero(out < none)
        cluster = np.unique(out[got], return_inverse=True)[1]
        return pa.table({"step": pa.array(np.full(len(got), step), pa.int64()), "row_id": ids[got], "label": ids[out[got]], "cluster": pa.array(cluster, pa.int32())})

    return run


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range of n places, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether rows of a and b lie within the radius, by the distance of neighbours_on_grid."""
    square = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        square = square + (a[..., d] - b[..., d]) * (a[..., d] - b[..., d])
    return np.sqrt(square) <= radius


def _touch(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether some row of a lies within the radius of some row of b: halves whose boxes are too far apart are left out."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a_low, a_high, b_low, b_high = a.min(0), a.max(0), b.min(0), b.max(0)
        if not _within(np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0), np.zeros(a.shape[1]), radius):
            continue
        if len(a) * len(b) <= 1 << 14:
            if _within(a[:, None], b[None], radius).any():
                return True
            continue
        if _within(np.maximum(a_high - b_low, b_high - a_low), np.zeros(a.shape[1]), radius):
            return True
        if (a_high - a_low).max() < (b_high - b_low).max() or len(a) == 1:
            a, b, a_low, a_high = b, a, b_low, b_high
        axis = int((a_high - a_low).argmax())
        order = np.argpartition(a[:, axis], len(a) // 2)
        todo += [(a[order[len(a) // 2 :]], b), (a[order[: len(a) // 2]], b)]
    return False


class _Tile:
    """The points of a tile and the ring around it, in order of their cells; every cell is known by a place in a table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, place: np.ndarray, radius: float, minpts: int, home: np.ndarray, known: np.ndarray):
        self.radius, self.minpts, self.dims = radius, minpts, x.shape[1]
        self.wide = TILE + 2 * RING
        order = np.argsort(place, kind="stable")
        self.ids, self.x, self.place, self.home, self.known = ids[order], x[order], place[order], home[order], known[order]
        self.count = np.bincount(place, minlength=self.wide**self.dims)
        self.first = np.cumsum(self.count) - self.count
        at = np.stack(np.unravel_index(np.arange(self.wide**self.dims), [self.wide] * self.dims))
        self.own = ((at >= RING) & (at < RING + TILE)).all(0)
        #: Cells whose points have all their neighbours here.
        self.whole = ((at >= RING - APART) & (at < RING + TILE + APART)).all(0)
        self.offsets = list(product(range(-APART, APART + 1), repeat=self.dims))

    def _flat(self, offset: tuple[int, ...]) -> int:
        return sum(o * self.wide ** (self.dims - 1 - d) for d, o in enumerate(offset))

    def degrees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's neighbours, counted up to minpts + 1, and all pairs of the points that have no more than minpts.

        All points of a cell are neighbours; only those of cells with few look at the cells around, unless known as seeds.
        """
        degree = np.where(self.known | (self.count[self.place] > self.minpts), self.minpts + 1, 0)
        loose = np.flatnonzero(self.whole[self.place] & (degree == 0))
        near = self.place[loose][:, None] + np.array([self._flat(o) for o in self.offsets])[None, :]
        total = self.count[near].sum(1)
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        part = np.cumsum(total) // AT_ONCE
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            i = np.repeat(loose[own], total[own])
            j = _spread(self.first[near[own]].ravel(), self.count[near[own]].ravel())
            close = _within(self.x[i], self.x[j], self.radius)
            i, j = i[close], j[close]
            n = np.bincount(np.searchsorted(loose[own], i), minlength=len(own))
            degree[loose[own]] = np.minimum(n, self.minpts + 1)
            few = degree[i] <= self.minpts
            found_i.append(i[few]), found_j.append(j[few])
        return degree, np.concatenate(found_i), np.concatenate(found_j)

    def homed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One of the rows for each cell and known home: its place among them, its home's number, the homes."""
        at = np.flatnonzero(self.known[rows])
        homes, of = np.unique(self.home[rows[at]], return_inverse=True)
        pick = np.unique(self.place[rows[at]] * len(homes) + of, return_index=True)[1]
        return at[pick], of[pick], homes

    def homes(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of cells with seeds, each one's smallest seed, and the smallest of those it is linked with here.

        Cells are linked if two of their seeds are neighbours. The farthest seeds towards each other show most links;
        where they do not, and no other way joins the cells, all seeds are looked at. Cells of one known home are linked.
        """
        own = np.flatnonzero(seed & self.whole[self.place])
        ids, x = self.ids[own], self.x[own]
        cells, first, n = np.unique(self.place[own], return_index=True, return_counts=True)
        if not len(cells):
            return cells, ids, ids
        cell = np.repeat(np.arange(len(cells)), n)
        name = np.minimum.reduceat(ids, first)
        row = np.full(self.wide**self.dims + 1, -1)
        row[cells] = np.arange(len(cells))
        at, home, _ = self.homed(own)
        lead = np.full(home.max(initial=-1) + 1, len(cells))
        np.minimum.at(lead, home, cell[at])
        pairs, links = [], [(cell[at], lead[home])]
        for offset in self.offsets:
            if offset <= (0,) * self.dims:
                continue
            b = row[cells + self._flat(offset)]
            a = np.flatnonzero((b >= 0) & (self.own[cells] | self.own[cells[b]]))
            if not len(a):
                continue
            b = b[a]
            along = x @ np.array(offset, float)
            ends = []
            for far in (np.maximum, np.minimum):
                best = np.flatnonzero(along == far.reduceat(along, first)[cell])
                pick = np.zeros(len(cells), np.int64)
                pick[cell[best]] = best
                ends.append(pick)
            close = _within(x[ends[0][a]], x[ends[1][b]], self.radius)
            links.append((a[close], b[close]))
            pairs.append((a[~close], b[~close]))
        if not pairs:
            return cells, name, name
        a, b = (np.concatenate(c) for c in zip(*links, strict=True))
        root = _roots(len(cells), np.concatenate([a, b]), np.concatenate([b, a]))
        p, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
        left = root[p] != root[q]
        p, q = p[left], q[left]
        size = n[p] * n[q]
        few = np.flatnonzero(size <= FEW)
        more_a, more_b = [a], [b]
        part = np.cumsum(size[few]) // AT_ONCE
        for k in np.unique(part):
            here = few[part == k]
            i = _spread(first[p[here]], n[p[here]])
            which = np.repeat(here, n[p[here]])
            j = _spread(first[q[which]], n[q[which]])
            i, which = np.repeat(i, n[q[which]]), np.repeat(which, n[q[which]])
            hit = np.unique(which[_within(x[i], x[j], self.radius)])
            more_a.append(p[hit]), more_b.append(q[hit])
        a, b = np.concatenate(more_a), np.concatenate(more_b)
        root = _roots(len(cells), np.concatenate([a, b]), np.concatenate([b, a]))
        up = list(range(len(cells)))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        many = np.flatnonzero((size > FEW) & (root[p] != root[q]))
        for u, v in zip(p[many].tolist(), q[many].tolist(), strict=True):
            s, t = top(int(root[u])), top(int(root[v]))
            if s != t and _touch(x[first[u] : first[u] + n[u]], x[first[v] : first[v] + n[v]], self.radius):
                up[max(s, t)] = min(s, t)
        root = np.array([top(int(k)) for k in root])
        low = np.full(len(cells), np.iinfo(np.int64).max)
        np.minimum.at(low, root, name)
        return cells, name, low[root]


def _graph(dims: int, minpts: int, radii: list[float], brief: int):
    """What one tile tells of the pairs of one radius: in brief for the first so many radii."""

    def run(table: pa.Table) -> pa.Table:
        step = table.column("step")[0].as_py()
        x = np.stack([np.array(table.column(f"x{d}")) for d in range(dims)], 1)
        known, homes = np.array(table.column("home").is_valid()), np.array(table.column("home").fill_null(0))
        tile = _Tile(np.array(table.column("row_id")), x, np.array(table.column("place")).astype(np.int64), radii[step], minpts, homes, known)
        degree, i, j = tile.degrees()
        cells, name, low = tile.homes(degree > minpts)
        home = np.zeros(len(tile.count), np.int64)
        home[cells] = name
        node = np.where(degree > minpts, home[tile.place], tile.ids)
        apart = name != low
        held = np.flatnonzero(tile.own[tile.place])
        held = held[tile.homed(held)[0]]
        held = held[node[held] != tile.home[held]]
        if step < brief:
            core = np.flatnonzero(tile.own[tile.place] & (degree == minpts))
            heads = np.flatnonzero(tile.own[tile.place] & tile.known & (tile.ids == tile.home) & (tile.ids != node))
            named = np.append(name[tile.own[cells]], tile.ids[heads])
            few = tile.own[tile.place[i]] & (i != j) & (degree[i] == minpts) & (degree[j] >= minpts)
            first, end = np.append(tile.ids[core], named), node[j[few]]
            second, known = first, np.append(degree[core], np.full(len(named), minpts + 1))
        else:
            core = np.flatnonzero(tile.own[tile.place] & (degree >= minpts))
            few = tile.own[tile.place[i]] & (i != j)
            first, end = tile.ids[core], tile.ids[j[few]]
            second, known = node[core], degree[core]
        left, right = [first, tile.ids[i[few]], name[apart], node[held]], [second, end, low[apart], tile.home[held]]
        known = np.concatenate([known, np.zeros(few.sum(), np.int64), np.full(apart.sum() + len(held), -1)])
        return pa.table({"step": np.full(len(known), step, np.int64), "i": np.concatenate(left), "j": np.concatenate(right), "degree": known})

    return run


def _ends(rows: DataFrame) -> tuple[list[float], list[float]]:
    """The least and the greatest finite value in each dimension."""
    first = rows.select(F.size("vector").alias("n")).where("n > 0").first()
    n = first.n if first else 1
    if n > 3:
        raise ValueError("a grid serves at most three dimensions")
    ends = _finite(rows, n).agg(*[f(f"x{d}") for d in range(n) for f in (F.min, F.max)]).first()
    return [v or 0.0 for v in ends[::2]], [v or 0.0 for v in ends[1::2]]


def _finite(rows: DataFrame, n: int) -> DataFrame:
    """row_id, x0 and so on, home (null where rows have none) without nulls, NaN and infinities."""
    home = F.col("home") if "home" in rows.columns else F.lit(None).cast("long").alias("home")
    x = rows.select("row_id", *[F.element_at("vector", d + 1).alias(f"x{d}") for d in range(n)], home)
    for d in range(n):
        x = x.where(F.abs(f"x{d}") < float("inf"))
    return x


def tiles(rows: DataFrame, radii: list[float], minpts: int, brief: bool = False, last_whole: bool = False, ends: tuple | None = None) -> DataFrame:
    """step, i, j, degree: pairs that give the same clusters as all pairs of L2 in at most three dimensions.

    Each point has some, however many neighbours it has. Seeds are paired with one of their cell, and cells with one of
    those they are linked with; a point with at most minpts neighbours has all its pairs. Points with at least minpts have one
    pair with their degree, counted up to minpts + 1; elsewhere that is 0, or -1 for cells. Pairs are in one direction.
    The brief form has one seed of each cell in place of all, and no points that neither seed nor expand clusters: those
    that are left get the same labels, and each cluster has some. With `last_whole`, the last radius has the whole form.

    Rows may have a home: the smallest of the seeds that they are linked with at a smaller radius, where they were seeds
    themselves. They are seeds, however few of their neighbours are given, and are paired with their home, which has to be given.
    `ends` are the least and the greatest values, if known.

    All points of a cell are neighbours. A tile of cells is one group, with a ring of cells around it, so what is
    shuffled grows with the rows and not with their pairs. Rows with a null, NaN or infinity have no neighbours.
    """
    spark = rows.sparkSession
    ship(spark)
    radii = [float(np.float32(r)) for r in radii]
    if min(radii) <= 0:
        raise ValueError("radii have to be positive")
    low, high = ends or _ends(rows)
    n = len(low)
    x = _finite(rows, n)
    side = [0.99 / n**0.5 * r for r in radii]
    last = [[math.floor((high[d] - low[d]) / s) // TILE for d in range(n)] for s in side]
    steps = spark.createDataFrame([(k, r, s, *t) for k, (r, s, t) in enumerate(zip(radii, side, last, strict=True))], "step long, radius double, side double" + "".join(f", last{d} long" for d in range(n)))
    x = x.crossJoin(F.broadcast(steps)).select("*", *[F.floor((F.col(f"x{d}") - F.lit(low[d])) / F.col("side")).alias(f"c{d}") for d in range(n)])
    for d in range(n):
        tile = [F.expr(f"greatest(0, least(last{d}, (c{d} + {s}) div {TILE}))") for s in (-RING, RING)]
        x = x.withColumn(f"t{d}", F.explode(F.array_distinct(F.array(*tile))))
    wide = TILE + 2 * RING
    place = sum(((F.col(f"c{d}") - F.col(f"t{d}") * TILE + RING) * wide ** (n - 1 - d) for d in range(n)), F.lit(0))
    own = [f"t{d}" for d in range(n)]
    dealt = x.select("step", *own, "row_id", place.cast("short").alias("place"), *[f"x{d}" for d in range(n)], "home")
    whole = len(radii) if not brief else int(last_whole)
    return dealt.groupBy("step", *own).applyInArrow(_graph(n, minpts, radii, len(radii) - whole), "step long, i long, j long, degree long")


def _numbered(rows: DataFrame) -> DataFrame:
    names = rows.select("step", "label").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("step").orderBy("label")) - 1)
    return rows.join(names, ["step", "label"]).select("step", "row_id", "label", "cluster")


def dbscan_many(nb: DataFrame, radii: list[float], minpts: int, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """step, row_id, label, cluster for each radius in turn; noise is absent. Row ids are any longs.

    Where there are few pairs, one task labels each radius. Else seeds that touch are one component, found by
    logarithmically many joins for all radii at once; then labels pass between components and semi-core points until
    nothing changes. Both ways give the same rows. The neighbours are read several times, so cut or cache them.
    """
    spark = nb.sparkSession
    radii = [float(np.float32(r)) for r in radii]
    steps = spark.createDataFrame(list(enumerate(radii)), "step long, radius double")
    near = nb.select("i", "j", "distance").where(F.col("distance") <= max(radii))
    edges = near.join(F.broadcast(steps), F.col("distance") <= F.col("radius")).select("step", "i", "j")
    if task_pairs and near.count() <= task_pairs:
        ship(spark)
        return edges.groupBy("step").applyInArrow(_label(minpts), LABELLED)
    degree = edges.groupBy("step", F.col("i").alias("v")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= minpts)
    return _by_joins(edges, cut(degree.select("step", "v", (F.col("degree") > minpts).alias("seed"))))


def dbscan_on_grid(rows: DataFrame, radii: list[float], minpts: int, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """What dbscan_many gives for all pairs of neighbours_on_grid, from those of tiles(): as many as there are rows or so."""
    return _on_grid(cut(tiles(rows, radii, minpts)), minpts, task_pairs)


def clusters_on_grid(rows: DataFrame, radii: list[float], minpts: int, task_pairs: int = TASK_PAIRS) -> dict[int, int]:
    """How many clusters dbscan_on_grid finds at each radius that has some, without a row for every point."""
    return _counts(_on_grid(cut(tiles(rows, radii, minpts, True)), minpts, task_pairs))


def _one_home(minpts: int):
    """Seeds and their homes from the pairs of seeds that tiles() found."""

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(np.concatenate([np.array(table.column("i")), np.array(table.column("j"))]), return_inverse=True)
        i, j = at[: table.num_rows], at[table.num_rows :]
        root = _roots(len(ids), np.concatenate([i, j]), np.concatenate([j, i]))
        seed = i[np.array(table.column("degree")) > minpts]
        return pa.table({"row_id": ids[seed], "home": ids[root[seed]]})

    return run


def _homes(found: DataFrame, minpts: int, task_pairs: int) -> DataFrame:
    """row_id, home of the seeds of one radius, from what tiles() found in its whole form."""
    pairs = found.where((F.col("degree") > minpts) | (F.col("degree") < 0))
    if task_pairs and pairs.count() <= task_pairs:
        return pairs.groupBy("step").applyInArrow(_one_home(minpts), "row_id long, home long")
    return _seeds(found, minpts).select(F.col("v").alias("row_id"), F.col("component").alias("home"))


def _rehomed(rows: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows with homes of a larger radius, which are known for all that _thinned leaves: others move with their home."""
    old = F.col("home") if "home" in rows.columns else F.lit(None).cast("long")
    moved = rows.select("row_id", "vector", F.coalesce(old, "row_id").alias("at")).join(homes.withColumnRenamed("row_id", "at"), "at", "left")
    return moved.select("row_id", "vector", "home")


def _thinned(rows: DataFrame, reach: float, low: list[float]) -> DataFrame:
    """The rows (row_id, vector, home) that tell the clusters of radii up to `reach`, no smaller than that of their homes.

    Seeds stay seeds and linked ones linked. So a row is left out if all that lies within reach of its cell are seeds of its
    own home: it joins nothing, and no point that may still become a seed has it for a neighbour. The homes stay.
    """
    at = [f"c{d}" for d in range(len(low))]
    cell = _finite(rows, len(low)).select("row_id", "home", *[F.floor((F.col(f"x{d}") - F.lit(low[d])) / F.lit(reach / FINE)).alias(c) for d, c in enumerate(at)])
    near = cell.groupBy(*at).agg(F.min("home").alias("least"), F.max("home").alias("most"), F.max(F.col("home").isNull()).alias("other"))
    for c in at:
        shift = F.array(*[F.lit(k).cast("long") for k in range(-FINE - 1, FINE + 2)])
        near = near.withColumn("shift", F.explode(shift)).withColumn(c, F.col(c) + F.col("shift"))
        near = near.groupBy(*at).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("other").alias("other"))
    same = near.where("not other and least = most").select(*at, F.lit(True).alias("same"))
    told = cell.join(same, at, "left").where("same is null or row_id = home").select("row_id")
    return rows.join(told, "row_id", "left_semi")


def _counts(found: DataFrame) -> dict[int, int]:
    return {r.step: r.n for r in found.groupBy("step").agg(F.countDistinct("cluster").alias("n")).collect()}


def _on_grid(found: DataFrame, minpts: int, task_pairs: int) -> DataFrame:
    """Clusters from what tiles() found."""
    most = found.groupBy("step").count().agg(F.max("count")).first()[0] or 0
    if task_pairs and most <= task_pairs:
        return found.groupBy("step").applyInArrow(_label(minpts), LABELLED)
    core = cut(found.where("degree > 0").select("step", F.col("i").alias("v"), (F.col("degree") > minpts).alias("seed")))
    grown = _seeds(found, minpts)
    few = found.where("degree = 0")
    return _by_joins(few.select("step", "i", "j").unionByName(few.select("step", F.col("j").alias("i"), F.col("i").alias("j"))), core, grown)


def _seeds(found: DataFrame, minpts: int) -> DataFrame:
    """step, v, component of seeds, from what tiles() found."""
    linked = components(found.where("degree < 0").select("step", F.col("i").alias("a"), F.col("j").alias("b")), ("step",))
    seeds = found.where(F.col("degree") > minpts).select("step", F.col("i").alias("v"), F.col("j").alias("node"))
    return seeds.join(linked, ["step", "node"], "left").select("step", "v", F.coalesce("component", "node").alias("component"))


def _by_joins(edges: DataFrame, core: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """The rule for pairs (step, i, j) in both directions and the points with at least minpts neighbours (step, v, seed).

    Where the components of seeds are known (step, v, component), pairs of two seeds may be absent.
    """
    links = cut(edges.select("step", F.col("i").alias("u"), F.col("j").alias("v")).join(core.select("step", F.col("v").alias("u"), F.col("seed").alias("u_seed")), ["step", "u"]))
    between = links.join(core.select("step", "v", F.col("seed").alias("v_seed")), ["step", "v"])
    if grown is None:
        grown = components(between.where("u_seed and v_seed").select("step", F.col("u").alias("a"), F.col("v").alias("b")), ("step",)).withColumnRenamed("node", "v")
    home = cut(core.where("seed").select("step", "v").join(grown, ["step", "v"], "left").select("step", "v", F.coalesce("component", "v").alias("home")))
    # components and semi-core points; an edge carries a label from u to v
    semi = between.where("not (u_seed and v_seed) and u <> v")
    node = lambda c: F.when(F.col(f"{c}_seed"), F.col(f"{c}_home")).otherwise(F.col(c))
    thin = semi.join(home.select("step", F.col("v").alias("u"), F.col("home").alias("u_home")), ["step", "u"], "left").join(home.select("step", "v", F.col("home").alias("v_home")), ["step", "v"], "left")
    thin = cut(thin.select("step", node("u").alias("u"), node("v").alias("v"), "v_seed").distinct())
    labels = cut(home.select("step", F.col("home").alias("v"), F.col("home").alias("label")).distinct())
    while not thin.isEmpty():
        passed = thin.join(labels.withColumnRenamed("v", "u"), ["step", "u"]).where("v_seed or label < v").groupBy("step", "v").agg(F.min("label").alias("got"))
        after = cut(labels.join(passed, ["step", "v"], "full").select("step", "v", F.least("label", "got").alias("label")))
        settled = after.exceptAll(labels).isEmpty()
        labels = after
        if settled:
            break
    seeded = home.join(labels.withColumnRenamed("v", "home"), ["step", "home"]).select("step", "v", "label")
    inner = seeded.unionByName(labels.join(core.where("not seed").select("step", "v"), ["step", "v"], "left_semi"))
    reached = links.join(inner.withColumnRenamed("v", "u"), ["step", "u"]).groupBy("step", "v").agg(F.min("label").alias("label")).join(inner.select("step", "v"), ["step", "v"], "left_anti")
    return _numbered(inner.unionByName(reached).withColumnRenamed("v", "row_id"))


def dbscan(nb: DataFrame, radius: float = 0.015, minpts: int = 5, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """row_id, label, cluster at one radius; noise is absent."""
    return dbscan_many(cut(nb), [radius], minpts, task_pairs).drop("step")


def radii(start: float, step: float, n: int) -> list[float]:
    """start, start + step, ... by repeated single-precision addition."""
    out, now = [], np.float32(start)
    for _ in range(n):
        out.append(float(now))
        now = np.float32(now + np.float32(step))
    return out


@dataclass
class Layers:
    """members: layer, row_id, label, cluster, found when asked for; stats: one (layer, step, radius, clusters) for each layer.

    rows: the vectors that were clustered, where those were given.
    """

    find: Callable[[], DataFrame]
    stats: list[tuple[int, int, float, int]]
    rows: DataFrame | None = None

    @cached_property
    def members(self) -> DataFrame:
        return cut(self.find())


def adaptive(nb_at, start: float, step: float, minpts: int = 5, max_steps: int | None = None, largest: float = np.inf, task_pairs: int = TASK_PAIRS) -> Layers:
    """Layers of a growing radius; `nb_at(radius)` gives neighbours up to a radius.

    While the first radius gives one cluster it is halved, at most 20 times. Then the radius grows until at most one
    cluster is left, or until it has reached `largest`, beyond which no distance lies; a run is a layer if it has fewer
    clusters than the layer before. Layer 0 is the densest. If max_steps radii do not get there, or the radius cannot grow
    further, that is an error. Distances that may be NaN need `largest` (2 for cosine and Yule), as clusters may then stay
    apart for good. Radii are clustered several at once, and the neighbours of one table serve several such batches.
    """
    if float(np.float32(step)) <= 0:
        raise ValueError("the radius has to grow")
    near, reach = None, -np.inf

    def look(batch: list[float]) -> tuple[dict[int, int], Callable[[int], DataFrame], int]:
        nonlocal near, reach
        if batch[-1] > reach:
            reach = radii(batch[-1], step, 1 + (BATCHES_AHEAD - 1) * STEPS_AT_ONCE)[-1]
            near = cut(nb_at(reach))
        found = cut(dbscan_many(near, batch, minpts, task_pairs))
        return _counts(found), lambda k: found.where(F.col("step") == k), len(batch)

    stats, kept = _grown(look, start, step, max_steps, largest)
    return Layers(lambda: _layers([found.select(F.lit(k).alias("layer"), "row_id", "label", "cluster") for k, found in enumerate(kept)]), stats)


def adaptive_on_grid(rows: DataFrame, start: float, step: float, minpts: int = 5, max_steps: int | None = None, largest: float = np.inf, task_pairs: int = TASK_PAIRS) -> Layers:
    """adaptive() for L2 in at most three dimensions, by dbscan_on_grid: however many pairs lie within a radius.

    Clusters are only counted at first, from the rows that may still join or become seeds where there are many; points are
    found for the radii that are layers, from the same rows. Those that were left out are where their homes are.
    """
    if float(np.float32(step)) <= 0:
        raise ValueError("the radius has to grow")
    rows = cut(rows.select("row_id", "vector"))
    n = rows.count()
    ends = _ends(rows)
    homed, found, reach = rows, None, np.inf
    whole = _Seen(rows, n)

    def look(batch: list[float]) -> tuple[dict[int, int], Callable[[int], tuple], int]:
        nonlocal homed, found, reach
        if batch[0] <= reach:
            homed, found = rows, None
        wide, left, held = len(batch), homed, n
        if n > THIN_FROM and found is None:
            wide = 1  # the seeds of the first radius tell which rows the others need
        elif n > THIN_FROM:
            homed = cut(_rehomed(homed, _homes(found, minpts, task_pairs)))
            while True:
                left = cut(_thinned(homed, batch[wide - 1], ends[0]))
                held = left.count()
                fits = min(wide, max(STEPS_AT_ONCE, ROWS_AT_ONCE // max(1, held)))
                if 4 * fits >= wide:  # rows for a larger radius serve smaller ones as well
                    wide = fits
                    break
                wide = max(STEPS_AT_ONCE, wide // 4)
        pairs = cut(tiles(left, batch[:wide], minpts, True, True, ends))
        found, reach = pairs.where(F.col("step") == wide - 1), batch[wide - 1]
        if n <= THIN_FROM:
            seen = whole
        else:
            seen = _Seen(left, held, homed if left is not rows else None, pairs if wide == 1 else None)
        return _counts(_on_grid(pairs, minpts, task_pairs)), lambda k: (seen, batch[k]), wide

    def members() -> DataFrame:
        parts = []
        for seen, own in groupby(enumerate(kept), lambda at: at[1][0]):
            own = [(layer, radius) for layer, (_, radius) in own]
            most = max(STEPS_AT_ONCE, ROWS_AT_ONCE // max(1, seen.held))
            for at in range(0, len(own), most):
                some = own[at : at + most]
                part = seen.members([radius for _, radius in some], minpts, task_pairs, ends)
                parts.append(part.select((F.col("step") + some[0][0]).cast("int").alias("layer"), "row_id", "label", "cluster"))
        return _layers(parts)

    stats, kept = _grown(look, start, step, max_steps, largest, None)
    return Layers(members, stats, rows)


@dataclass(eq=False)
class _Seen:
    """What some radii were counted from: the rows that tell their clusters, how many, all rows with their homes where some
    were left out, and the whole pairs if there was one radius."""

    left: DataFrame
    held: int
    homed: DataFrame | None = None
    pairs: DataFrame | None = None

    def members(self, radii: list[float], minpts: int, task_pairs: int, ends: tuple) -> DataFrame:
        """What dbscan_on_grid gives for all rows; those that were left out are in the cluster of their home."""
        if self.homed is None:
            return dbscan_on_grid(self.left, radii, minpts, task_pairs) if self.pairs is None else _on_grid(self.pairs, minpts, task_pairs)
        pairs = self.pairs if self.pairs is not None else cut(tiles(self.left, radii, minpts, ends=ends))
        found = cut(_on_grid(pairs, minpts, task_pairs))
        out = self.homed.where("home is not null").join(self.left.select("row_id"), "row_id", "left_anti").select(F.col("row_id").alias("other"), F.col("home").alias("row_id"))
        return found.unionByName(out.join(found, "row_id").select("step", F.col("other").alias("row_id"), "label", "cluster"))


def _layers(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grown(look: Callable, start: float, step: float, max_steps: int | None, largest: float, most: int | None = STEPS_AT_ONCE) -> tuple[list, list]:
    """The stats of adaptive(), and what is kept of each layer.

    `look` counts the clusters at some radii, and tells for the n-th of them what to keep, and at how many it looked. Batches
    grow from STEPS_AT_ONCE radii to `most`, if there is such a bound.
    """
    for _ in range(21):
        kept, stats, least, done, after = [], [], None, 0, start
        while True:
            wide = min(most or np.inf, max(done, STEPS_AT_ONCE - done % STEPS_AT_ONCE))
            *batch, after = radii(after, step, 1 + (wide if max_steps is None else min(wide, max_steps - done)))
            counts, keep, looked = look(batch)
            batch, after = batch[:looked], [*batch, after][looked]
            if not done and counts.get(0, 0) == 1:
                break
            for k, radius in enumerate(batch):
                n = counts.get(k, 0)
                if least is None or n < least:
                    kept.append(keep(k))
                    stats.append((len(stats), done + k, radius, n))
                    least = n
                if n <= 1:
                    break
            done += len(batch)
            if least <= 1 or batch[-1] >= largest:
                break
            if done == max_steps or after <= batch[-1]:
                raise ValueError(f"{least} clusters are left at radius {batch[-1]}, after {done} steps")
        if stats:
            break
        start = float(np.float32(start) / 2)
    else:
        raise ValueError("one cluster at every radius tried")
    return stats, kept
