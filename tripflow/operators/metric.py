"""Exact neighbour operators in any number of dimensions: k-NN distances, neighbour counts, DBSCAN.

Points are collapsed to distinct vectors with multiplicities.  A bounded number of pivots cuts the space into Voronoi
cells; of each cell its radius, its size and its k points nearest to the pivot are known.  A point q, at distance d(q, p)
from the pivot p of a cell and d(q, o) from its own pivot o, can't be nearer to any point of that cell than

    d(q, p) - radius(p)     and     (d(q, p)^2 - d(q, o)^2) / (2 d(p, o)),

so it visits only cells whose bound is within its reach.  A visit is a row (point, cell); visits and points meet in tiles
of bounded size - a large cell's points are dealt out over several tiles, and so are its visits - so that neither a cross
join nor one task for a dense cell arises.  Tiles return one row for each visiting point or a forest over grid cells,
never pairs of points.

For k-NN the cells are boxes of a k-d tree, whose number grows with the points; in a tile, points and visits are cut into
leaves again, and a group of visits meets only the leaves that lie within its reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PIVOTS = 256          # at most so many; the broadcast table has PIVOTS * (dimensions + k) numbers
TILE_POINTS = 4096    # points of a tile, and sixteen times as many visits
BOXES = 2048          # boxes of a k-d tree, at most; the broadcast table has two numbers for each of them and dimension
BOX_POINTS = 32_768   # points of a box, about
BOX_SAMPLE = 32       # points that a box's cuts are taken from, about
LEAF = 128            # points of a leaf in a tile, and visits that meet leaves together
SLACK = 1e-9          # relative widening of reaches, for the rounding of bounds


def points_nd(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct points with multiplicity: (id, v, m).  Rows without a finite place are no points."""
    ensure_checkpoint_dir(df.sparkSession)
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return (df.select(v.alias("v")).where(F.forall("v", lambda x: F.abs(x) < float("inf")))
            .groupBy("v").agg(F.count("*").alias("m"))
            .select(F.monotonically_increasing_id().alias("id"), "v", "m").checkpoint())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j:j + 1] - b[None, :, j]
        out += d * d
    return np.sqrt(out)


def _long(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the points: never broadcast.  The planner's estimate counts one number a vector and
    takes a column of ids for a small table, so that it would send millions of rows through the driver."""
    return df.hint("merge")


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


@dataclass(frozen=True)
class Voronoi:
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray      # distinct points of each cell
    weight: np.ndarray    # with their multiplicities
    near: np.ndarray      # distances of the k points (copies counted) nearest to each pivot; inf where there are fewer

    def lower(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Least distance that any point of each cell can have from points at distances d from the pivots."""
        gap = distances(self.pivots, self.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (d * d)[np.arange(len(d)), own][:, None]) / (2 * gap)
        return np.maximum(np.maximum(d - self.radius, np.where(gap > 0, plane, 0.0)), 0.0)

    def kth(self, d: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point has k others: through the pivots, its own place aside."""
        reach = (d[:, :, None] + self.near[None, :, :]).reshape(len(d), -1)
        # one of the counted may be the point itself, so the bound is the next one
        return np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(d), np.inf)


def voronoi(points: DataFrame, k: int = 1, most: int = PIVOTS) -> tuple[DataFrame, Voronoi | None]:
    """Points with their cell and distance from its pivot (id, v, m, cell, r), and the cells."""
    n = points.count()
    if n == 0:
        return points.withColumns({"cell": F.lit(0), "r": F.lit(0.0)}), None
    take = min(most, max(1, int(n ** 0.5)))
    pivots = np.array([r["v"] for r in points.orderBy(F.xxhash64("v"), "v").limit(take).collect()])

    def run(batches):
        for b in batches:
            d = distances(_vectors(b.column(1)), pivots) if b.num_rows else np.empty((0, 1))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                                             names=["id", "v", "m", "cell", "r"])

    laid = points.mapInArrow(run, "id long, v array<double>, m long, cell int, r double").checkpoint()
    # the k nearest of each cell, copies counted: k rows a task and cell are enough
    stats = {r["cell"]: r for r in laid.groupBy("cell").agg(
        F.max("r").alias("radius"), F.count("*").alias("size"), F.sum("m").alias("weight")).collect()}
    near = np.full((take, k + 1), np.inf)
    for r in nearest_in_cells(laid, k + 1).collect():
        near[r["cell"], :len(r["near"])] = r["near"]
    get = lambda f, empty: np.array([stats[c][f] if c in stats else empty for c in range(take)])
    return laid, Voronoi(pivots, get("radius", -np.inf).astype(float), get("size", 0), get("weight", 0), near)


def nearest_in_cells(laid: DataFrame, k: int) -> DataFrame:
    """(cell, near): the k least distances from the pivot, copies counted; each task sends k a cell."""
    def run(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            cell, r, m = (b.column(j).to_numpy() for j in range(3))
            for c in np.unique(cell).tolist():
                own = cell == c
                add = np.repeat(r[own], np.minimum(m[own], k))
                best[c] = np.sort(np.r_[best.get(c, add[:0]), add])[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v.tolist() for v in best.values()])],
                                             names=["cell", "near"])
    part = laid.select("cell", "r", "m").mapInArrow(run, "cell int, near array<double>")
    return part.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def visits(queries: DataFrame, cells: Voronoi, reach_of, first: str = "all") -> DataFrame:
    """(id, v, reach, cell, whole): a row for each cell within reach.

    queries: (id, v, cell, ...); reach_of(batch, distances) gives each row's reach.  ``first``: "all" cells, the
    "others" (not the own one) or "later" (own and higher numbers).  A cell that lies wholly within reach isn't visited
    if first is "whole"; its weight is summed up in one row with a null cell and ``whole``."""
    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                v, own = _vectors(b.column(1)), b.column(2).to_numpy()
                d = distances(v, cells.pivots)
                reach = reach_of(b, d) * (1 + SLACK)
                go = (cells.lower(d, own) <= reach[:, None]) & (cells.size > 0)
                whole = np.zeros(len(v), np.int64)
                if first == "others":
                    go[np.arange(len(v)), own] = False
                elif first == "later":
                    go &= np.arange(len(cells.size)) >= own[:, None]
                elif first == "whole":
                    inside = (d + cells.radius <= reach[:, None] * (1 - 3 * SLACK)) & (cells.size > 0)
                    whole, go = inside @ cells.weight, go & ~inside
                q, c = np.nonzero(go)
                alone = np.flatnonzero(whole)
                rows = pa.array(np.r_[q, alone])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(reach[np.r_[q, alone]]),
                     pa.array(np.r_[c, np.zeros(len(alone), int)], pa.int32(), mask=np.r_[np.zeros(len(c), bool), np.ones(len(alone), bool)]),
                     pa.array(np.r_[np.zeros(len(c), np.int64), whole[alone]])], names=["id", "v", "reach", "cell", "whole"])
    return queries.mapInArrow(run, "id long, v array<double>, reach double, cell int, whole long")


def tiles(queries: DataFrame, laid: DataFrame, fn, schema: str, tile: int = TILE_POINTS) -> DataFrame:
    """fn(visits, points) of every tile: tables of (id, v, reach, ...) and (id, v, m, ...) of one cell.

    A cell with n points and q visits gets ceil(n / tile) * ceil(q / 16 tile) tiles; each visit goes to as many of them
    as hold its cell's points."""
    spark = laid.sparkSession
    held = laid.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("na"))
    come = queries.groupBy("cell").agg(F.ceil(F.count("*") / (16 * tile)).cast("int").alias("nb"))
    sizes = spark.createDataFrame([tuple(r) for r in held.join(come, "cell").collect()], "cell int, na int, nb int")
    # fresh names: both sides may come from one table
    left = queries.join(F.broadcast(sizes), "cell").select(
        *[F.col(c).alias(c) for c in queries.columns], F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ta"),
        F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("tb"))
    right = laid.join(F.broadcast(sizes), "cell").select(
        *[F.col(c).alias(c) for c in laid.columns], F.pmod(F.xxhash64("id", F.lit(1)), F.col("na")).cast("int").alias("ta"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("tb"))
    key = ["cell", "ta", "tb"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], schema=run.schema)
        return pa.table(dict(zip(names, fn(a, b))), schema=run.schema)
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    run.schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _slices(a: pa.Table, b: pa.Table, size: int = 512):
    """(first row, distances) for slices of the visits against all points of the tile."""
    x, y = _vectors(a["v"]), _vectors(b["v"])
    for at in range(0, len(x), size):
        yield at, distances(x[at:at + size], y)


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distances between boxes (or points, where low is high) and other boxes."""
    out = np.zeros((len(low), len(lows)))
    for j in range(low.shape[1]):
        d = np.maximum(np.maximum(lows[None, :, j] - high[:, j:j + 1], low[:, j:j + 1] - highs[None, :, j]), 0.0)
        out += d * d
    return np.sqrt(out)


@dataclass(frozen=True)
class Boxes:
    """The cells of a k-d tree: the children of node i are 2 i + 1 (up to the cut) and 2 i + 2."""
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray      # of the points that each cell holds; an empty one's is inf, so that nothing is near
    high: np.ndarray

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(x), int), np.arange(len(x))
        for _ in range((len(self.cut) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.axis[node]] > self.cut[node])
        return node - len(self.cut)


def _cuts(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the inner nodes of a tree: at the median of the coordinate of the largest deviation."""
    axis, cut = np.zeros(2 ** levels - 1, int), np.full(2 ** levels - 1, np.inf)
    held = {0: sample}
    for i in range(len(cut)):
        x = held.pop(i)
        spread = x.std(axis=0) if len(x) else np.zeros(sample.shape[1])
        if spread.max() > 0:
            axis[i] = spread.argmax()
            v = np.sort(x[:, axis[i]])
            cut[i] = min(v[(len(v) - 1) // 2], v[v < v[-1]].max())  # the right part has a point at least
        right = x[:, axis[i]] > cut[i]
        held[2 * i + 1], held[2 * i + 2] = x[~right], x[right]
    return axis, cut


def boxes(points: DataFrame, most: int = BOXES, each: int = BOX_POINTS) -> tuple[DataFrame, Boxes | None]:
    """Points with their cell (id, v, m, cell), and the cells: about ``each`` points have one, ``most`` cells there are at most.

    The cuts come from a sample of BOX_SAMPLE points a cell, by their hashes; the boxes are those of all points."""
    n = points.count()
    if n == 0:
        return points.withColumn("cell", F.lit(0)), None
    levels = min(most.bit_length() - 1, (-(-n // each) - 1).bit_length())
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(min(1.0, BOX_SAMPLE * 2 ** levels / n) * (1 << 30)))
    dims = len(points.select("v").first()["v"])
    axis, cut = _cuts(np.array([r["v"] for r in (points.where(part) if levels else points.limit(0)).select("v").collect()]).reshape(-1, dims), levels)
    tree = Boxes(axis, cut, np.empty((0, dims)), np.empty((0, dims)))

    def run(batches):
        for b in batches:
            cell = tree.cell(_vectors(b.column(1))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["id", "v", "m", "cell"])

    laid = points.select("id", "v", "m").mapInArrow(run, "id long, v array<double>, m long, cell int").checkpoint()
    low, high = np.full((2 ** levels, dims), np.inf), np.full((2 ** levels, dims), np.inf)
    for r in laid.groupBy("cell").agg(*[f(F.get("v", F.lit(j))) for f in (F.min, F.max) for j in range(dims)]).collect():
        low[r[0]], high[r[0]] = r[1:1 + dims], r[1 + dims:]
    return laid, Boxes(axis, cut, low, high)


def _leaves(x: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The numbers of the rows of x, cut at medians of the widest coordinate until a part has at most ``size``."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def _pairs(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the pairs within the reach of the row of x.

    A product of matrices leaves out most of the others; what it keeps is measured coordinate by coordinate."""
    mid = x.mean(axis=0)
    a, b = x - mid, y - mid
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    near = (reach * (1 + SLACK)) ** 2 + 1e-11 * (aa + bb.max(initial=0.0))
    held = np.flatnonzero(np.c_[-2 * a, np.ones(len(a))] @ np.c_[b, bb].T <= (near - aa)[:, None])
    i, j = np.divmod(held, max(1, len(y)))
    d = np.zeros(len(i))
    for c in range(x.shape[1]):
        one = x[i, c] - y[j, c]
        d += one * one
    d = np.sqrt(d)
    kept = d <= reach[i]
    return i[kept], j[kept], d[kept]


def _k_least(n: int, k: int, i: np.ndarray, d: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """n rows of the k least distances d of each i, as often as they have copies; inf where there are fewer."""
    order = np.lexsort((d, i))
    times = np.minimum(copies[order], k)
    i, d = np.repeat(i[order], times), np.repeat(d[order], times)
    place = np.arange(len(i)) - np.searchsorted(i, i)
    out = np.full((n, k), np.inf)
    out[i[place < k], place[place < k]] = d[place < k]
    return out


def nearest_of(a: pa.Table, b: pa.Table, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(distances of the k nearest points of b, copies counted and itself not, within the reach; groups of visits; reach
    or the k-th distance) of the visits a."""
    x, y = _vectors(a["v"]), _vectors(b["v"])
    ids, own, m, reach = a["id"].to_numpy(), b["id"].to_numpy(), b["m"].to_numpy(), a["reach"].to_numpy().copy()
    leaves, groups, out = _leaves(y), _leaves(x), np.full((len(x), k), np.inf)
    order, edges = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])  # a leaf's points side by side
    y, own, m = y[order], own[order], m[order]
    low, high = (f.reduceat(y, edges[:-1], axis=0) for f in (np.minimum, np.maximum))

    def found(rows, some):
        other = np.concatenate([np.arange(edges[s], edges[s + 1]) for s in some] or [np.empty(0, int)])
        i, j, d = _pairs(x[rows], y[other], reach[rows])
        return _k_least(len(rows), k, i, d, m[other[j]] - (own[other[j]] == ids[rows[i]]))

    for rows in groups:
        q = x[rows]
        gap = gaps(q.min(axis=0)[None], q.max(axis=0)[None], low, high)[0]
        if np.isinf(reach[rows]).any():  # the nearest leaves give a first reach
            reach[rows] = np.minimum(reach[rows], found(rows, np.argsort(gap, kind="stable")[:1 + k // LEAF])[:, -1])
        some = np.flatnonzero(gap <= reach[rows].max() * (1 + SLACK))
        some = some[(gaps(q, q, low[some], high[some]) <= reach[rows][:, None] * (1 + SLACK)).any(axis=0)]
        out[rows] = found(rows, some)
        reach[rows] = np.minimum(reach[rows], out[rows, -1])
    return out, groups, reach


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values))


def _finite(near: np.ndarray) -> pa.ListArray:
    return _lists(np.isfinite(near).sum(axis=1), near[np.isfinite(near)])


def knn_distances(points: DataFrame, k: int, most: int = BOXES, tile: int = BOX_POINTS) -> DataFrame:
    """(id, v, m, knn): exact distance to the k-th nearest other point (copies count); null if there are fewer than k others.

    First each point meets its own box; the k-th distance found there is the reach with which it visits other boxes in the
    second round."""
    laid, cells = boxes(points, most, tile)
    if cells is None:
        return points.withColumn("knn", F.lit(None).cast("double"))

    def own_box(a, b):
        near, groups, reach = nearest_of(a, b, k)
        x, cell, go = _vectors(a["v"]), a["cell"].to_numpy(), [np.empty(0, np.int32)] * len(near)
        for rows in groups:
            q = x[rows]
            close = gaps(q.min(axis=0)[None], q.max(axis=0)[None], cells.low, cells.high)[0] <= reach[rows].max() * (1 + SLACK)
            some = np.flatnonzero(close & np.isfinite(cells.low[:, 0]))
            within = gaps(q, q, cells.low[some], cells.high[some]) <= reach[rows][:, None] * (1 + SLACK)
            within &= some != cell[rows][:, None]
            for r, w in zip(rows.tolist(), within):
                go[r] = some[w].astype(np.int32)
        return [a["id"], a["v"], pa.array(reach), _finite(near), _lists([len(g) for g in go], np.concatenate(go))]

    def other_box(a, b):
        return [a["id"], _finite(nearest_of(a, b, k)[0])]

    one = tiles(laid.select("id", "v", F.lit(float("inf")).alias("reach"), "cell"), laid, own_box,
                "id long, v array<double>, reach double, near array<double>, go array<int>", tile).checkpoint()
    ask = one
    if laid.groupBy("cell").count().agg(F.max("count")).first()[0] > tile:  # several tiles a box: the least reach is enough
        ask = one.groupBy("id").agg(F.min_by(F.struct("v", "reach", "go"), "reach").alias("at")).select("id", "at.*")
    two = tiles(ask.select("id", "v", "reach", F.explode("go").alias("cell")).checkpoint(), laid, other_box, "id long, near array<double>", tile)
    best = one.select("id", "near").unionByName(two).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    return points.join(_long(best), "id", "left").select("id", "v", "m", F.get("near", F.lit(k - 1)).alias("knn"))


def neighbour_counts(laid: DataFrame, cells: Voronoi, queries: DataFrame, eps: float, tile: int = TILE_POINTS) -> DataFrame:
    """(id, n_eps): points within eps of each query point, itself and copies counted; cells wholly inside aren't visited."""
    def count(a, b):
        m, n = b["m"].to_numpy(), []
        for _, d in _slices(a, b):
            n += ((d <= eps) @ m).tolist()
        return [a["id"], n]
    seen = visits(queries.select("id", "v", "cell"), cells, lambda b, d: np.full(len(d), eps), "whole").checkpoint()
    inside = seen.where(F.col("cell").isNull()).select("id", F.col("whole").alias("n"))
    met = tiles(seen.where(F.col("cell").isNotNull()).drop("whole"), laid, count, "id long, n long", tile)
    return inside.unionByName(met).groupBy("id").agg(F.sum("n").alias("n_eps"))


def eps_neighbours_nd(points: DataFrame, eps: float, most: int = PIVOTS, tile: int = TILE_POINTS) -> DataFrame:
    """(id, v, m, n_eps) for every point."""
    laid, cells = voronoi(points, 1, most)
    if cells is None:
        return points.withColumn("n_eps", F.lit(0).cast("long"))
    return points.join(_long(neighbour_counts(laid, cells, laid, eps, tile)), "id")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for all nodes with an edge: root is the least node of the component.

    In turn, every node hands its larger neighbours, and its smaller ones with itself, the least node it knows; edges
    are distinct and checkpointed, a node's edges are only ever summed up by grouped minima and joins."""
    cur = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        # a < b throughout; the least neighbour of each node
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        up = both.where("b > a").join(_long(least), "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        low = up.groupBy("b").agg(F.min("a").alias("low"))
        down = up.join(_long(low), "b").select(F.col("low").alias("a0"), "a", "b")
        cur = (down.select(F.col("a0").alias("a"), "b").unionAll(down.where("a <> a0").select(F.col("a0").alias("a"), F.col("a").alias("b")))
               .distinct().checkpoint())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = now
    raise RuntimeError(f"components unsettled after {max_rounds} rounds")


def _forest(pairs, parent: dict) -> list[tuple[int, int]]:
    """The pairs that join two trees of ``parent`` so far."""
    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    kept = []
    for a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            parent[q] = p
            kept.append((a, b))
    return kept


def dbscan_nd(points: DataFrame, eps: float, min_pts: int = 5, most: int = PIVOTS, tile: int = TILE_POINTS) -> DataFrame:
    """(id, v, m, cluster, is_core): DBSCAN in the points' dimensions; a cluster is named by its least core point (vectors
    in order of their coordinates), noise has null.

    core: at least min_pts points within eps, itself and copies counted.  A border point joins the least-named cluster
    among its core neighbours.  The nodes of the union are grid cells of side eps / sqrt(dimensions): any two points
    of one are neighbours, so a cell with min_pts points is core without a count and a cell's core points are one node.  Two
    cells are joined by one witness; a tile returns a forest over its grid cells."""
    laid, cells = voronoi(points, 1, most)
    if cells is None:
        return points.select("id", "v", "m", F.lit(None).cast("array<double>").alias("cluster"), F.lit(False).alias("is_core"))
    side = eps / cells.pivots.shape[1] ** 0.5 * (1 - SLACK)
    boxed = laid.withColumn("box", F.transform("v", lambda x: F.floor(x / F.lit(side))))
    boxes = (boxed.groupBy("box").agg(F.sum("m").alias("n"))
             .select("box", (F.col("n") >= min_pts).alias("dense"), F.monotonically_increasing_id().alias("node")).checkpoint())
    placed = boxed.join(_long(boxes), "box").drop("box").checkpoint()
    counted = neighbour_counts(laid, cells, placed.where("not dense"), eps, tile)
    core = (placed.join(_long(counted), "id", "left").where(F.col("dense") | (F.col("n_eps") >= min_pts))
            .select("id", "v", "m", "cell", "node").checkpoint())

    def witnesses(a, b):
        na, ia = np.unique(a["node"].to_numpy(), return_inverse=True)
        nb, ib = np.unique(b["node"].to_numpy(), return_inverse=True)
        parent, kept = {}, []
        for at, d in _slices(a, b):
            q, s = np.nonzero(d <= eps)
            code = np.unique(ia[at + q] * len(nb) + ib[s])
            kept += _forest(((x, y) for x, y in zip(na[code // len(nb)].tolist(), nb[code % len(nb)].tolist()) if x != y), parent)
        return [[x for x, _ in kept], [y for _, y in kept]]

    radius = lambda b, d: np.full(len(d), eps)
    near = visits(core.select("id", "v", "cell"), cells, radius, "later").drop("whole")
    edges = tiles(near.join(_long(core.select("id", "node")), "id").checkpoint(), core, witnesses, "a long, b long", tile)
    root = components(edges)
    rooted = core.join(_long(root), core["node"] == root["node"], "left").select("id", "v", "m", "cell", F.coalesce("root", core["node"]).alias("root")).checkpoint()
    named = rooted.groupBy("root").agg(F.min("v").alias("cluster"))

    def roots_near(a, b):
        root_, ids, found = b["root"].to_numpy(), a["id"].to_numpy(), set()
        for at, d in _slices(a, b):
            q, s = np.nonzero(d <= eps)
            found.update(zip(ids[at + q].tolist(), root_[s].tolist()))
        return [[x for x, _ in found], [y for _, y in found]]

    edge = placed.join(_long(core.select("id")), "id", "left_anti").select("id", "v", "cell")
    border = tiles(visits(edge, cells, radius).drop("whole").checkpoint(), rooted, roots_near, "id long, root long", tile)
    settled = (rooted.select("id", "root", F.lit(True).alias("is_core"))
               .unionByName(border.select("id", "root", F.lit(False).alias("is_core"))))
    best = settled.join(_long(named), "root").groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("is_core").alias("is_core"))
    return points.join(_long(best), "id", "left").select("id", "v", "m", "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
