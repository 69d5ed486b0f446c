"""Neighbour operators in p dimensions, exact silhouette and many-model K-Means against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripflow.operators import cluster as CL
from tripflow.operators import manymeans as MM
from tripflow.operators import metric as MT
from tripflow.operators import silhouette as SI


def frame(spark, x):
    cols = [f"c{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3), cols


def sample(p, seed, n=300):
    """Two clouds, a dense lump with a third of all points, scattered points, copies."""
    r = np.random.default_rng(seed)
    x = np.r_[r.normal(0, 1, (n // 3, p)), r.normal(6, 0.6, (n // 6, p)), r.normal(3, 0.02, (n // 3, p)), r.uniform(-8, 12, (n // 10, p))]
    return np.round(np.r_[x, x[:20], np.repeat(x[5:6], 9, axis=0)], 3)


def by_vector(rows, *cols):
    return {tuple(r["v"]): tuple(r[c] for c in cols) for r in rows}


def brute(x):
    count = Counter(map(tuple, x.tolist()))
    v = np.array(sorted(count))
    return v, np.array([count[tuple(t)] for t in v.tolist()]), MT.distances(v, v)


SIZES = [(MT.PIVOTS, MT.TILE_POINTS), (4, 40)]


@pytest.mark.parametrize("p", [2, 7])
@pytest.mark.parametrize("pivots, tile", SIZES)
def test_knn_distances(spark, p, pivots, tile):
    x = sample(p, p)
    df, cols = frame(spark, x)
    got = by_vector(MT.knn_distances(MT.points_nd(df, cols), 5, pivots, tile).collect(), "m", "knn")
    v, m, d = brute(x)
    for i, t in enumerate(v.tolist()):
        copies = m.copy()
        copies[i] -= 1
        want = np.sort(np.repeat(d[i], copies))[4]
        assert got[tuple(t)][0] == m[i] and math.isclose(got[tuple(t)][1], want, abs_tol=1e-12)
    assert len(got) == len(v)


@pytest.mark.parametrize("p, eps", [(2, 0.5), (7, 2.0)])
@pytest.mark.parametrize("pivots, tile", SIZES)
def test_counts_and_dbscan(spark, p, eps, pivots, tile):
    x = sample(p, 10 + p)
    df, cols = frame(spark, x)
    points = MT.points_nd(df, cols)
    v, m, d = brute(x)
    close = d <= eps
    n_eps = close @ m
    counted = by_vector(MT.eps_neighbours_nd(points, eps, pivots, tile).collect(), "n_eps")
    assert counted == {tuple(t): (int(n_eps[i]),) for i, t in enumerate(v.tolist())}
    core = n_eps >= 5
    label = np.where(core, np.arange(len(v)), -1)  # vectors are sorted, so the least number is the least vector
    while True:
        new = np.array([label[np.flatnonzero(close[i] & core)].min() if core[i] else -1 for i in range(len(v))])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(close[i] & core)
        label[i] = label[near].min() if len(near) else -1
    got = by_vector(MT.dbscan_nd(points, eps, 5, pivots, tile).collect(), "cluster", "is_core")
    assert got == {tuple(t): (None if label[i] < 0 else v[label[i]].tolist(), bool(core[i])) for i, t in enumerate(v.tolist())}
    assert len({t[0] and tuple(t[0]) for t in got.values()}) > 3 and 0 < core.sum() < len(v)


def test_dbscan_equals_the_operator_for_planes(spark):
    x = np.round(np.random.default_rng(4).normal(0, 2, (120, 2)), 1)
    df, cols = frame(spark, x)
    old = {(r.x, r.y): (None if r.cluster_x is None else [r.cluster_x, r.cluster_y], r.is_core) for r in CL.dbscan(CL.points(df, *cols), 0.4).collect()}
    assert by_vector(MT.dbscan_nd(MT.points_nd(df, cols), 0.4, most=10, tile=20).collect(), "cluster", "is_core") == old


def test_a_dense_cell_gives_no_pairs(spark):
    """A lump with a third of all points: the tiles of the union return a forest of grid cells."""
    r = np.random.default_rng(1)
    x = np.r_[r.normal(0, 0.01, (1000, 3)), r.uniform(-20, 20, (500, 3))]
    df, cols = frame(spark, x)
    points = MT.points_nd(df, cols)
    laid, cells = MT.voronoi(points)
    own = MT.visits(laid.select("id", "v", "cell"), cells, lambda b, d: np.full(len(d), 0.5), "whole")
    assert own.count() < 60 * 1500  # visits, of 1500 * 1500 pairs
    found = MT.dbscan_nd(points, 0.5).groupBy("cluster").count().orderBy(F.desc("count")).collect()
    assert max(r["count"] for r in found if r["cluster"]) >= 1000


def test_odd_points(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 1.0), (float("inf"), 0.0)], "a double, b double")
    none = MT.points_nd(df, ["a", "b"])
    assert none.count() == 0 and MT.knn_distances(none, 2).count() == 0 and MT.dbscan_nd(none, 1.0).count() == 0
    assert MT.eps_neighbours_nd(none, 1.0).count() == 0
    same = MT.points_nd(spark.createDataFrame([(0.0, 1.0), (-0.0, 1.0), (0.0, 1.0)], "a double, b double"), ["a", "b"])
    assert [(r.m, r.knn) for r in MT.knn_distances(same, 2).collect()] == [(3, 0.0)]
    assert [(r.m, r.knn) for r in MT.knn_distances(same, 3).collect()] == [(3, None)]
    assert [(r.cluster, r.is_core) for r in MT.dbscan_nd(same, 1.0, 4).collect()] == [(None, False)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 90)] + [(200, 150 + k) for k in range(30)] + [(300, 300)]
    got = dict(map(tuple, MT.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(91)} | {k: 150 for k in [*range(150, 180), 200]}


def test_silhouette_against_all_pairs(spark):
    r = np.random.default_rng(3)
    x, c = r.normal(0, 1, (400, 3)), r.integers(0, 4, 400)
    c[0] = 9  # alone in its cluster
    rows = [(i, int(c[i]), *map(float, x[i])) for i in range(400)] + [(999, None, 0.0, 0.0, 0.0), (998, 1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, k int, a double, b double, c double").repartition(3)
    got = {t.id: t for t in SI.silhouette_exact(df, "id", "k", ["a", "b", "c"], F.col("id") % 5 == 0, block=20).collect()}
    d = MT.distances(x, x)
    assert set(got) == set(range(0, 400, 5))
    for i in got:
        own = (c == c[i]).sum()
        a = d[i][c == c[i]].sum() / max(1, own - 1)
        b = min(d[i][c == k].mean() for k in set(c.tolist()) - {c[i]})
        assert math.isclose(got[i].silhouette, 0.0 if own == 1 else (b - a) / max(a, b), abs_tol=1e-12)
    assert SI.silhouette_exact(df.limit(0), "id", "k", ["a"], F.lit(True)).count() == 0
    assert SI.silhouette_exact(df, "id", "k", ["a"], F.lit(False)).count() == 0


def test_silhouette_of_all_rows(spark):
    """Every row is asked, copies of a row and a place of several clusters too, over many tiles."""
    r = np.random.default_rng(5)
    x, c = r.integers(0, 9, (600, 2)).astype(float), r.integers(0, 3, 600)
    df = spark.createDataFrame([(str(i), int(c[i]), *map(float, x[i])) for i in range(600)] + [(None, 0, 1.0, 1.0)], "id string, k int, a double, b double")
    x, c = np.r_[x, [[1.0, 1.0]]], np.r_[c, 0]
    d = MT.distances(x, x)
    got = {t.id: t for t in SI.silhouette_exact(df.repartition(3), "id", "k", ["a", "b"], block=7).collect()}
    assert len(got) == 601 and None in got
    for i, own in enumerate(c):
        a, b = d[i][c == own].sum() / ((c == own).sum() - 1), min(d[i][c == k].mean() for k in {0, 1, 2} - {own})
        t = got[str(i) if i < 600 else None]
        assert t.k == own and math.isclose(t.a, a) and math.isclose(t.b, b) and math.isclose(t.silhouette, (b - a) / max(a, b), abs_tol=1e-12)


# --- K-Means


def test_one_round_for_all_models_equals_plain_lloyd(spark):
    x = sample(3, 5)
    df, cols = frame(spark, x)
    points = MM.vectors(df, cols).cache()
    models = MM.starts_of(MM.pool_of(points), [1, 2, 4, 7], 3)
    first = [m.centres.copy() for m in models]
    assert [m.k for m in models] == [1, 2, 2, 2, 4, 4, 4, 7, 7, 7]
    MM.lloyd(points, models)
    for m, centres in zip(models, first):
        wss = math.inf
        while True:
            d = MT.distances(x, centres) ** 2
            own = d.argmin(axis=1)
            now = d.min(axis=1).sum()
            if wss - now <= 1e-9 * now:
                break
            wss, centres = now, np.array([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(m.k)])
        assert math.isclose(m.wss, now, rel_tol=1e-8) and np.allclose(m.centres, centres, atol=1e-6)
    points.unpersist()


@pytest.mark.parametrize("data", [False, True])
def test_first_moves_over_all_points_are_lloyds(spark, data):
    r = np.random.default_rng(11)
    x = np.round(r.normal(size=(900, 2)), 1)  # copies count
    points = spark.createDataFrame([(v.tolist(), i % 2) for i, v in enumerate(x)], "v array<double>, data int").repartition(3)
    points = points if data else points.select("v")
    made = [MM.starts_of(np.unique(x, axis=0), [1, 3, 6], 4) for _ in range(2)]
    for models in made if data else []:
        for i, m in enumerate(models):
            m.data = i % 2
    MM.lloyd(points, made[0], tolerance=1e-6)
    assert MM.first_moves(points, made[1], 1e-6)
    for a, b in zip(*made):
        assert math.isclose(a.wss, b.wss, rel_tol=1e-9) and np.allclose(a.centres, b.centres) and a.counts.tolist() == b.counts.tolist()


def test_starts_over_a_part_settle_over_all_points(spark):
    """Starts that meet go on as one; what they end in is at rest over all points, in fewer rounds of theirs."""
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(c, 1.5, (500, 3)) for c in np.eye(3) * 6])
    points = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5).cache()
    starts = lambda: MM.starts_of(x, [1, 3, 5], 8)
    rounds, plain = [], MM._round

    def counted(*a):
        rounds.append(len(a[1]))
        return plain(*a)
    MM._round = counted
    try:
        models, held = MM.settle(points, starts(), 1e-6, part=200)
        few = sum(rounds)
        rounds.clear()
        MM.lloyd(points, alone := starts(), tolerance=1e-6)
    finally:
        MM._round = plain
    assert held is not None and few < sum(rounds) and len([m for m in models if m.k == 3]) < 8
    for m in models:
        d = MT.distances(x, m.centres) ** 2
        own = d.argmin(axis=1)
        means = np.array([x[own == k].mean(axis=0) for k in range(m.k)])
        gain = d.min(axis=1).sum() - (MT.distances(x, means) ** 2).min(axis=1).sum()
        assert math.isclose(m.wss, d.min(axis=1).sum(), rel_tol=1e-9) and abs(gain) <= 2e-6 * m.wss
    assert min(m.wss for m in models if m.k == 3) <= min(m.wss for m in alone if m.k == 3) * (1 + 1e-5)
    assert not MM.first_moves(points, starts(), 1e-6, part=200)
    again = MM.packed(points)
    for a, b in zip(MM._round(points, models, False), MM._round(again, models, False)):
        assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and math.isclose(a[2], b[2])
    two = MM.best_models(points, [1, 2, 3], part=200)
    assert sorted(two) == [1, 2, 3] and sorted(two[3].counts.tolist()) == sorted(MM.best_models(points, [3])[3].counts.tolist())


def test_hartigan_goes_below_lloyd(spark):
    # Lloyd rests with the three lower points together: 1.85 is nearer to their mean, yet leaving it pays.
    x = np.array([[-0.6], [0.6], [1.85], [3.1]])
    df, cols = frame(spark, x)
    points = MM.vectors(df, cols)
    m = MM.Model(2, np.array([[0.6166], [3.1]]))
    MM.lloyd(points, [m])
    before = m.wss
    MM.hartigan(points, [m])
    assert m.wss < before and sorted(m.counts.tolist()) == [2, 2]


def test_best_of_25_starts_and_partitioning(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (9, 9), (12, 0))])
    df, cols = frame(spark, x)
    best = MM.best_models(MM.vectors(df, cols).cache(), range(1, 8))
    again = MM.best_models(MM.vectors(df.repartition(7), cols).cache(), range(1, 8))
    assert sorted(best) == list(range(1, 8)) and all(best[k].wss >= best[k + 1].wss for k in range(1, 7))
    assert all(math.isclose(best[k].wss, again[k].wss, rel_tol=1e-9) for k in best)
    assert sorted(best[6].counts.tolist()) == [40.0] * 6
    v = MM.vectors(df, cols)
    sizes = v.select(MM.nearest_centre(F.col("v"), best[6].centres).alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in sizes) == [40] * 6


def test_gap_statistic_finds_six_clouds(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (9, 9), (12, 0))])
    df, cols = frame(spark, x)
    points = MM.vectors(df, cols).cache()
    gaps = MM.gap_statistic(points, MM.best_models(points, range(5, 8)), sets=3, starts=5)
    first = next(k for (k, g, _), (_, g2, s2) in zip(gaps, gaps[1:]) if g >= g2 - s2)
    assert first == 6


def test_means_of_few_points(spark):
    df, cols = frame(spark, np.array([[1.0, 2.0], [1.0, 2.0], [4.0, 6.0]]))
    best = MM.best_models(MM.vectors(df, cols), [1, 2, 3])
    assert sorted(best) == [1, 2] and best[2].wss == 0 and math.isclose(best[1].wss, 25 * 2 / 3)
    assert MM.best_models(MM.vectors(df.limit(0), cols), [1, 2]) == {}


def test_points_are_never_broadcast(spark):
    """Joins of points with points are sort-merge joins, however small the planner takes a column of ids to be."""
    df, cols = frame(spark, sample(3, 2, 60))
    points = MT.points_nd(df, cols)
    for out in (MT.knn_distances(points, 5), MT.eps_neighbours_nd(points, 0.5), MT.dbscan_nd(points, 0.5)):
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [id" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_points_meet_few_others(spark, monkeypatch):
    """Ten times the points: a visit meets three times as many at most, as boxes and leaves are of bounded size."""
    met = []
    pairs = MT._pairs
    monkeypatch.setattr(MT, "_pairs", lambda x, y, reach: met.append(len(x) * len(y)) or pairs(x, y, reach))
    each = []
    for n in (2000, 20000):
        x = np.random.default_rng(n).normal(0, 1, (n, 3))
        v = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), pa.array(x.ravel()))
        t = pa.table({"id": np.arange(n), "v": v, "m": np.ones(n, int), "reach": np.full(n, np.inf)})
        met.clear()
        near = MT.nearest_of(t, t, 5)[0]
        each.append(sum(met) / n)
        for i in range(0, n, n // 20):
            assert np.allclose(near[i], np.sort(MT.distances(x[i:i + 1], x)[0])[1:6], rtol=0, atol=1e-12)
    assert each[1] < 3 * each[0] < 20000
    df, cols = frame(spark, np.round(x[:3000], 2))
    laid, cells = MT.boxes(MT.points_nd(df, cols), each=200)
    sizes = [r["count"] for r in laid.groupBy("cell").count().collect()]
    assert len(cells.low) == 16 and max(sizes) < 800


def test_nearest_points_of_ties_and_one_long_axis(spark):
    """Whole numbers along one axis, a constant beside it: cuts at equal coordinates, boxes without extent."""
    x = np.c_[np.repeat(np.arange(120.0), 2), np.zeros(240)]
    df, cols = frame(spark, x)
    got = by_vector(MT.knn_distances(MT.points_nd(df, cols), 3, 64, 3).collect(), "m", "knn")
    assert got == {(float(i), 0.0): (2, 1.0) for i in range(120)}
