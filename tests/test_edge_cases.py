"""Inputs on which results must neither vanish nor abort: wide ranges, constant columns, missing classes, far points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.functions.stats import exact_quantiles, r_round
from tripflow.operators import aggregate as A
from tripflow.operators import cluster as CL
from tripflow.operators import evaluation as EV
from tripflow.operators import features as FE
from tripflow.operators import graph as G
from tripflow.operators import ml as M
from tripflow.operators import quality as Q
from tripflow.operators import windows as W


def test_quantiles_over_many_decades(spark):
    values = [10.0 ** e for e in range(-300, 301, 3)] + [0.0, -1e300, math.inf, None, math.nan]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], [0.0, 0.5, 1.0])["v"]
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    middle = (kept[len(kept) // 2 - 1] + kept[len(kept) // 2]) / 2
    assert len(kept) % 2 == 0 and got == [kept[0], pytest.approx(middle), math.inf]


def test_rounding_of_large_values(spark):
    row = spark.createDataFrame([(1e18, -2.5e15, 10.075, math.nan)], "a double, b double, c double, d double").select(
        *[r_round(F.col(c), 2).alias(c) for c in "abcd"]).first()
    assert row[:3] == (1e18, -2.5e15, 10.07) and math.isnan(row["d"])


def test_one_class_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 0.2, 5.0, 1.0), (1, 0.9, 5.0, 2.0)], "y int, s double, c double, v double")
    assert EV.auc(df, "y", "s").first()["AUC"] is None
    assert [r["fpr"] for r in EV.roc_points(df, "y", "s").collect()] == [None, None]
    r = {(x["var1"], x["var2"]): x["r"] for x in A.corr_long(df, ["c", "v"]).collect()}
    assert r["c", "v"] is None and r["v", "v"] == 1.0
    assert M.standardize(df.withColumn("k", F.col("s")), ["c", "v"], "k").where("c is not null").count() == 0


def test_no_wind_and_the_schema_s_own_labels(spark):
    df = spark.createDataFrame([("Bus", "Storm", "Concert", "Winter", 0.0, 0.0), ("Tram", "Clear", "None", "Autumn", 0.0, 1.0)],
                               "transport_type string, weather_condition string, event_type string, season string, "
                               "wind_speed_kmh double, precipitation_mm double")
    rows = FE.add_weather_scores(FE.add_label_encodings(df)).collect()
    assert [(r["transport_type_enc"], r["weather_condition_enc"], r["event_type_enc"], r["season_enc"]) for r in rows] == [
        (1, 6, 1, 1), (4, 1, 0, 4)]
    assert all(r["weather_severity_index"] is None for r in rows)


def points(spark, xy):
    return CL.points(spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double"), "x", "y")


@pytest.mark.parametrize("xy,k", [([(0, 0), (1, 0), (0, 1), (1, 1), (2, 2), (2, 1), (9e6, -3e6)], 5), ([(0, 0), (1, 1), (5, 5)], 5),
                                  ([(3, 3)] * 4, 2), ([(0, 0), (1e-9, 0), (1e9, 1e9)], 1)])
def test_knn_keeps_every_point(spark, xy, k):
    got = {(r["x"], r["y"]): r["knn"] for r in CL.knn_distance(points(spark, xy), k, 2.0).collect()}
    want = {}
    for i, a in enumerate(xy):
        d = sorted(math.dist(a, b) for j, b in enumerate(xy) if j != i)
        want[tuple(map(float, a))] = d[k - 1] if len(d) >= k else None
    assert got.keys() == want.keys()
    assert all(got[p] == want[p] or abs(got[p] - want[p]) < 1e-6 for p in want)


def test_smote_gives_a_row_for_every_minority_row(spark):
    rows = [(f"a{k}", float(1000 * k), float(k), 1) for k in range(6)] + [(f"b{k}", 0.0, 0.0, 0) for k in range(20)]
    df = spark.createDataFrame(rows, "trip_id string, x double, y double, delayed int")
    first, again = (sorted(map(tuple, M.smote_2d(d, "x", "y", "delayed").collect())) for d in (df, df.repartition(7)))
    assert first == again and [r[0] for r in first] == [f"a{k}" for k in range(6)]
    assert all(0 <= r[1] <= 5000 for r in first)
    assert M.smote_2d(df.where("trip_id in ('a1', 'b1', 'b2')"), "x", "y", "delayed").collect()[0][1] == 1000.0


def test_scaling_comes_from_the_training_rows(spark):
    train = spark.createDataFrame([("1", 0.0, 0.0), ("2", 1.0, 10.0)], "trip_id string, label double, a double")
    held = train.limit(1).selectExpr("'3' AS trip_id", "label", "500.0D AS a")
    weight = F.when(F.col("trip_id") == "3", 0.0).otherwise(1.0)
    mean, deviation = M._scale_of(train.unionByName(held), ["a"], weight)
    assert M.ML.scaled_map(mean, deviation)(np.array([[5.0]])).tolist() == [[0.0, 1.0]]


def test_medians_are_taken_before_dates_are_dropped(spark):
    cols = [c for c in Q.TRIP_COLUMNS if c not in ("date", *Q.MEDIAN_COLS)]
    rows = [dict.fromkeys(cols, "v") | {"date": d, "trip_id": t} | {c: v for c in Q.MEDIAN_COLS} | {"ingest_seq": n}
            for n, (t, d, v) in enumerate([("1", "2024-01-01", 1.0), ("2", None, 9.0), ("3", "2024-01-02", 5.0), ("4", None, 9.0)])]
    schema = ", ".join([f"{c} string" for c in ["date", *cols]] + [f"{c} double" for c in Q.MEDIAN_COLS] + ["ingest_seq long"])
    df = spark.createDataFrame([tuple(r[c] for c in ["date", *cols, *Q.MEDIAN_COLS, "ingest_seq"]) for r in rows], schema)
    result = Q.clean(df)
    assert result.medians["temperature_C"] == 7.0 and result.df.count() == 2


# Two equal ways from a to d, a way back, a vertex without ways out (e) and a pair apart from the rest.
EDGES = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0), ("d", "a", 5.0), ("d", "e", 0.5), ("x", "y", 2.0)]


def graph(spark, edges=EDGES):
    return spark.createDataFrame(edges, "s string, t string, w double")


def inner_shares():
    """Betweenness from a list of all simple paths of EDGES."""
    def simple(path, length):
        yield path, length
        for s, t, w in EDGES:
            if s == path[-1] and t not in path:
                yield from simple([*path, t], length + w)
    nodes = {n for s, t, _ in EDGES for n in (s, t)}
    shares = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        found = list(simple([s], 0.0))
        for t in nodes - {s}:
            ways = [(length, p) for p, length in found if p[-1] == t]
            shortest = [p for length, p in ways if length == min(ways)[0]]
            for p in shortest:
                for n in p[1:-1]:
                    shares[n] += 1 / len(shortest)
    return shares


def test_pagerank_with_dangling_vertices(spark):
    nodes = sorted({n for s, t, _ in EDGES for n in (s, t)})
    out = {n: sum(w for s, _, w in EDGES if s == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(rank[s] * w / out[s] for s, t, w in EDGES if t == n) for n in nodes}
    got = {r["node"]: r["pagerank"] for r in G.pagerank(graph(spark), "s", "t", "w").collect()}
    assert got == {n: pytest.approx(v, abs=1e-8) for n, v in rank.items()}
    with pytest.raises(RuntimeError):
        G.pagerank(graph(spark), "s", "t", "w", max_iter=10)


@pytest.mark.parametrize("block_rows", [28, 10 ** 6])
def test_paths_closeness_and_betweenness(spark, monkeypatch, block_rows):
    monkeypatch.setattr(G, "BLOCK_ROWS", block_rows)   # blocks of four sources, and one block
    e = graph(spark)
    paths = {(r["s"], r["t"]): r["d"] for r in G.shortest_paths(e, "s", "t", "w").collect()}
    assert paths["a", "d"] == 2.0 and paths["b", "e"] == 1.5 and paths["d", "c"] == 6.0 and ("e", "a") not in paths
    close = {r["node"]: r["closeness"] for r in G.closeness(e, "s", "t", "w").collect()}
    assert close["x"] == close["y"] == 0.5 and close["d"] == pytest.approx(4 / (1 + 1 + 2 + 0.5))
    between = {r["node"]: r["betweenness"] for r in G.betweenness(e, "s", "t", "w", normalized=False).collect()}
    assert between == {n: pytest.approx(v) for n, v in inner_shares().items()}
    assert G.betweenness(graph(spark, []), "s", "t", "w").count() == 0
    with pytest.raises(ValueError):
        G.betweenness(graph(spark, [("a", "b", 0.0)]), "s", "t", "w")


def test_first_rows_and_ties(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([5, 5, 4, 3, 3, None])], "k int, v int")
    assert [r["k"] for r in W.first_rows(df, [F.desc("v"), F.asc("k")], 3).collect()] == [0, 1, 2]
    tied = {r["k"]: r["rank"] for r in W.top_n_with_ties(df, "v", 4).collect()}
    assert tied == {0: 1, 1: 1, 2: 3, 3: 4, 4: 4}
    assert W.top_n_with_ties(df, "v", 9).count() == 5
