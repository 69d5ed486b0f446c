"""LOESS, regressions by entity, the network and the hash sample."""

import math

import numpy as np

import __spark_entry__ as E
from conftest import SF_SMALL
from tripflow.operators import aggregate as A
from tripflow.operators import forecast as FC
from tripflow.operators import loess as LO


def direct(x, y, x0, span):
    d = np.abs(x - x0)
    reach = np.sort(d)[math.ceil(len(x) * span) - 1]
    w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0.0) if reach > 0 else (d == 0).astype(float)
    a = np.c_[np.ones(len(x)), x - x0]
    row = np.linalg.pinv(a.T @ (w[:, None] * a))[0] @ (a * w[:, None]).T
    beta = np.linalg.pinv(a.T @ (w[:, None] * a)) @ a.T @ (w * y)
    sigma = (w * (y - a @ beta) ** 2).sum() / w.sum()
    return reach, row @ y, math.sqrt(sigma * (row @ row))


def test_loess_equals_a_direct_fit(spark):
    r = np.random.default_rng(3)
    x = np.round(r.uniform(-5, 20, 500), 1)
    y = np.sin(x / 4) * 5 + r.normal(0, 1, 500)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    for span in (0.75, 0.2):
        got = LO.loess(df, "x", "y", 15, span).orderBy("place").collect()
        assert len(got) == 15
        for t in got:
            reach, fit, se = direct(x, y, t.x, span)
            assert math.isclose(t.reach, reach, abs_tol=1e-9) and math.isclose(t.fit, fit, rel_tol=1e-7, abs_tol=1e-8) and math.isclose(t.se, se, rel_tol=1e-6)


def test_loess_of_equal_and_of_no_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert [(t.place, t.x, t.fit) for t in LO.loess(df, "x", "y").collect()] == [(0, 1.0, 3.0)]
    assert LO.loess(df.limit(0), "x", "y").count() == 0


def test_regressions_of_24_lags_by_entity(spark):
    r, rows = np.random.default_rng(1), []
    for e, n in (("a", 400), ("b", 90), ("c", 30), (None, 60)):
        y = r.normal(0, 1, n)
        for k in range(3, n):
            y[k] += 0.6 * y[k - 1] - 0.3 * y[k - 3]
        rows += [(e, k, float(y[k])) for k in range(n)]
    rows += [("flat", k, 5.0) for k in range(40)]
    df = spark.createDataFrame(rows, "e string, t int, y double").repartition(6)
    laid = FC.entity_lags(df, "e", "t", "y", 24)
    beta = {t.e: t.beta for t in FC.entity_regressions(laid.where("split = 'train'"), "e").collect()}
    frame = laid.toPandas()
    assert set(beta) == {"a", "b", "c", None, "flat"}
    for e in ("a", "b"):
        own = frame[(frame.e == e) & (frame.split == "train")]
        z = np.c_[np.ones(len(own)), np.array(own.x.tolist())]
        want, *_ = np.linalg.lstsq(z, own.y.to_numpy(), rcond=None)
        assert np.allclose(beta[e], want, atol=1e-7) and len(own) == math.floor(0.8 * ((frame.e == e).sum()))
    assert math.isclose(beta["flat"][0] + 5 * sum(beta["flat"][1:]), 5.0)
    told = FC.entity_forecast(laid, "e", "t").where("e = 'flat'").collect()
    assert told and all(math.isclose(t.predicted, 5.0) for t in told)


def test_network_learns_what_a_line_cannot(spark):
    r = np.random.default_rng(4)
    x = r.uniform(-2, 2, (1500, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + r.normal(0, 0.05, 1500)
    rows = [(a.tolist(), float(b), k % 10 == 9) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, y double, held boolean")
    net = FC.fit_network(df.repartition(4).cache(), 3, hidden=12, rounds=30)
    again = FC.fit_network(df.repartition(4).cache(), 3, hidden=12, rounds=30)
    assert np.allclose(net.weights, again.weights, rtol=1e-6, atol=1e-8)
    test = r.uniform(-2, 2, (500, 3))
    want = np.sin(2 * test[:, 0]) + test[:, 1] * test[:, 2]
    line = np.linalg.lstsq(np.c_[np.ones(1500), x], y, rcond=None)[0]
    assert ((net(test) - want) ** 2).mean() < 0.1 * ((np.c_[np.ones(500), test] @ line - want) ** 2).mean()


def test_network_jacobian_is_the_derivative():
    r = np.random.default_rng(0)
    net, x = FC.Network.start(3, 4, 1), r.normal(0, 1, (5, 3))
    f, j = net.jacobian(x)
    for k in range(len(net.weights)):
        w = net.weights.copy()
        w[k] += 1e-6
        assert np.allclose((FC.Network(3, 4, w)(x) - f) / 1e-6, j[:, k], atol=1e-4)


def test_forecasts_on_the_smallest_data_beat_the_naive_one(spark):
    q = E.queries()
    naive = {t.Metric: t.Value for t in q["ts_metrics"](spark, SF_SMALL).collect()}
    net = {t.Metric: t.Value for t in q["ts_metrics_nn"](spark, SF_SMALL).collect()}
    # Least squares: the mean square falls.  The mean absolute error does not on these data, whose sparse series repeats its
    # last value over long gaps, where the naive forecast has no error at all.
    assert net["MSE"] < naive["MSE"]
    for key in ("ts_forecast_lr", "ts_forecast_gbt"):
        rows = q[key](spark, SF_SMALL).toPandas()
        assert ((rows.actual - rows.predicted) ** 2).mean() < naive["MSE"]


def test_linear_forecast_equals_numpy(spark):
    seq = E.queries()["ts_sequences"](spark, SF_SMALL).toPandas().sort_values("seq_id")
    z = np.c_[np.ones(len(seq)), seq[[c for c in seq if c.startswith("lag_")]].to_numpy()]
    told = E.queries()["ts_forecast_lr"](spark, SF_SMALL).toPandas().sort_values("seq_id")
    train = ~seq.seq_id.isin(told.seq_id).to_numpy()
    beta = np.linalg.lstsq(z[train], seq.y.to_numpy()[train], rcond=None)[0]
    span = (told.actual.max() - told.actual.min()) / (seq.y[~train].max() - seq.y[~train].min())
    assert np.allclose((told.predicted - told.actual).to_numpy() / span, (z[~train] @ beta) - seq.y.to_numpy()[~train], atol=2e-4)


def test_hash_sample_keeps_its_rows(spark):
    df = spark.createDataFrame([(f"k{i % 900}",) for i in range(1800)] + [(None,)], "k string")
    got = sorted(r.k or "" for r in A.hash_sample(df, "k", 0.25).collect())
    assert got == sorted(r.k or "" for r in A.hash_sample(df.repartition(5), "k", 0.25).collect())
    assert 300 < len(got) < 600 and all(got.count(k) == (2 if k else 1) for k in got) and A.hash_sample(df, "k", 1.0).count() == 1801
