"""Many linear models in one job, random up-sampling in folds, kernel SVM, cross-validation."""

import math

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tripflow.operators import manylinear as ML
from tripflow.operators import ml as M


def rows_of(spark, x, y, w):
    return spark.createDataFrame([(list(map(float, a)), float(b), list(map(float, c)), str(i)) for i, (a, b, c) in enumerate(zip(x, y, w))],
                                 "x array<double>, y double, w array<double>, key string").repartition(3)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    for v in np.unique(s):
        same = s == v
        ranks[same] = (s < v).sum() + (same.sum() + 1) / 2
    p = y == 1
    return (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()), order


def test_models_fitted_together_are_the_minima_of_their_losses(spark):
    r = np.random.default_rng(0)
    x, w = r.normal(2, 3, (300, 4)), r.integers(0, 4, (300, 2)).astype(float)
    x[:, 3] = 7.0  # constant
    y = (x[:, 0] - x[:, 1] + r.normal(0, 2, 300) > 0).astype(float)
    base = ML.scaled_map(x.mean(axis=0), x.std(axis=0))
    kernel = ML.nystroem(base, x[:80], landmarks=12)
    specs = [ML.Spec("lr", "", 0, "logistic"), ML.Spec("lr", "", 1, "logistic"), ML.Spec("svm", "1", 0, "svm", 1.0, 1), ML.Spec("svm", "4", 1, "svm", 4.0, 1)]
    betas = ML.fit(rows_of(spark, x, y, w), specs, [base, kernel])
    assert kernel.dims == 13 and base.dims == 5
    for s, b in zip(specs, betas):
        f, t = [base, kernel][s.map](x), 2 * y - 1
        ridge = np.r_[np.full(len(b) - 1, 1.0 if s.kind == "svm" else 1e-6), 0.0]

        def loss(v):
            m = t * (f @ v)
            each = s.cost * np.maximum(1 - m, 0) ** 2 if s.kind == "svm" else np.logaddexp(0, -m)
            return (w[:, s.fold] * each).sum() + (ridge * v * v).sum() / 2
        here = loss(b)
        for _ in range(60):
            assert loss(b + r.normal(0, 1e-3, len(b))) >= here - 1e-9 * abs(here)


def test_an_svm_of_landmarks_separates_rings(spark):
    """The held-out AUC on two rings is nearly 1; forty random cosine features of fixed width, as before, stay below."""
    r = np.random.default_rng(2)
    n = 900
    y, angle = r.integers(0, 2, n), r.uniform(0, 2 * math.pi, n)
    radius = 4 + 2.5 * y + r.normal(0, 0.35, n)
    x = np.c_[radius * np.cos(angle), radius * np.sin(angle), r.normal(0, 1, (n, 4))]
    w = np.where(np.arange(n)[:, None] < 600, 1.0, 0.0)
    rows = rows_of(spark, x, y, w)
    base = ML.scaled_map(x[:600].mean(axis=0), x[:600].std(axis=0))
    specs, maps = [ML.Spec("svm", "C=1.0", 0, "svm", 1.0, 0)], [ML.nystroem(base, x[:600])]
    got = ML.scores(rows, specs, maps, ML.fit(rows, specs, maps)).toPandas()
    mine = auc(got.y.to_numpy(), got.score.to_numpy())[0]
    z = (x - x[:600].mean(axis=0)) / x[:600].std(axis=0)
    cosines = np.cos(z @ r.normal(0, math.sqrt(0.1), (6, 40)) + r.uniform(0, 2 * math.pi, 40)) * math.sqrt(2 / 40)
    flat = [ML.Spec("svm", "", 0, "svm", 1.0, 0)], [ML.scaled_map(np.zeros(40), np.ones(40))]
    other = rows_of(spark, cosines, y, w)
    old = ML.scores(other, *flat, ML.fit(other, *flat)).toPandas()
    assert len(got) == 300 and mine > 0.97 and mine > auc(old.y.to_numpy(), old.score.to_numpy())[0] + 0.01


@pytest.mark.parametrize("folds", [2, 5])
def test_up_sampling_draws_exactly_as_many_and_the_same_rows(spark, folds):
    rows = [(f"t{k}", float(k % 7 != 0), (k * 13) % folds) for k in range(500)] + [("u", 0.0, 0), ("v", 0.0, 1)]
    df = spark.createDataFrame(rows, "trip_id string, label double, fold int")
    first = M.random_copies(df.repartition(2), folds, True).select("trip_id", "label", "fold", "w").collect()
    again = M.random_copies(df.repartition(7), folds, True).select("trip_id", "label", "fold", "w").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(first) == len(rows)
    for f in range(folds):
        total = {c: sum(r.w[f] for r in first if r.label == c) for c in (0.0, 1.0)}
        common = sum(1 for t in rows if t[1] == 1.0 and t[2] != f)
        assert total == {0.0: common, 1.0: common}
        assert all((r.w[f] == 0) == (r.fold == f) for r in first)
        drawn = [r.w[f] - 1 for r in first if r.label == 0.0 and r.fold != f]
        assert max(drawn) > min(drawn)  # with replacement: unequal
    even = M.random_copies(df, folds, False).collect()
    assert all(r.w == [0.0 if f == r.fold else 1.0 for f in range(folds)] for r in even)


def test_held_out_measures(spark):
    r = np.random.default_rng(5)
    y, s = r.integers(0, 2, 400), np.round(r.normal(0, 1, 400), 1)
    df = spark.createDataFrame([("a", float(t), float(v)) for t, v in zip(y, s)] + [("b", 1.0, 2.0), ("b", 1.0, 1.0)], "k string, y double, score double")
    got = {t.k: t for t in M._held_out_measures(df, ["k"]).collect()}
    assert math.isclose(got["a"].auc, auc(y, s)[0], rel_tol=1e-12) and got["b"].auc is None and got["b"].sens == 1.0
    assert math.isclose(got["a"].spec, ((s <= 0) & (y == 0)).sum() / (y == 0).sum())


def test_cross_validation_on_the_smallest_data(spark):
    cv5, cv10 = (E.queries()[k](spark, SF_SMALL).collect() for k in ("ml_cv5", "ml_cv10"))
    assert sorted((r.Model, r.params) for r in cv5) == sorted(
        [("Logistic Regression", "none")] + [("Random Forest", f"mtry={m}") for m in (2, 10, 19)]
        + [("SVM (Radial)", f"C={c}") for c in (0.25, 0.5, 1.0, 2.0, 4.0)])
    assert len(cv10) == 1 and all(0.3 < r.auc_mean < 1 and r.auc_sd is not None for r in (*cv5, *cv10))
    best = max((r for r in cv5 if r.Model == cv10[0].Model), key=lambda r: r.auc_mean)
    assert cv10[0].params == best.params


def test_saved_kernel_svm(spark, tmp_path):
    r = np.random.default_rng(1)
    m = ML.nystroem(ML.scaled_map([0.0, 0.0], [1.0, 1.0]), r.normal(0, 1, (30, 2)), 8)
    svm = M.KernelSVM(m, list(np.ones(m.dims)), 1.0, 0.0)
    predictions = spark.createDataFrame([("a", 1)], "trip_id string, x int")
    paths = M.save_models({"SVM (Radial)": {"model": svm, "predictions": predictions}}, str(tmp_path))
    back = spark.read.parquet(paths["SVM (Radial)"]).first()
    assert np.allclose(back.half, m.half) and back.gamma == m.gamma and len(back.beta) == m.dims


def test_svms_of_all_costs_share_their_sums(monkeypatch):
    """Five costs on one fold: the Hessians take little more than one pass over the rows, and equal those of each alone."""
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (2000, 3))
    y, w = np.where(x[:, 0] + r.normal(0, 1, 2000) > 0, 1.0, -1.0), r.integers(1, 4, 2000).astype(float)
    m = ML.nystroem(ML.scaled_map(np.zeros(3), np.ones(3)), x[:100], 20)
    specs = [ML.Spec("svm", f"C={c}", 0, "svm", c) for c in (0.25, 0.5, 1.0, 2.0, 4.0)]
    betas = np.array([r.normal(0, 0.3, m.dims)] * 5) * (1 + 0.02 * np.arange(5))[:, None]
    rows, gram = [], ML._gram
    monkeypatch.setattr(ML, "_gram", lambda raw, w, on: rows.append(int(on.sum())) or gram(raw, w, on))
    found = list(ML._losses(specs, m.raw(x), y, w, m.turn @ betas.T))
    assert rows[0] > 500 and sum(rows) < 1.5 * rows[0]
    for s, beta, (loss, slope, curve) in zip(specs, betas, found):
        f = m(x) @ beta
        gap = np.maximum(1 - y * f, 0)
        on = m(x)[gap > 0]
        assert math.isclose(loss, s.cost * (w * gap ** 2).sum(), rel_tol=1e-9)
        assert np.allclose(m.turn.T @ slope, m(x).T @ (-2 * s.cost * w * gap * y), rtol=1e-6, atol=1e-6)
        assert np.allclose(m.turn.T @ curve @ m.turn, 2 * s.cost * (on * w[gap > 0][:, None]).T @ on, rtol=1e-6, atol=1e-6)
