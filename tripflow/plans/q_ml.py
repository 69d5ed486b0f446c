"""MLlib queries: standardisation, PCA, K-Means sweep,
classifiers with cross-validation.  Fitted models are not SQL-checkable;
their keys carry no oracle (rows + invariants in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import ml as M
from .oracle_ctes import with_xform
from .registry import register
from .stages import transformed

_MEMO: dict = {}


def _memo(spark, sf, name, fn):
    key = (name, sf, spark.sparkContext.applicationId)
    if key not in _MEMO:
        _MEMO[key] = fn()
    return _MEMO[key]


def _std_sql():
    cols = M.PCA_FEATURES
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f", cc AS (SELECT trip_id, {', '.join(cols)} FROM transformed WHERE {cond}) SELECT trip_id, "
            + ", ".join(f"round(({c} - (SELECT avg({c}) FROM cc)) / (SELECT stddev_samp({c}) FROM cc), 6) + 0.0 AS {c}" for c in cols)
            + " FROM cc")


@register("ml_standardize", with_xform(_std_sql()))
def ml_standardize(spark, sf):
    """Complete cases of the PCA feature set, centred and scaled (n-1 sd)."""
    z = M.standardize(transformed(spark, sf), M.PCA_FEATURES, "trip_id")
    return z.select("trip_id", *[r_round(F.col(c), 6).alias(c) for c in M.PCA_FEATURES])


def _pca(spark, sf):
    return _memo(spark, sf, "pca", lambda: M.pca(transformed(spark, sf), M.PCA_FEATURES, "trip_id"))


@register("ml_pca_variance")
def ml_pca_variance(spark, sf):
    """Component, Eigenvalue, Variance_Pct, Cumulative_Pct (of rounded %)."""
    return _pca(spark, sf).variance


@register("ml_pca_select")
def ml_pca_select(spark, sf):
    """Kaiser count and the first component reaching 85 % / 90 %."""
    return M.pca_select(_pca(spark, sf).variance)


@register("ml_pca_loadings")
def ml_pca_loadings(spark, sf):
    return _pca(spark, sf).loadings


@register("ml_pca_scores")
def ml_pca_scores(spark, sf):
    return _pca(spark, sf).scores


def _kmeans(spark, sf):
    p = _pca(spark, sf)
    return _memo(spark, sf, "kmeans-models", lambda: M.kmeans_models(p.scores, p.score_cols, range(1, 11), seed=42))


def kmeans_scores(spark, sf):
    p = _pca(spark, sf)
    k = _memo(spark, sf, "kmeans-k", lambda: cl_choose_k(spark, sf).first()["chosen_k"])
    return M.kmeans_assign(p.scores, p.score_cols, _kmeans(spark, sf)[k])


@register("cl_elbow")
def cl_elbow(spark, sf):
    """Within-cluster SS for K = 1..10 (K = 1 is the total SS), the best of 25 starts each."""
    p = _pca(spark, sf)
    return _memo(spark, sf, "elbow", lambda: M.kmeans_sweep(p.scores, p.score_cols, _kmeans(spark, sf)))


@register("cl_choose_k")
def cl_choose_k(spark, sf):
    """argmax silhouette over the sweep, clamped to [2, 5]."""
    return M.choose_k(cl_elbow(spark, sf))


@register("cl_kmeans")
def cl_kmeans(spark, sf):
    s = kmeans_scores(spark, sf)
    return s.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster")


@register("cl_gap_statistic")
def cl_gap_statistic(spark, sf):
    """Gap statistic for K = 1..10 (the best of 25 starts) against ten uniform reference sets (the best of 10)."""
    p = _pca(spark, sf)
    return M.gap_statistic(p.scores, p.score_cols, _kmeans(spark, sf), seed=42)


# ---------------------------------------------------------------- classification

def _ml_data(spark, sf):
    return M.classification_frame(transformed(spark, sf))


@register("ml_features", with_xform(
    "SELECT trip_id, delayed, " + ", ".join(
        __import__("tripflow.operators.ml", fromlist=["CLASS_FEATURES"]).CLASS_FEATURES) + " FROM transformed"))
def ml_features(spark, sf):
    """The 19 pre-trip features (no leakage columns) with key and label."""
    return transformed(spark, sf).select("trip_id", "delayed", *M.CLASS_FEATURES)


def _cv5(spark, sf, only):
    """The 5-fold CV of the training rows, a model at a time; the linear ones share their rounds."""
    def fit():
        train, _ = M.split_rows(_ml_data(spark, sf))
        return M.cross_validate(train, folds=5, only=only)
    return _memo(spark, sf, f"cv5-{only}", fit)


def _model(spark, sf, name):
    """A model with the setting that the 5-fold CV finds best."""
    def fit():
        setting = None if name == "Logistic Regression" else M.best_setting(_cv5(spark, sf, name), name)
        return M.fit_model(name, _ml_data(spark, sf), setting)
    return _memo(spark, sf, f"model-{name}", fit)


def _models(spark, sf):
    return {name: _model(spark, sf, name) for name in M.MODELS}


@register("ml_logistic")
def ml_logistic(spark, sf):
    return _model(spark, sf, "Logistic Regression")["predictions"]


@register("ml_random_forest")
def ml_random_forest(spark, sf):
    """Forest of 100 trees; the inputs tried at a split are those that the 5-fold CV finds best."""
    return _model(spark, sf, "Random Forest")["predictions"]


@register("ml_svm_rbf")
def ml_svm_rbf(spark, sf):
    """RBF SVM over Nystroem landmarks; width from distance quantiles, cost by the 5-fold CV."""
    return _model(spark, sf, "SVM (Radial)")["predictions"]


@register("ml_cv5")
def ml_cv5(spark, sf):
    """5-fold CV of the training rows: AUC (mean and sd), sensitivity and specificity of each model and setting."""
    parts = [_cv5(spark, sf, name) for name in M.MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("ml_cv10")
def ml_cv10(spark, sf):
    """10-fold CV, over all rows, of the model that won on F1, with its best setting of the 5-fold CV."""
    def fit():
        best = M.best_by_f1(_models(spark, sf))
        return M.cross_validate(_ml_data(spark, sf), folds=10, only=best, setting=M.best_setting(_cv5(spark, sf, best), best))
    return _memo(spark, sf, "cv10", fit)


@register("ml_importance")
def ml_importance(spark, sf):
    return _model(spark, sf, "Random Forest")["importance"]


@register("jn_scores_by_key")
def jn_scores_by_key(spark, sf):
    """Scores rejoined to trips by key (never by position)."""
    pred = _model(spark, sf, "Logistic Regression")["predictions"]
    return transformed(spark, sf).select("trip_id", "origin_station").join(pred, "trip_id")


@register("ml_model_comparison")
def ml_model_comparison(spark, sf):
    """Model, Accuracy, Precision, Recall, F1_Score, Specificity, AUC."""
    return M.comparison(_models(spark, sf))


@register("ml_smote")
def ml_smote(spark, sf):
    """SMOTE on the 2-D (congestion, arrival delay) plane: each minority
    point is interpolated towards one of its 5 nearest minority neighbours
    (grid-ring neighbour search, seeded choice)."""
    return M.smote_2d(transformed(spark, sf), "traffic_congestion_index", "actual_arrival_delay_min", "delayed", k=5, seed=42)
