"""Evaluation queries on fixed, deterministic scores: every
metric is checked without training anything."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import evaluation as EV
from .oracle_ctes import with_xform
from .registry import register
from .stages import transformed

# A fixed score per "model": name, score expression (Spark and DuckDB text
# are the same), decision threshold.
MODELS = [("Congestion", "traffic_congestion_index / 100.0", 0.5),
          ("Weather", "weather_severity_index", 0.3),
          ("Departure", "actual_departure_delay_min / 20.0", 0.25)]

_SC = ", sc AS (SELECT trip_id, delayed, traffic_congestion_index / 100.0 AS score, " \
      "CASE WHEN traffic_congestion_index / 100.0 > 0.5 THEN 1 ELSE 0 END AS pred, actual_arrival_delay_min, traffic_congestion_index, " \
      "temperature_C FROM transformed) "


def _scored(spark, sf):
    df = transformed(spark, sf)
    s = F.col("traffic_congestion_index") / 100.0
    return df.select("trip_id", "delayed", s.alias("score"), F.when(s > 0.5, 1).otherwise(0).alias("pred"),
                     "actual_arrival_delay_min", "traffic_congestion_index", "temperature_C")


_CM = ", cells AS (SELECT a AS actual, p AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)), " \
      "cm AS (SELECT c.actual, c.predicted, coalesce(n, 0) AS n FROM cells c LEFT JOIN (SELECT delayed AS actual, pred AS predicted, " \
      "count(*) AS n FROM sc GROUP BY 1, 2) k USING (actual, predicted)) "


def _metrics_sql(src="cm"):
    return (f", mx AS (SELECT CAST(sum(n) FILTER (WHERE actual = 1 AND predicted = 1) AS DOUBLE) AS tp, "
            f"CAST(sum(n) FILTER (WHERE actual = 0 AND predicted = 0) AS DOUBLE) AS tn, "
            f"CAST(sum(n) FILTER (WHERE actual = 0 AND predicted = 1) AS DOUBLE) AS fp, "
            f"CAST(sum(n) FILTER (WHERE actual = 1 AND predicted = 0) AS DOUBLE) AS fn FROM {src}) "
            "SELECT round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) + 0.0 AS Accuracy, round(tp / nullif(tp + fp, 0), 4) + 0.0 AS Precision, "
            "round(tp / nullif(tp + fn, 0), 4) + 0.0 AS Recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / "
            "nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 4) + 0.0 AS F1_Score, round(tn / nullif(tn + fp, 0), 4) + 0.0 AS Specificity FROM mx")


@register("ml_confusion", with_xform(_SC + _CM + "SELECT actual, predicted, n FROM cm"))
def ml_confusion(spark, sf):
    return EV.confusion(_scored(spark, sf), "delayed", "pred")


@register("ml_metrics", with_xform(_SC + _CM + _metrics_sql()))
def ml_metrics(spark, sf):
    return EV.metrics_from_confusion(EV.confusion(_scored(spark, sf), "delayed", "pred"))


@register("ml_roc_points", with_xform(
    _SC + ", s AS (SELECT score, count(*) FILTER (WHERE delayed = 1) AS pos, count(*) FILTER (WHERE delayed = 0) AS neg FROM sc GROUP BY score) "
    "SELECT score AS threshold, round(sum(pos) OVER w / (SELECT sum(pos) FROM s), 6) + 0.0 AS tpr, "
    "round(sum(neg) OVER w / (SELECT sum(neg) FROM s), 6) + 0.0 AS fpr FROM s "
    "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def ml_roc_points(spark, sf):
    return EV.roc_points(_scored(spark, sf), "delayed", "score")


@register("ml_auc", with_xform(
    _SC + ", s AS (SELECT score, count(*) FILTER (WHERE delayed = 1) AS pos, count(*) FILTER (WHERE delayed = 0) AS neg FROM sc GROUP BY score), "
    "c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM s) "
    "SELECT round(sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) + 0.0 AS AUC FROM c"))
def ml_auc(spark, sf):
    return EV.auc(_scored(spark, sf), "delayed", "score")


@register("ml_error_types", with_xform(
    _SC + "SELECT CASE WHEN delayed = 1 AND pred = 0 THEN 'False Negative' WHEN delayed = 0 AND pred = 1 THEN 'False Positive' "
    "ELSE 'Correct' END AS error_type, count(*) AS n FROM sc GROUP BY 1"))
def ml_error_types(spark, sf):
    return EV.error_types(_scored(spark, sf), "delayed", "pred")


_FEATS = ["actual_arrival_delay_min", "traffic_congestion_index", "temperature_C"]


@register("ml_error_profile", with_xform(
    _SC + "SELECT CASE WHEN delayed = 1 AND pred = 1 THEN 'TP' WHEN delayed = 0 AND pred = 0 THEN 'TN' WHEN delayed = 0 AND pred = 1 "
    "THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS n, " + ", ".join(f"round(avg({f}), 4) + 0.0 AS mean_{f}" for f in _FEATS)
    + " FROM sc GROUP BY 1"))
def ml_error_profile(spark, sf):
    return EV.error_profile(_scored(spark, sf), "delayed", "pred", _FEATS)


def _cmp_sql():
    parts = []
    for i, (name, expr, t) in enumerate(MODELS):
        parts.append(
            f"SELECT {i} AS ord, '{name}' AS Model, CAST(count(*) FILTER (WHERE delayed = 1 AND ({expr}) > {t}) AS DOUBLE) AS tp, "
            f"CAST(count(*) FILTER (WHERE delayed = 0 AND NOT (({expr}) > {t})) AS DOUBLE) AS tn, "
            f"CAST(count(*) FILTER (WHERE delayed = 0 AND ({expr}) > {t}) AS DOUBLE) AS fp, "
            f"CAST(count(*) FILTER (WHERE delayed = 1 AND NOT (({expr}) > {t})) AS DOUBLE) AS fn FROM transformed")
    return (", mx AS (" + " UNION ALL ".join(parts) + "), f AS (SELECT ord, Model, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / "
            "nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 4) + 0.0 AS F1_Score, "
            "round((tp + tn) / (tp + tn + fp + fn), 4) + 0.0 AS Accuracy FROM mx) "
            "SELECT Model, F1_Score, Accuracy FROM f ORDER BY F1_Score DESC NULLS LAST, ord LIMIT 1")


@register("ml_select_best", with_xform(_cmp_sql()))
def ml_select_best(spark, sf):
    """Model comparison table → the first model with the highest F1."""
    df = transformed(spark, sf)
    rows = None
    for i, (name, expr, t) in enumerate(MODELS):
        s = df.select(F.col("delayed"), F.when(F.expr(expr) > t, 1).otherwise(0).alias("pred"))
        m = EV.metrics_from_confusion(EV.confusion(s, "delayed", "pred")).select(
            F.lit(i).alias("ord"), F.lit(name).alias("Model"), "F1_Score", "Accuracy")
        rows = m if rows is None else rows.unionByName(m)
    best = rows.agg(F.min_by(F.struct("Model", "F1_Score", "Accuracy"),
                             F.struct(F.coalesce(-F.col("F1_Score"), F.lit(float("inf"))), F.col("ord"))).alias("b"))
    return best.select("b.*")


@register("ml_stratified_split", with_xform(
    ", r AS (SELECT trip_id, delayed, row_number() OVER (PARTITION BY delayed ORDER BY trip_id) AS rn, count(*) OVER (PARTITION BY delayed) AS n "
    "FROM transformed) SELECT trip_id, delayed, CASE WHEN rn <= ceil(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r"))
def ml_stratified_split(spark, sf):
    return EV.stratified_split(transformed(spark, sf).select("trip_id", "delayed"), "delayed", ["trip_id"])


@register("jn_train_test_anti", with_xform(
    ", r AS (SELECT trip_id, delayed, row_number() OVER (PARTITION BY delayed ORDER BY trip_id) AS rn, count(*) OVER (PARTITION BY delayed) AS n "
    "FROM transformed) SELECT trip_id, delayed FROM r WHERE NOT rn <= ceil(n * 0.8)"))
def jn_train_test_anti(spark, sf):
    """test = all rows minus the train rows (left-anti join on the key)."""
    df = transformed(spark, sf).select("trip_id", "delayed")
    train = EV.stratified_split(df, "delayed", ["trip_id"]).where(F.col("split") == "train")
    return df.join(train.select("trip_id"), "trip_id", "left_anti")


@register("ml_imbalance", with_xform(
    ", s AS (SELECT delayed, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM transformed GROUP BY 1) "
    "SELECT CAST(arg_min(delayed, pct) AS INT) AS minority_class, min(pct) + 0.0 AS minority_pct, min(pct) < 35 AS needs_upsample FROM s"))
def ml_imbalance(spark, sf):
    sh = EV.class_shares(transformed(spark, sf), "delayed")
    return sh.agg(F.min_by("delayed", "pct").alias("minority_class"), F.min("pct").alias("minority_pct"),
                  (F.min("pct") < 35).alias("needs_upsample"))


_UP = (", n AS (SELECT delayed, count(*) AS n FROM transformed GROUP BY 1), "
       "r AS (SELECT t.trip_id, t.delayed, row_number() OVER (PARTITION BY t.delayed ORDER BY t.trip_id) AS rn, n.n, (SELECT max(n) FROM n) AS M "
       "FROM transformed t JOIN n USING (delayed)) ")


@register("ml_upsample", with_xform(
    _UP + "SELECT delayed, CAST(sum(CASE WHEN n = M THEN 1 ELSE ceil((M - rn + 1) / n) END) AS BIGINT) AS n_rows, count(*) AS n_distinct_trips "
    "FROM r GROUP BY delayed"))
def ml_upsample(spark, sf):
    up = EV.upsample_exact(transformed(spark, sf).select("trip_id", "delayed"), "delayed", ["trip_id"])
    return up.groupBy("delayed").agg(F.count("*").alias("n_rows"), F.countDistinct("trip_id").alias("n_distinct_trips"))


@register("ml_downsample", with_xform(
    ", n AS (SELECT delayed, count(*) AS n FROM transformed GROUP BY 1), r AS (SELECT trip_id, delayed, row_number() OVER "
    "(PARTITION BY delayed ORDER BY trip_id) AS rn FROM transformed) SELECT trip_id, delayed FROM r WHERE rn <= (SELECT min(n) FROM n)"))
def ml_downsample(spark, sf):
    return EV.downsample_exact(transformed(spark, sf).select("trip_id", "delayed"), "delayed", ["trip_id"])
