"""Hourly time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import timeseries as TS
from .oracle_ctes import with_xform
from .registry import register
from .stages import materialize, stage_path, transformed

_SERIES = (
    ", h AS (SELECT date, hour, avg(actual_arrival_delay_min) AS avg_delay, count(*) AS trip_count, "
    "avg(traffic_congestion_index) AS avg_congestion FROM transformed GROUP BY 1, 2), "
    "span AS (SELECT min(date) AS lo, max(date) AS hi FROM transformed), "
    "cal AS (SELECT CAST(d AS DATE) AS date, CAST(hr AS INT) AS hour, "
    "CAST(date_diff('day', (SELECT lo FROM span), CAST(d AS DATE)) * 24 + hr AS BIGINT) AS idx FROM "
    "(SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM span), "
    "(SELECT range AS hr FROM range(24))), "
    "full_ AS (SELECT cal.date, cal.hour, cal.idx, h.avg_delay, h.trip_count, h.avg_congestion FROM cal LEFT JOIN h USING (date, hour)), "
    "locf AS (SELECT *, last_value(avg_delay IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_locf FROM full_), "
    "filled AS (SELECT *, coalesce(avg_locf, (SELECT avg(avg_locf) FROM locf)) AS avg_filled FROM locf), "
    "sc AS (SELECT *, (avg_filled - (SELECT min(avg_filled) FROM filled)) / (SELECT CASE WHEN max(avg_filled) = min(avg_filled) THEN 1.0 "
    "ELSE max(avg_filled) - min(avg_filled) END FROM filled) AS scaled, (SELECT min(avg_filled) FROM filled) AS smin, "
    "(SELECT CASE WHEN max(avg_filled) = min(avg_filled) THEN 1.0 ELSE max(avg_filled) - min(avg_filled) END FROM filled) AS srange FROM filled), "
    "seq AS (SELECT idx - 24 + 1 AS seq_id, idx, scaled AS y, smin, srange, "
    + ", ".join(f"lag(scaled, {j}) OVER (ORDER BY idx) AS lag_{j}" for j in range(1, 25)) + " FROM sc), "
    "seqs AS (SELECT *, CASE WHEN seq_id <= CAST(floor(0.8 * (SELECT count(*) - 24 FROM sc)) AS BIGINT) THEN 'train' ELSE 'test' END AS split "
    "FROM seq WHERE idx >= 24), "
    "naive AS (SELECT seq_id, y * srange + smin AS actual, lag_1 * srange + smin AS pred_lag1, lag_24 * srange + smin AS pred_lag24 "
    "FROM seqs WHERE split = 'test') ")


def _series(spark, sf):
    df = transformed(spark, sf)
    cal = TS.calendar(df)
    full = TS.complete(TS.hourly(df), cal)
    return full


def _filled(spark, sf):
    """The completed and filled series as a stage table: what follows plans over one small scan."""
    f = TS.locf(_series(spark, sf), "avg_delay", out="avg_locf")
    return materialize(spark, TS.fill_mean(f.withColumn("avg_filled", F.col("avg_locf")), "avg_filled"),
                       stage_path(spark, sf, "series"))


def _scaled(spark, sf):
    return TS.minmax(_filled(spark, sf), "avg_filled", "scaled")


def _sequences(spark, sf):
    sc = _scaled(spark, sf)
    n = sc.count()
    lb = TS.lookback_for(n)
    seq = TS.sequences(sc.select("idx", "scaled", "scale_min", "scale_range"), "idx", "scaled", lb)
    seq = seq.join(sc.select("idx", "scale_min", "scale_range"), "idx")
    return TS.ordered_split(seq, n - lb), lb


@register("ts_hourly", with_xform(_SERIES + "SELECT date, hour, round(avg_delay, 6) + 0.0 AS avg_delay, trip_count, "
                                  "round(avg_congestion, 6) + 0.0 AS avg_congestion FROM h"))
def ts_hourly(spark, sf):
    h = TS.hourly(transformed(spark, sf))
    return h.select("date", "hour", r_round(F.col("avg_delay"), 6).alias("avg_delay"), "trip_count",
                    r_round(F.col("avg_congestion"), 6).alias("avg_congestion"))


@register("jn_calendar_cross", with_xform(_SERIES + "SELECT date, hour, idx FROM cal"))
def jn_calendar_cross(spark, sf):
    return TS.calendar(transformed(spark, sf))


@register("jn_calendar_left", with_xform(_SERIES + "SELECT date, hour, round(avg_delay, 6) + 0.0 AS avg_delay, trip_count FROM full_"))
def jn_calendar_left(spark, sf):
    s = _series(spark, sf)
    return s.select("date", "hour", r_round(F.col("avg_delay"), 6).alias("avg_delay"), "trip_count")


@register("jn_calendar_right", with_xform(_SERIES + "SELECT cal.date, cal.hour, round(h.avg_delay, 6) + 0.0 AS avg_delay "
                                          "FROM h RIGHT JOIN cal USING (date, hour)"))
def jn_calendar_right(spark, sf):
    df = transformed(spark, sf)
    h = TS.hourly(df)
    cal = TS.calendar(df)
    return h.join(cal, ["date", "hour"], "right").select("date", "hour", r_round(F.col("avg_delay"), 6).alias("avg_delay"))


@register("ts_locf", with_xform(_SERIES + "SELECT date, hour, round(avg_locf, 6) + 0.0 AS avg_delay FROM locf"))
def ts_locf(spark, sf):
    f = _filled(spark, sf)
    return f.select("date", "hour", r_round(F.col("avg_locf"), 6).alias("avg_delay"))


@register("ts_locf_mean", with_xform(_SERIES + "SELECT date, hour, round(avg_filled, 6) + 0.0 AS avg_delay, trip_count, "
                                     "round(avg_congestion, 6) + 0.0 AS avg_congestion FROM filled"))
def ts_locf_mean(spark, sf):
    f = _filled(spark, sf)
    return f.select("date", "hour", r_round(F.col("avg_filled"), 6).alias("avg_delay"), "trip_count",
                    r_round(F.col("avg_congestion"), 6).alias("avg_congestion"))


@register("ts_minmax", with_xform(_SERIES + "SELECT date, hour, round(scaled, 6) + 0.0 AS scaled FROM sc"))
def ts_minmax(spark, sf):
    return _scaled(spark, sf).select("date", "hour", r_round(F.col("scaled"), 6).alias("scaled"))


@register("ts_sequences", with_xform(_SERIES + "SELECT seq_id, round(y, 6) + 0.0 AS y, "
                                     + ", ".join(f"round(lag_{j}, 6) + 0.0 AS lag_{j}" for j in range(1, 25)) + " FROM seqs"))
def ts_sequences(spark, sf):
    seq, lb = _sequences(spark, sf)
    return seq.select("seq_id", r_round(F.col("y"), 6).alias("y"),
                      *[r_round(F.col(f"lag_{j}"), 6).alias(f"lag_{j}") for j in range(1, lb + 1)])


@register("ts_split", with_xform(_SERIES + "SELECT split, count(*) AS n, min(seq_id) AS first_seq, max(seq_id) AS last_seq FROM seqs GROUP BY split"))
def ts_split(spark, sf):
    seq, _ = _sequences(spark, sf)
    return seq.groupBy("split").agg(F.count("*").alias("n"), F.min("seq_id").alias("first_seq"),
                                    F.max("seq_id").alias("last_seq"))


def _naive(spark, sf):
    seq, lb = _sequences(spark, sf)
    t = seq.where(F.col("split") == "test")
    inv = lambda c: F.col(c) * F.col("scale_range") + F.col("scale_min")
    return t.select("seq_id", inv("y").alias("actual"), inv("lag_1").alias("pred_lag1"), inv(f"lag_{lb}").alias("pred_lag24"))


@register("ts_forecast_naive", with_xform(_SERIES + "SELECT seq_id, round(actual, 6) + 0.0 AS actual, round(pred_lag1, 6) + 0.0 AS pred_lag1, "
                                          "round(pred_lag24, 6) + 0.0 AS pred_lag24 FROM naive"))
def ts_forecast_naive(spark, sf):
    n = _naive(spark, sf)
    return n.select("seq_id", *[r_round(F.col(c), 6).alias(c) for c in ("actual", "pred_lag1", "pred_lag24")])


@register("ts_metrics", with_xform(_SERIES + ", m AS (SELECT avg((actual - pred_lag1) * (actual - pred_lag1)) AS mse, "
                                   "avg(abs(actual - pred_lag1)) AS mae, avg(abs((actual - pred_lag1) / CASE WHEN actual = 0 THEN 1.0 ELSE actual END)) * 100 AS mape FROM naive) "
                                   "SELECT 'MSE' AS Metric, round(mse, 4) + 0.0 AS Value FROM m UNION ALL SELECT 'RMSE', round(sqrt(mse), 4) + 0.0 FROM m "
                                   "UNION ALL SELECT 'MAE', round(mae, 4) + 0.0 FROM m UNION ALL SELECT 'MAPE', round(mape, 4) + 0.0 FROM m"))
def ts_metrics(spark, sf):
    return TS.forecast_metrics(_naive(spark, sf), "actual", "pred_lag1")


@register("ts_residuals", with_xform(_SERIES + "SELECT seq_id, round(actual - pred_lag1, 6) + 0.0 AS residual FROM naive"))
def ts_residuals(spark, sf):
    n = _naive(spark, sf)
    return n.select("seq_id", r_round(F.col("actual") - F.col("pred_lag1"), 6).alias("residual"))


@register("ts_residual_stats", with_xform(_SERIES + "SELECT round(avg(actual - pred_lag1), 4) + 0.0 AS mean, "
                                          "round(stddev_samp(actual - pred_lag1), 4) + 0.0 AS sd, round(min(actual - pred_lag1), 4) + 0.0 AS min, "
                                          "round(max(actual - pred_lag1), 4) + 0.0 AS max FROM naive"))
def ts_residual_stats(spark, sf):
    r = _naive(spark, sf).select((F.col("actual") - F.col("pred_lag1")).alias("r"))
    return r.agg(r_round(F.avg("r"), 4).alias("mean"), r_round(F.stddev_samp("r"), 4).alias("sd"),
                 r_round(F.min("r"), 4).alias("min"), r_round(F.max("r"), 4).alias("max"))


def _ml_forecast(spark, sf, model: str):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    seq, lb = _sequences(spark, sf)
    va = VectorAssembler(inputCols=[f"lag_{j}" for j in range(1, lb + 1)], outputCol="features")
    data = va.transform(seq)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    est = (LinearRegression(featuresCol="features", labelCol="y", regParam=0.0) if model == "lr"
           else GBTRegressor(featuresCol="features", labelCol="y", maxIter=20, maxDepth=4, seed=42))
    m = est.fit(train)
    p = m.transform(test)
    inv = lambda c: F.col(c) * F.col("scale_range") + F.col("scale_min")
    return p.select("seq_id", r_round(inv("y"), 6).alias("actual"), r_round(inv("prediction"), 6).alias("predicted"))


@register("ts_forecast_lr")
def ts_forecast_lr(spark, sf):
    """24 lags → next hour with MLlib LinearRegression (stand-in for the LSTM)."""
    return _ml_forecast(spark, sf, "lr")


@register("ts_forecast_gbt")
def ts_forecast_gbt(spark, sf):
    """24 lags → next hour with gradient-boosted trees."""
    return _ml_forecast(spark, sf, "gbt")
