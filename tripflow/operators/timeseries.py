"""Hourly series: calendar completion, forward fill, sliding lag windows,
ordered split, scaling and forecast metrics.

The series is one row per calendar hour, so its length is bounded by the
date span, not by the data volume.  Even so no step pushes it through one
task: forward fill runs per day and carries the previous day's last value in
from a per-day table; lag windows run per block of hours with a halo of the
``k`` preceding rows copied into each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r_round


def hourly(df: DataFrame, date: str = "date", hour: str = "hour", value: str = "actual_arrival_delay_min",
           extra: str = "traffic_congestion_index") -> DataFrame:
    return df.groupBy(date, hour).agg(F.avg(value).alias("avg_delay"), F.count("*").alias("trip_count"),
                                      F.avg(extra).alias("avg_congestion"))


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Every (date, hour) between the first and last date: a one-row span
    exploded into days, crossed with the 24 hours (a 24-row broadcast)."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(date), "lo")
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return days.crossJoin(F.broadcast(hours)).select(
        date, "hour", ((F.datediff(date, "lo") * 24) + F.col("hour")).cast("long").alias("idx"))


def complete(series: DataFrame, cal: DataFrame, keys=("date", "hour")) -> DataFrame:
    return cal.join(series, list(keys), "left")


def locf(df: DataFrame, value: str, day: str = "date", hour: str = "hour", out: str | None = None) -> DataFrame:
    """Forward fill ordered by (day, hour), two-level:
    1. within each day: last non-null so far (window partitioned by day);
    2. across days: the last non-null value of all earlier days, from a
       per-day table (one row per day) — then coalesce."""
    out = out or value
    w_in = Window.partitionBy(day).orderBy(hour).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumn("__in", F.last(value, ignorenulls=True).over(w_in))
    per_day = (df.where(F.col(value).isNotNull()).groupBy(day)
               .agg(F.max_by(value, hour).alias("__last")))
    all_days = df.select(day).distinct().join(per_day, day, "left")
    w_days = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    carry = all_days.select(day, F.last("__last", ignorenulls=True).over(w_days).alias("__carry"))
    return (within.join(carry, day, "left")
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry"))


def fill_mean(df: DataFrame, value: str) -> DataFrame:
    """Remaining NULLs ← mean of the (already filled) series."""
    m = F.broadcast(df.agg(F.avg(value).alias("__m")))
    return df.crossJoin(m).withColumn(value, F.coalesce(F.col(value), F.col("__m"))).drop("__m")


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    p = F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    rng = F.when(F.col("__hi") - F.col("__lo") == 0, 1.0).otherwise(F.col("__hi") - F.col("__lo"))
    return (df.crossJoin(p).withColumn(out, (F.col(value) - F.col("__lo")) / rng)
            .withColumn("__range", rng).withColumnRenamed("__lo", "scale_min").withColumnRenamed("__range", "scale_range")
            .drop("__hi"))


def lags(df: DataFrame, idx: str, value: str, k: int, block: int = 8192) -> DataFrame:
    """lag_1..lag_k of ``value`` along the contiguous index ``idx``.

    Rows are split into blocks of ``block`` hours; the last ``k`` rows of
    each block are copied into the next one as a halo, so a window
    partitioned by block sees every row's full history."""
    assert block > k
    b = F.floor(F.col(idx) / block)
    own = df.withColumn("__blk", b).withColumn("__halo", F.lit(False))
    halo = (df.where((F.col(idx) % block) >= block - k)
            .withColumn("__blk", b + 1).withColumn("__halo", F.lit(True)))
    w = Window.partitionBy("__blk").orderBy(idx)
    both = own.unionByName(halo)
    out = both.withColumns({f"lag_{j}": F.lag(value, j).over(w) for j in range(1, k + 1)})
    return out.where(~F.col("__halo")).drop("__blk", "__halo")


def lookback_for(n: int, lookback: int = 24) -> int:
    """Adaptive lookback: short series use max(4, n // 3)."""
    return max(4, n // 3) if n < lookback + 10 else lookback


def sequences(series: DataFrame, idx: str, value: str, lookback: int) -> DataFrame:
    """X = the ``lookback`` previous values (oldest first), y = value; one
    row per complete window, numbered from 1 in time order."""
    lg = lags(series, idx, value, lookback)
    lg = lg.where(F.col(idx) >= lookback)
    x = F.array(*[F.col(f"lag_{j}") for j in range(lookback, 0, -1)])
    return lg.select((F.col(idx) - lookback + 1).alias("seq_id"), idx, x.alias("X"), F.col(value).alias("y"),
                     *[f"lag_{j}" for j in range(1, lookback + 1)])


def ordered_split(seq: DataFrame, n_sequences: int, frac: float = 0.8) -> DataFrame:
    split = int(frac * n_sequences)
    return seq.withColumn("split", F.when(F.col("seq_id") <= split, "train").otherwise("test"))


def forecast_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    e = F.col(actual) - F.col(pred)
    den = F.when(F.col(actual) == 0, 1.0).otherwise(F.col(actual))
    one = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(e / den)) * 100).alias("mape"))
    return one.selectExpr("stack(4, 'MSE', mse, 'RMSE', sqrt(mse), 'MAE', mae, 'MAPE', mape) AS (Metric, Value)").select(
        "Metric", r_round(F.col("Value"), 4).alias("Value"))
