"""Streaming query: the hourly series through Structured
Streaming must equal the batch aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..streaming.hourly import hourly_stream, read_hourly
from .oracle_ctes import with_xform
from .registry import register
from .stages import stage_path, transformed


@register("st_hourly", with_xform(
    "SELECT CAST(datetime AS DATE) AS date, CAST(hour(datetime) AS INT) AS hour, round(avg(actual_arrival_delay_min), 6) + 0.0 AS avg_delay, "
    "count(*) AS trip_count, round(avg(traffic_congestion_index), 6) + 0.0 AS avg_congestion FROM transformed GROUP BY 1, 2"))
def st_hourly(spark, sf):
    df = transformed(spark, sf)
    src = stage_path(spark, sf, "stream/in")
    run = uuid.uuid4().hex[:8]
    (df.select("datetime", "actual_arrival_delay_min", "traffic_congestion_index")
     .repartition(8, F.to_date("datetime")).write.mode("overwrite").parquet(src))
    schema = spark.read.parquet(src).schema
    out = stage_path(spark, sf, f"stream/out-{run}")
    hourly_stream(spark, src, schema, out, stage_path(spark, sf, f"stream/ckpt-{run}"))
    h = read_hourly(spark, out)
    return h.select("date", "hour", r_round(F.col("avg_delay"), 6).alias("avg_delay"), "trip_count",
                    r_round(F.col("avg_congestion"), 6).alias("avg_congestion"))
