"""BI report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import aggregate as A
from ..operators import report as R
from ..operators.features import station_stats
from .oracle_ctes import with_xform
from .q_windows import win_station_rank
from .registry import register
from .stages import stage_path, transformed


def _num(x):
    return f"CASE WHEN CAST({x} AS DOUBLE) = floor(CAST({x} AS DOUBLE)) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END"


_KPI_SQL = with_xform(
    ", k AS (SELECT count(*) AS k0, sum(CAST(delayed AS DOUBLE)) AS k1, count(*) FILTER (WHERE delayed = 0) AS k2, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) AS k3, round(avg(actual_arrival_delay_min), 2) AS k4, "
    "round(avg(actual_departure_delay_min), 2) AS k5, max(actual_arrival_delay_min) AS k6, "
    "(SELECT count(DISTINCT s) FROM (SELECT origin_station AS s FROM transformed UNION ALL SELECT destination_station FROM transformed)) AS k8, "
    "count(DISTINCT route_id) AS k9, CAST(min(date) AS VARCHAR) AS k10, CAST(max(date) AS VARCHAR) AS k11 FROM transformed) "
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS idx, '{n}' AS Metric, {_num(k) if k not in ('k10', 'k11') else k} AS Value FROM k"
        for i, (n, k) in enumerate(zip(R.KPI_NAMES, ["k0", "k1", "k2", "k3", "k4", "k5", "k6", "k8", "k9", "k10", "k11"]))))


@register("rep_kpi", _KPI_SQL)
def rep_kpi(spark, sf):
    return R.kpi(transformed(spark, sf))


@register("rep_station_rankings", with_xform(
    "SELECT origin_station, count(*) AS total_trips, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate, "
    "CAST(row_number() OVER (ORDER BY round(avg(actual_arrival_delay_min), 2) DESC, origin_station) AS INT) AS rank "
    "FROM transformed GROUP BY origin_station"))
def rep_station_rankings(spark, sf):
    return win_station_rank(spark, sf)


@register("rep_hourly_patterns", with_xform(
    "SELECT hour, CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, CAST(sum(delayed) AS BIGINT) AS delay_count, count(*) AS total_trips, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate FROM transformed GROUP BY 1, 2"))
def rep_hourly_patterns(spark, sf):
    df = transformed(spark, sf)
    dt = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("day_type")
    return A.group_delay(df, ["hour", dt], with_delay_count=True)


@register("rep_weather_impact", with_xform(
    "SELECT weather_condition, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate, count(*) AS total_trips "
    "FROM transformed GROUP BY weather_condition"))
def rep_weather_impact(spark, sf):
    return A.group_delay(transformed(spark, sf), ["weather_condition"]).orderBy(F.desc("avg_delay"))


_ST_SCHEMA = ("origin_station string, station_avg_dep_delay double, station_avg_arr_delay double, "
              "station_delay_rate double, station_total_trips long, station_sd_delay double, station_max_delay double")


@register("rep_copy_through", with_xform(
    "SELECT origin_station, round(avg(actual_departure_delay_min), 2) + 0.0 AS station_avg_dep_delay, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS station_avg_arr_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS station_delay_rate, count(*) AS station_total_trips, "
    "round(stddev_samp(actual_arrival_delay_min), 2) + 0.0 AS station_sd_delay, "
    "max(actual_arrival_delay_min) AS station_max_delay FROM transformed GROUP BY origin_station"))
def rep_copy_through(spark, sf):
    """Write the station report as CSV, then re-export it through the
    existence-guarded copy (a missing report is skipped, not an error)."""
    src = stage_path(spark, sf, "reports/station_origin_statistics.csv")
    station_stats(transformed(spark, sf)).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(src)
    missing = R.copy_through(spark, src + "-absent", stage_path(spark, sf, "reports/none.csv"), _ST_SCHEMA)
    assert missing is None
    return R.copy_through(spark, src, stage_path(spark, sf, "reports/powerbi_station_copy.csv"), _ST_SCHEMA)
