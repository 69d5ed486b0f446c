"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.quality import TRIP_COLUMNS
from .stages import raw_trips as trips
from .oracle_ctes import with_trips
from .registry import register

_NUM = ["actual_departure_delay_min", "actual_arrival_delay_min", "temperature_C", "humidity_percent",
        "wind_speed_kmh", "precipitation_mm", "event_attendance_est", "traffic_congestion_index",
        "holiday", "peak_hour", "weekday", "delayed"]
_FREQ = ["transport_type", "weather_condition", "event_type", "season"]


def _nulls_sql(section: bool = False):
    sec = ", 'Missing Values' AS Section, CAST(NULL AS BIGINT) AS Unique_Values" if section else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS Column, count(*) - count({c}) AS Missing_Count, "
        f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) + 0.0 AS Missing_Percent{sec} FROM trips" for c in TRIP_COLUMNS)


def _distinct_sql(section: bool = False):
    sec = (", 'Unique Values' AS Section, CAST(NULL AS BIGINT) AS Missing_Count, CAST(NULL AS DOUBLE) AS Missing_Percent"
           if section else "")
    return " UNION ALL ".join(
        f"SELECT '{c}' AS Column, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS Unique_Values{sec} FROM trips" for c in TRIP_COLUMNS)


@register("prof_nulls", with_trips(_nulls_sql()))
def prof_nulls(spark, sf):
    return P.null_counts(trips(spark, sf), TRIP_COLUMNS)


@register("prof_distinct", with_trips(_distinct_sql()))
def prof_distinct(spark, sf):
    return P.distinct_counts(trips(spark, sf), TRIP_COLUMNS)


@register("prof_report", with_trips("SELECT * FROM (" + _nulls_sql(True) + ") UNION ALL BY NAME SELECT * FROM (" + _distinct_sql(True) + ")"))
def prof_report(spark, sf):
    df = trips(spark, sf)
    a = P.null_counts(df, TRIP_COLUMNS).withColumn("Section", F.lit("Missing Values"))
    b = P.distinct_counts(df, TRIP_COLUMNS).withColumn("Section", F.lit("Unique Values"))
    return a.unionByName(b, allowMissingColumns=True)


@register("prof_numeric", with_trips(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) + 0.0 AS mean, "
    f"round(quantile_cont({c}, 0.5), 2) + 0.0 AS median, round(stddev_samp({c}), 2) + 0.0 AS sd FROM trips" for c in _NUM)))
def prof_numeric(spark, sf):
    df = trips(spark, sf)
    return P.numeric_profile(df, [c for c in P.numeric_columns(df) if c != "ingest_seq"])


@register("prof_frequency", with_trips(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM trips WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _FREQ)))
def prof_frequency(spark, sf):
    return P.frequency(trips(spark, sf), _FREQ)


@register("prof_all_null", with_trips(
    "SELECT \"Column\" FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS Column, count({c}) AS k FROM trips" for c in TRIP_COLUMNS)
    + ") WHERE k = 0"))
def prof_all_null(spark, sf):
    return P.all_null_columns(trips(spark, sf), TRIP_COLUMNS)


_SUM = ["actual_departure_delay_min", "actual_arrival_delay_min", "temperature_C", "event_attendance_est",
        "traffic_congestion_index"]


@register("prof_summary", with_trips(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, round(min({c}), 4) + 0.0 AS min, round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1, "
    f"round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, round(avg({c}), 4) + 0.0 AS mean, "
    f"round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3, round(max({c}), 4) + 0.0 AS max FROM trips" for c in _SUM)))
def prof_summary(spark, sf):
    return P.summary(trips(spark, sf), _SUM)


@register("prj_numeric_columns", with_trips("SELECT " + ", ".join(["ingest_seq"] + _NUM) + " FROM trips"))
def prj_numeric_columns(spark, sf):
    """select(where(is.numeric)): schema-driven projection (pruned scan)."""
    df = trips(spark, sf)
    return df.select(*P.numeric_columns(df))


@register("prj_existing_columns", with_trips("SELECT trip_id, ingest_seq, route_id, delayed FROM trips"))
def prj_existing_columns(spark, sf):
    """cols[cols %in% names(df)]: keep only requested columns that exist."""
    df = trips(spark, sf)
    wanted = ["trip_id", "ingest_seq", "route_id", "not_a_column", "delayed", "cluster"]
    return df.select(*[c for c in wanted if c in df.columns])
