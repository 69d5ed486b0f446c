"""Feature-engineering and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.stats import r_round
from ..operators import features as FE
from .stages import raw_trips as trips
from .oracle_ctes import with_clean, with_trips, with_xform
from .registry import register
from .stages import cleaned, transformed

_Z = [c + "_z" for c in FE.SCALE_COLS]
_MM = [c + "_mm" for c in FE.SCALE_COLS]


def _x(cols):
    return with_xform("SELECT trip_id, " + ", ".join(cols) + " FROM transformed")


def _sel(spark, sf, cols):
    return transformed(spark, sf).select("trip_id", *cols)


_FE = {
    "fe_datetimes": ["datetime", "sched_dep_datetime", "sched_arr_datetime"],
    "fe_temporal": ["hour", "day_name", "is_weekend", "month", "week_of_year", "time_of_day_bucket"],
    "fe_delay": ["total_delay", "delay_change", "is_early_departure", "is_early_arrival", "severe_delay"],
    "fe_duration": ["trip_duration_scheduled"],
    "fe_label_encode": ["transport_type_enc", "weather_condition_enc", "event_type_enc", "season_enc"],
    "fe_weather_severity": ["weather_severity_index"],
    "fe_interactions": ["feels_like_impact", "event_impact_score", "congestion_weather_combo"],
    "fe_zscore": _Z,
    "fe_minmax": _MM,
}


def _bind(key, cols):
    @register(key, _x(cols))
    def q(spark, sf):
        return _sel(spark, sf, cols)
    q.__name__ = key
    return q


for _k, _c in _FE.items():
    _bind(_k, _c)


@register("jn_station_features", _x(["origin_station", "station_avg_dep_delay", "station_delay_rate"]))
def jn_station_features(spark, sf):
    return _sel(spark, sf, ["origin_station", "station_avg_dep_delay", "station_delay_rate"])


@register("jn_route_features", _x(["route_id", "route_avg_delay", "route_delay_rate"]))
def jn_route_features(spark, sf):
    """Route stats joined with the suffix rule (no clash → no suffix)."""
    df = cleaned(spark, sf)
    rt = FE.settled(FE.route_stats(df), "route_id")
    out = FE.join_back(df, rt, "route_id", ["route_avg_delay", "route_delay_rate"], ("_station", "_route"))
    return out.select("trip_id", "route_id", "route_avg_delay", "route_delay_rate")


@register("fe_dictionary")
def fe_dictionary(spark, sf):
    df = transformed(spark, sf)
    rows = [(c, t, FE.feature_source(c)) for c, t in df.dtypes if c != "ingest_seq"]
    return spark.createDataFrame(rows, "Column string, Type string, Source string")


@register("fe_delay_rule", with_trips(
    "SELECT trip_id, ingest_seq, CAST(date_diff('second', CAST('2000-01-01 ' || scheduled_departure AS TIMESTAMP), "
    "CAST('2000-01-01 ' || time AS TIMESTAMP)) AS DOUBLE) / 60.0 + actual_departure_delay_min AS delay_min, "
    "CASE WHEN actual_arrival_delay_min > 5 THEN 1 ELSE 0 END AS is_delayed FROM trips"))
def fe_delay_rule(spark, sf):
    """delay = actual − scheduled minutes; delayed when > 5."""
    df = trips(spark, sf)
    sched = S.timestamp_of(F.lit("2000-01-01"), F.col("scheduled_departure"))
    actual = S.timestamp_of(F.lit("2000-01-01"), F.col("time"))
    return df.select("trip_id", "ingest_seq",
                     (S.duration_minutes(sched, actual) + F.col("actual_departure_delay_min")).alias("delay_min"),
                     F.when(F.col("actual_arrival_delay_min") > 5, 1).otherwise(0).alias("is_delayed"))


@register("fe_peak_rule", with_xform(
    "SELECT trip_id, CASE WHEN hour IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS is_peak FROM transformed"))
def fe_peak_rule(spark, sf):
    return transformed(spark, sf).select("trip_id", F.when(F.col("hour").isin(7, 8, 9, 16, 17, 18), 1).otherwise(0).alias("is_peak"))


_OH = ["A", "N", "R"]


@register("fe_one_hot", with_clean(
    "SELECT trip_id, " + ", ".join(f"CASE WHEN transport_type = '{v}' THEN 1 ELSE 0 END AS transport_type_{v}" for v in _OH[1:])
    + " FROM cleaned"))
def fe_one_hot(spark, sf):
    """dummyVars with the first level dropped; levels found by one distinct
    aggregate (sorted), the indicator columns are plain expressions."""
    df = cleaned(spark, sf)
    levels = sorted(r[0] for r in df.select("transport_type").distinct().where(F.col("transport_type").isNotNull()).collect())
    return df.select("trip_id", *[F.when(F.col("transport_type") == v, 1).otherwise(0).alias(f"transport_type_{v}")
                                  for v in levels[1:]])


# ---------------------------------------------------------------- scalar keys

@register("sc_datetime_parse", with_trips(
    "SELECT trip_id, ingest_seq, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS datetime FROM trips"))
def sc_datetime_parse(spark, sf):
    return trips(spark, sf).select("trip_id", "ingest_seq", S.timestamp_of("date", "time").alias("datetime"))


@register("sc_date_parts", with_trips(
    "SELECT trip_id, ingest_seq, CAST(month(date) AS INT) AS month, dayname(date) AS day_name, "
    "CAST(hour(CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP)) AS INT) AS hour, CAST(year(date) AS INT) AS year, "
    "CAST(date_trunc('hour', CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP)) AS TIMESTAMP) AS hour_start, "
    "strftime(date, '%a') AS wday_label FROM trips"))
def sc_date_parts(spark, sf):
    df = trips(spark, sf)
    ts = S.timestamp_of("date", "time")
    return df.select("trip_id", "ingest_seq", F.month("date").alias("month"), S.day_name("date").alias("day_name"),
                     F.hour(ts).alias("hour"), F.year("date").alias("year"),
                     F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"),
                     F.date_format("date", "E").alias("wday_label"))


@register("sc_week_of_year", with_trips(
    "SELECT trip_id, ingest_seq, date, CAST(floor((dayofyear(date) - 1) / 7) + 1 AS INT) AS week_of_year FROM trips"))
def sc_week_of_year(spark, sf):
    return trips(spark, sf).select("trip_id", "ingest_seq", "date", S.r_week_of_year("date").alias("week_of_year"))


@register("sc_duration_minutes", with_xform(
    "SELECT trip_id, CAST(date_diff('second', sched_dep_datetime, sched_arr_datetime) AS DOUBLE) / 60.0 AS minutes FROM transformed"))
def sc_duration_minutes(spark, sf):
    return transformed(spark, sf).select("trip_id", S.duration_minutes("sched_dep_datetime", "sched_arr_datetime").alias("minutes"))


_RULES = [(r"^Station_1", "low-numbered"), (r"^Station_2", "twenties"), (r"_[3-9]$", "single-digit-high")]


@register("sc_regex_category", with_trips(
    "SELECT origin_station, CASE WHEN regexp_matches(origin_station, '^Station_1') THEN 'low-numbered' "
    "WHEN regexp_matches(origin_station, '^Station_2') THEN 'twenties' WHEN regexp_matches(origin_station, '_[3-9]$') "
    "THEN 'single-digit-high' ELSE 'other' END AS category, regexp_replace(origin_station, 'Station_', 'S') AS short_name, "
    "count(*) AS n FROM trips GROUP BY origin_station"))
def sc_regex_category(spark, sf):
    df = trips(spark, sf)
    g = df.groupBy("origin_station").agg(F.count("*").alias("n"))
    return g.select("origin_station", S.regex_category("origin_station", _RULES).alias("category"),
                    F.regexp_replace("origin_station", "Station_", "S").alias("short_name"), "n")


@register("sc_regex_name_split", with_trips(
    "SELECT name, regexp_extract(name, '^(.*)_([^_]+)$', 1) AS Column, regexp_extract(name, '^(.*)_([^_]+)$', 2) AS Stat FROM "
    "(SELECT DISTINCT origin_station || '_' || lower(transport_type) AS name FROM trips WHERE transport_type IS NOT NULL)"))
def sc_regex_name_split(spark, sf):
    df = trips(spark, sf).where(F.col("transport_type").isNotNull()).select(
        F.concat_ws("_", "origin_station", F.lower("transport_type")).alias("name")).distinct()
    a, b = S.split_last_underscore("name")
    return df.select("name", a.alias("Column"), b.alias("Stat"))


@register("sc_label_lookup", with_clean(
    "SELECT trip_id, CASE weather_condition WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 "
    "WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS weather_code, CASE route_id WHEN 'Brand#11' THEN 1 END AS route_code FROM cleaned"))
def sc_label_lookup(spark, sf):
    from ..sources.fixtures import WEATHER_MAP
    df = cleaned(spark, sf)
    return df.select("trip_id", S.label_lookup("weather_condition", WEATHER_MAP).alias("weather_code"),
                     S.label_lookup("route_id", {"Brand#11": 1}).alias("route_code"))


@register("sc_clip", with_trips(
    "SELECT trip_id, ingest_seq, CASE WHEN actual_arrival_delay_min IS NULL THEN NULL ELSE greatest(least(actual_arrival_delay_min, 20.0), 0.0) END AS clipped, "
    "round(abs(actual_departure_delay_min), 2) + 0.0 AS abs_dep, CAST(ceil(sqrt(abs(actual_departure_delay_min))) AS DOUBLE) AS ceil_sqrt FROM trips"))
def sc_clip(spark, sf):
    df = trips(spark, sf)
    return df.select("trip_id", "ingest_seq", S.clip("actual_arrival_delay_min", 0.0, 20.0).alias("clipped"),
                     r_round(F.abs("actual_departure_delay_min"), 2).alias("abs_dep"),
                     F.ceil(F.sqrt(F.abs("actual_departure_delay_min"))).cast("double").alias("ceil_sqrt"))


@register("prj_time_bucket", with_xform("SELECT trip_id, hour, time_of_day_bucket FROM transformed"))
def prj_time_bucket(spark, sf):
    df = transformed(spark, sf)
    return df.select("trip_id", "hour", S.time_bucket("hour").alias("time_of_day_bucket"))


@register("prj_bi_extract", with_xform(
    "SELECT trip_id, date, hour, transport_type, route_id, origin_station, destination_station, actual_departure_delay_min, "
    "actual_arrival_delay_min, weather_condition, temperature_C, precipitation_mm, event_type, event_attendance_est, "
    "traffic_congestion_index, holiday, peak_hour, weekday, season, delayed, total_delay, delay_change, time_of_day_bucket, "
    "is_weekend, weather_severity_index, event_impact_score FROM transformed"))
def prj_bi_extract(spark, sf):
    from ..operators.report import BI_COLUMNS
    return transformed(spark, sf).select(*BI_COLUMNS)
