"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import quality as Q
from .stages import raw_trips as trips
from .oracle_ctes import clean_ctes, with_clean, with_trips
from .registry import register
from .stages import clean_result, cleaned

_MED_SQL = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in Q.MEDIAN_COLS)


def _after_keys(spark, sf):
    return Q.drop_all_null(Q.drop_missing_keys(trips(spark, sf)), Q.DELAY_COLS).dropna(subset=["date"])


def _deduped(spark, sf):
    """The clean stage up to de-duplication (read from its Parquet stage)."""
    from .stages import deduped
    return deduped(spark, sf)


@register("flt_required_keys", with_trips(
    "SELECT count(*) AS n FROM trips WHERE trip_id IS NOT NULL AND date IS NOT NULL AND origin_station IS NOT NULL "
    "AND route_id IS NOT NULL"))
def flt_required_keys(spark, sf):
    return Q.drop_missing_keys(trips(spark, sf), ("trip_id", "date", "origin_station", "route_id")).agg(
        F.count("*").alias("n"))


@register("flt_both_delays_null", with_trips(
    "SELECT count(*) AS n FROM trips WHERE NOT (actual_departure_delay_min IS NULL AND actual_arrival_delay_min IS NULL)"))
def flt_both_delays_null(spark, sf):
    return Q.drop_all_null(trips(spark, sf)).agg(F.count("*").alias("n"))


@register("flt_complete_cases", with_trips(
    "SELECT trip_id, ingest_seq, actual_departure_delay_min, actual_arrival_delay_min, traffic_congestion_index, weather_condition "
    "FROM trips WHERE trip_id IS NOT NULL AND actual_departure_delay_min IS NOT NULL AND actual_arrival_delay_min IS NOT NULL "
    "AND traffic_congestion_index IS NOT NULL AND weather_condition IS NOT NULL"))
def flt_complete_cases(spark, sf):
    cols = ["trip_id", "ingest_seq", "actual_departure_delay_min", "actual_arrival_delay_min",
            "traffic_congestion_index", "weather_condition"]
    return Q.complete_cases(trips(spark, sf).select(*cols), cols)


@register("flt_valid_range", with_trips(
    "SELECT trip_id, ingest_seq, actual_arrival_delay_min FROM trips WHERE actual_arrival_delay_min BETWEEN -10 AND 180"))
def flt_valid_range(spark, sf):
    return trips(spark, sf).where(F.col("actual_arrival_delay_min").between(-10, 180)).select(
        "trip_id", "ingest_seq", "actual_arrival_delay_min")


@register("dq_impute_median", with_trips(
    f", c1 AS (SELECT * FROM trips WHERE trip_id IS NOT NULL AND NOT (actual_departure_delay_min IS NULL "
    f"AND actual_arrival_delay_min IS NULL)) SELECT * FROM (SELECT {_MED_SQL} FROM c1) UNPIVOT (median FOR \"Column\" IN "
    f"({', '.join(Q.MEDIAN_COLS)}))"))
def dq_impute_median(spark, sf):
    """The imputation values (global medians, exact) as a long table."""
    res = clean_result(spark, sf)
    return spark.createDataFrame([(c, float(res.medians[c])) for c in Q.MEDIAN_COLS], "Column string, median double")


def _mode_union():
    from .oracle_ctes import LABEL_COLS, TIME_COLS, _mode_sql
    return " UNION ALL ".join(f"SELECT '{c}' AS Column, CAST({_mode_sql(c, src)} AS VARCHAR) AS mode"
                              for cols, src in ((LABEL_COLS, "c1"), (TIME_COLS, "c1d")) for c in cols)


@register("dq_impute_mode", with_trips(
    ", c1 AS (SELECT * FROM trips WHERE trip_id IS NOT NULL AND NOT (actual_departure_delay_min IS NULL "
    "AND actual_arrival_delay_min IS NULL)), c1d AS (SELECT * FROM c1 WHERE date IS NOT NULL) " + _mode_union()))
def dq_impute_mode(spark, sf):
    res = clean_result(spark, sf)
    return spark.createDataFrame([(c, res.modes[c]) for c in Q.MODE_COLS], "Column string, mode string")


def _missing_sql():
    parts = []
    for c in Q.TRIP_COLUMNS:
        parts.append(f"SELECT '{c}' AS Column, (SELECT count(*) - count({c}) FROM trips) AS Missing_Before, "
                     f"(SELECT count(*) - count({c}) FROM cleaned) AS Missing_After")
    return " UNION ALL ".join(parts)


@register("dq_missing_report", with_clean(_missing_sql()))
def dq_missing_report(spark, sf):
    from ..operators.profile import null_counts
    before = null_counts(trips(spark, sf), Q.TRIP_COLUMNS).select("Column", F.col("Missing_Count").alias("Missing_Before"))
    after = null_counts(cleaned(spark, sf), Q.TRIP_COLUMNS).select("Column", F.col("Missing_Count").alias("Missing_After"))
    return before.join(after, "Column")


@register("dq_dedup_rows", with_trips(
    "SELECT count(*) AS n_distinct_rows FROM (SELECT DISTINCT * EXCLUDE (ingest_seq) FROM trips)"))
def dq_dedup_rows(spark, sf):
    df = trips(spark, sf)
    return Q.dedup_rows(df, [c for c in df.columns if c != "ingest_seq"]).agg(F.count("*").alias("n_distinct_rows"))


@register("dq_dedup_key", with_clean(
    "SELECT trip_id, ingest_seq, actual_arrival_delay_min, event_attendance_est FROM c3"))
def dq_dedup_key(spark, sf):
    """Keep-first per trip_id (after imputation), as in the clean stage."""
    d = _deduped(spark, sf)
    return d.select("trip_id", "ingest_seq", "actual_arrival_delay_min", "event_attendance_est")


@register("dq_duplicate_counts", with_trips(
    "SELECT (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM trips GROUP BY "
    + ", ".join(Q.TRIP_COLUMNS) + ")) AS full_row_duplicates, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
    "(SELECT count(*) AS n FROM trips GROUP BY trip_id)) AS key_duplicates"))
def dq_duplicate_counts(spark, sf):
    df = trips(spark, sf)
    return Q.duplicate_counts(df, [c for c in df.columns if c != "ingest_seq"], "trip_id")


def _outlier_sql():
    parts = []
    for c in Q.OUTLIER_COLS:
        parts.append(
            f"SELECT '{c}' AS Column, (SELECT count(*) FROM c3, c_q WHERE {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR "
            f"{c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})) AS Outliers_Detected, "
            f"(SELECT round(q1_{c} - 1.5 * (q3_{c} - q1_{c}), 2) + 0.0 FROM c_q) AS Lower_Bound, "
            f"(SELECT round(q3_{c} + 1.5 * (q3_{c} - q1_{c}), 2) + 0.0 FROM c_q) AS Upper_Bound")
    return " UNION ALL ".join(parts)


@register("dq_outlier_log", with_clean(_outlier_sql()))
def dq_outlier_log(spark, sf):
    res = clean_result(spark, sf)
    return Q.outlier_log(_deduped(spark, sf), res.bounds)


@register("dq_winsorize", with_clean(
    "SELECT trip_id, " + ", ".join(Q.OUTLIER_COLS) + " FROM cleaned"))
def dq_winsorize(spark, sf):
    return cleaned(spark, sf).select("trip_id", *Q.OUTLIER_COLS)


@register("dq_circular_flag", with_clean(
    "SELECT is_circular_trip, count(*) AS n FROM cleaned GROUP BY 1"))
def dq_circular_flag(spark, sf):
    return cleaned(spark, sf).groupBy("is_circular_trip").agg(F.count("*").alias("n"))


@register("dq_audit_log", with_clean(
    ", n AS (SELECT (SELECT count(*) FROM trips) AS n, (SELECT count(*) FROM c2) AS m, (SELECT count(*) FROM c3) AS d) "
    "SELECT step_no, Step, Records_Before, Records_After, Records_Before - Records_After AS Records_Changed, Method FROM "
    "(SELECT 1 AS step_no, 'Raw data loaded' AS Step, n AS Records_Before, n AS Records_After, '—' AS Method FROM n "
    "UNION ALL SELECT 2, 'Missing values handled', n, m, 'Median/Mode imputation + Drop' FROM n "
    "UNION ALL SELECT 3, 'Duplicates removed', m, d, 'distinct() + first occurrence' FROM n "
    "UNION ALL SELECT 4, 'Outliers capped', d, d, 'IQR winsorization' FROM n "
    "UNION ALL SELECT 5, 'Logical consistency validated', d, d, 'Flag circular trips' FROM n "
    "UNION ALL SELECT 6, 'Final clean dataset', n, d, 'All above steps combined' FROM n)"))
def dq_audit_log(spark, sf):
    raw = trips(spark, sf)
    after_missing = _after_keys(spark, sf)
    return Q.audit_log(raw, after_missing, cleaned(spark, sf))


@register("dq_domain_bounds", with_trips(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, count(*) FILTER (WHERE " +
    " OR ".join(x for x in ([f"{c} < {lo}"] if lo is not None else []) + ([f"{c} > {hi}"] if hi is not None else [])) +
    ") AS Violations FROM trips" for c, lo, hi in Q.DOMAIN_BOUNDS)))
def dq_domain_bounds(spark, sf):
    return Q.domain_violations(trips(spark, sf))


@register("dq_peak_consistency", with_trips(
    ", h AS (SELECT peak_hour, CAST(substr(scheduled_departure, 1, 2) AS INT) AS hr FROM trips) "
    "SELECT count(*) FILTER (WHERE peak_hour = 1 AND hr NOT IN (7, 8, 9, 16, 17, 18, 19)) AS peak_outside_window, "
    "count(*) FILTER (WHERE peak_hour = 0 AND hr IN (7, 8, 9, 16, 17, 18, 19)) AS offpeak_inside_window FROM h"))
def dq_peak_consistency(spark, sf):
    return Q.peak_consistency(trips(spark, sf))


@register("prj_type_conform", with_trips(
    "SELECT trip_id, ingest_seq, TRY_CAST(substr(time, 1, 2) AS INTEGER) AS dep_hour, TRY_CAST(trip_id AS INTEGER) AS trip_num, "
    "TRY_CAST(CAST(date AS VARCHAR) AS DATE) AS date FROM trips"))
def prj_type_conform(spark, sf):
    """try_cast conformance: text that does not parse becomes NULL."""
    df = trips(spark, sf).select("trip_id", "ingest_seq", F.substring("time", 1, 2).alias("dep_hour"),
                                 F.col("trip_id").alias("trip_num"), F.col("date").cast("string").alias("date"))
    from pyspark.sql import types as T
    return Q.type_conform(df, {"dep_hour": T.IntegerType(), "trip_num": T.IntegerType(), "date": T.DateType()})


@register("prj_type_report")
def prj_type_report(spark, sf):
    return Q.type_report(spark, cleaned(spark, sf))
