"""Data-quality operators: required-key filters, imputation, de-duplication,
IQR winsorization, consistency flags and the step audit log.

Every statistic is computed in ONE distributed pass for all columns and
applied as a literal (a scalar parameter), so the fact table is never joined
or re-shuffled to impute or cap it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import exact_medians, exact_quantiles, first_seen_mode, r_round

# The column groups of the reference's cleaning phase, in its order.
TRIP_COLUMNS = [
    "trip_id", "date", "time", "transport_type", "route_id", "origin_station",
    "destination_station", "scheduled_departure", "scheduled_arrival",
    "actual_departure_delay_min", "actual_arrival_delay_min", "weather_condition",
    "temperature_C", "humidity_percent", "wind_speed_kmh", "precipitation_mm", "event_type",
    "event_attendance_est", "traffic_congestion_index", "holiday", "peak_hour", "weekday",
    "season", "delayed",
]
MEDIAN_COLS = ["temperature_C", "humidity_percent", "wind_speed_kmh", "precipitation_mm",
               "event_attendance_est", "traffic_congestion_index",
               "actual_departure_delay_min", "actual_arrival_delay_min"]
LABEL_MODE_COLS = ["transport_type", "weather_condition", "event_type", "season", "route_id",
                   "origin_station", "destination_station", "holiday", "peak_hour", "delayed",
                   "weekday"]
TIME_MODE_COLS = ["time", "scheduled_departure", "scheduled_arrival"]
MODE_COLS = LABEL_MODE_COLS + TIME_MODE_COLS
OUTLIER_COLS = ["actual_departure_delay_min", "actual_arrival_delay_min", "temperature_C",
                "humidity_percent", "wind_speed_kmh", "precipitation_mm",
                "traffic_congestion_index", "event_attendance_est"]
ORDER_COLS = ["ingest_seq", "event_attendance_est"]
DELAY_COLS = ["actual_departure_delay_min", "actual_arrival_delay_min"]


# ---------------------------------------------------------------- filters

def drop_missing_keys(df: DataFrame, keys=("trip_id",)) -> DataFrame:
    return df.dropna(how="any", subset=list(keys))


def drop_all_null(df: DataFrame, cols=tuple(DELAY_COLS)) -> DataFrame:
    return df.dropna(how="all", subset=list(cols))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=cols)


# ---------------------------------------------------------------- imputation

def impute_median(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    med = exact_medians(df, cols)
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType))
                          for c in cols if med[c] is not None})
    return out, med


def impute_mode(df: DataFrame, cols: list[str], order_cols=ORDER_COLS) -> tuple[DataFrame, dict]:
    modes = first_seen_mode(df, cols, order_cols)
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c]).cast(df.schema[c].dataType))
                          for c in cols if modes[c] is not None})
    return out, modes


# ---------------------------------------------------------------- duplicates

def dedup_rows(df: DataFrame, cols: list[str], order_cols=("ingest_seq",)) -> DataFrame:
    """Full-row distinct over ``cols`` keeping the earliest file position.

    A sorted aggregate with map-side combine: a hot duplicate group collapses
    on each executor before the shuffle, at the price of sorting the rows.
    """
    extra = [c for c in order_cols if c not in cols]
    if not extra:
        return df.select(*cols).distinct()
    g = df.groupBy(*cols).agg(F.min(F.struct(*extra)).alias("__o"))
    return g.select(*cols, *[F.col(f"__o.{c}").alias(c) for c in extra]).select(*df.columns)


def dedup_key(df: DataFrame, key: str, order_cols=ORDER_COLS) -> DataFrame:
    """Keep the first row per key in ``order_cols`` order (slice(1) per group).

    ``min_by`` instead of a row_number window: partial aggregation (sorted,
    since the buffer is a struct) shrinks a hot key to one row per executor
    before shuffling.
    """
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("__r"))
    return g.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def duplicate_counts(df: DataFrame, cols: list[str], key: str = "trip_id") -> DataFrame:
    """(full_row_duplicates, key_duplicates) — rows beyond the first of each group."""
    full = df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    keyd = df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return full.select(F.col("n").cast("long").alias("full_row_duplicates")).crossJoin(
        keyd.select(F.col("n").cast("long").alias("key_duplicates")))


# ---------------------------------------------------------------- outliers

def outlier_bounds(df: DataFrame, cols: list[str], k: float = 1.5) -> list[dict]:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    out = []
    for c in cols:
        q1, q3 = q[c]
        iqr = q3 - q1
        out.append({"Column": c, "Q1": q1, "Q3": q3, "lower": q1 - k * iqr, "upper": q3 + k * iqr})
    return out


def outlier_log(df: DataFrame, bounds: list[dict]) -> DataFrame:
    """Column, Outliers_Detected, Lower_Bound, Upper_Bound — counted in one pass."""
    aggs = [F.count_if((F.col(b["Column"]) < b["lower"]) | (F.col(b["Column"]) > b["upper"]))
            .alias(f"n{i}") for i, b in enumerate(bounds)]
    counts = df.agg(*aggs)
    stack = ", ".join(
        f"'{b['Column']}', n{i}, CAST({b['lower']!r} AS DOUBLE), CAST({b['upper']!r} AS DOUBLE)"
        for i, b in enumerate(bounds))
    return counts.selectExpr(
        f"stack({len(bounds)}, {stack}) AS (Column, Outliers_Detected, Lower_Bound, Upper_Bound)"
    ).select("Column", F.col("Outliers_Detected").cast("long").alias("Outliers_Detected"),
             r_round(F.col("Lower_Bound"), 2).alias("Lower_Bound"),
             r_round(F.col("Upper_Bound"), 2).alias("Upper_Bound"))


def winsorize(df: DataFrame, bounds: list[dict]) -> DataFrame:
    # least/greatest skip NULL in Spark: keep NULL as NULL explicitly
    return df.withColumns({
        b["Column"]: F.when(F.col(b["Column"]).isNull(), None).otherwise(
            F.greatest(F.least(F.col(b["Column"]), F.lit(b["upper"])), F.lit(b["lower"])))
        for b in bounds})


# ---------------------------------------------------------------- flags / checks

def circular_flag(df: DataFrame, a="origin_station", b="destination_station",
                  name="is_circular_trip") -> DataFrame:
    return df.withColumn(name, F.when(F.col(a) == F.col(b), 1).otherwise(0))


def cap_and_flag(df: DataFrame, bounds: list[dict]) -> DataFrame:
    """The clean stage's last steps: IQR capping and the circular flag."""
    return circular_flag(winsorize(df, bounds))


def sanity_counts(df: DataFrame) -> DataFrame:
    """Conditional counts of the profile and consistency checks."""
    return df.agg(
        F.count_if(F.col("origin_station") == F.col("destination_station")).alias("circular"),
        F.count_if(F.col("actual_departure_delay_min") < 0).alias("early_departures"),
        F.count_if(F.col("actual_arrival_delay_min") < 0).alias("early_arrivals"),
        F.count_if((F.col("actual_departure_delay_min") > 10) & (F.col("delayed") == 0))
        .alias("high_dep_not_delayed"),
        F.count_if(F.col("scheduled_arrival") < F.col("scheduled_departure")).alias("overnight"),
    )


# Plausible domain per measured column (lower, upper; None = open).
DOMAIN_BOUNDS = [
    ("humidity_percent", 0.0, 100.0),
    ("precipitation_mm", 0.0, None),
    ("wind_speed_kmh", 0.0, None),
    ("traffic_congestion_index", 0.0, 100.0),
    ("event_attendance_est", 0.0, None),
    ("temperature_C", -50.0, 60.0),
]


def domain_violations(df: DataFrame, bounds=DOMAIN_BOUNDS) -> DataFrame:
    aggs = []
    for i, (c, lo, hi) in enumerate(bounds):
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (F.col(c) < lo)
        if hi is not None:
            cond = cond | (F.col(c) > hi)
        aggs.append(F.count_if(cond).alias(f"v{i}"))
    stack = ", ".join(f"'{c}', v{i}" for i, (c, _, _) in enumerate(bounds))
    return df.agg(*aggs).selectExpr(f"stack({len(bounds)}, {stack}) AS (Column, Violations)")


def peak_consistency(df: DataFrame) -> DataFrame:
    hour = F.substring("scheduled_departure", 1, 2).cast("int")
    in_peak = hour.isin(7, 8, 9, 16, 17, 18, 19)
    return df.agg(F.count_if((F.col("peak_hour") == 1) & ~in_peak).alias("peak_outside_window"),
                  F.count_if((F.col("peak_hour") == 0) & in_peak).alias("offpeak_inside_window"))


# ---------------------------------------------------------------- the clean stage

@dataclass
class CleanResult:
    df: DataFrame
    medians: dict
    modes: dict
    bounds: list
    counts: dict = field(default_factory=dict)


def _checkpoint(df: DataFrame, name: str) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def clean(df: DataFrame, key: str = "trip_id", stage=_checkpoint) -> CleanResult:
    """Phase-2 pipeline: keys → impute → dates → impute times → dedup →
    winsorize → circular flag.  Medians and the modes of labels, flags and
    weekday are taken before rows without a date go, the modes of times after.

    The statistics (medians, modes, IQR bounds) need several passes over
    their input, so the two inputs they read are materialised once with
    ``stage(df, name)`` (reliable checkpoint by default; the stage module
    writes Parquet to the shared folder, save what is a filter of one already
    there) instead of re-running the source joins for every pass.
    """
    counts = {}
    raw = df
    t1 = stage(drop_all_null(drop_missing_keys(df, (key,)), DELAY_COLS), "keys")
    t2, med = impute_median(t1, MEDIAN_COLS)
    t3, modes = impute_mode(t2, [c for c in LABEL_MODE_COLS if c in t2.columns])
    t3, times = impute_mode(t3.dropna(subset=["date"]), [c for c in TIME_MODE_COLS if c in t3.columns])
    modes = modes | times
    # equal rows have equal keys, so the first row of each key is also the first of its equals: one pass does for both
    t4 = stage(dedup_key(t3, key), "dedup")
    bounds = outlier_bounds(t4, OUTLIER_COLS)
    t5 = cap_and_flag(t4, bounds)
    counts["raw"] = raw
    return CleanResult(df=t5, medians=med, modes=modes, bounds=bounds, counts=counts)


def audit_log(raw: DataFrame, after_missing: DataFrame, after_dedup: DataFrame) -> DataFrame:
    """Step, Records_Before, Records_After, Records_Changed, Method (6 rows)."""
    n = raw.agg(F.count("*").alias("n"))
    m = after_missing.agg(F.count("*").alias("m"))
    d = after_dedup.agg(F.count("*").alias("d"))
    c = n.crossJoin(m).crossJoin(d)
    # The steps and methods of the log.
    rows = [
        (1, "Raw data loaded", "n", "n", "—"),
        (2, "Missing values handled", "n", "m", "Median/Mode imputation + Drop"),
        (3, "Duplicates removed", "m", "d", "distinct() + first occurrence"),
        (4, "Outliers capped", "d", "d", "IQR winsorization"),
        (5, "Logical consistency validated", "d", "d", "Flag circular trips"),
        (6, "Final clean dataset", "n", "d", "All above steps combined"),
    ]
    stack = ", ".join(f"{i}, '{s}', {b}, {a}, '{mth}'" for i, s, b, a, mth in rows)
    return c.selectExpr(f"stack(6, {stack}) AS (step_no, Step, Records_Before, Records_After, Method)") \
        .select("step_no", "Step", F.col("Records_Before").cast("long").alias("Records_Before"),
                F.col("Records_After").cast("long").alias("Records_After"),
                (F.col("Records_Before") - F.col("Records_After")).cast("long").alias("Records_Changed"),
                "Method")


def type_conform(df: DataFrame, spec: dict[str, T.DataType]) -> DataFrame:
    """try_cast every column to its declared type (bad text → NULL)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t.simpleString()})") for c, t in spec.items()})


def type_report(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, t in df.dtypes], "Column string, Type string")
