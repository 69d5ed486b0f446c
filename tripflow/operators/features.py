"""Feature engineering (phase 3): timestamps, temporal parts, delay features,
label encodings, weather/interaction scores, group statistics joined back,
z-score and min-max twins.

Global statistics are one-row aggregates cross-joined as broadcasts (size
proven: one row), so each becomes a projection inside whole-stage codegen;
group statistics are aggregated once, settled by a checkpoint and joined on the
group key (broadcast when measured to be small, else a shuffle join).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (day_name, duration_minutes, label_lookup, r_week_of_year,
                                timestamp_of, time_bucket)
from ..functions.stats import exact_medians, r_round
from ..session import ensure_checkpoint_dir

# Rows and key bytes up to which group statistics are broadcast.
SMALL_ROWS, SMALL_BYTES = 50_000, 4 << 20

# The 15 columns that get _z and _mm twins, in the reference's order.
SCALE_COLS = ["actual_departure_delay_min", "actual_arrival_delay_min", "temperature_C",
              "humidity_percent", "wind_speed_kmh", "precipitation_mm", "event_attendance_est",
              "traffic_congestion_index", "total_delay", "delay_change", "trip_duration_scheduled",
              "weather_severity_index", "feels_like_impact", "event_impact_score",
              "congestion_weather_combo"]

# The trip schema's label codes (weather by severity) and the
# weather conditions that count as a storm.
TRANSPORT_MAP = {"Bus": 1, "Metro": 2, "Train": 3, "Tram": 4}
WEATHER_MAP = {"Clear": 1, "Cloudy": 2, "Fog": 3, "Rain": 4, "Snow": 5, "Storm": 6}
EVENT_MAP = {"None": 0, "Concert": 1, "Festival": 2, "Parade": 3, "Protest": 4, "Sports": 5}
SEASON_MAP = {"Winter": 1, "Spring": 2, "Summer": 3, "Autumn": 4}
STORM_VALUES = ("Storm", "Snow")


@dataclass(frozen=True)
class LabelMaps:
    """The value maps of a trips table; the defaults are the trip schema's own."""

    transport: dict = field(default_factory=lambda: TRANSPORT_MAP)
    weather: dict = field(default_factory=lambda: WEATHER_MAP)
    event: dict = field(default_factory=lambda: EVENT_MAP)
    season: dict = field(default_factory=lambda: SEASON_MAP)
    storm: tuple = STORM_VALUES


def add_datetimes(df: DataFrame) -> DataFrame:
    dep = timestamp_of("date", "scheduled_departure")
    arr = timestamp_of("date", "scheduled_arrival")
    rolled = F.when(arr < dep, arr + F.expr("INTERVAL 1 DAY")).otherwise(arr)
    return df.withColumns({"datetime": timestamp_of("date", "time"),
                           "sched_dep_datetime": dep, "sched_arr_datetime": rolled})


def add_temporal(df: DataFrame) -> DataFrame:
    hour = F.hour("datetime")
    return df.withColumns({
        "hour": hour,
        "day_name": day_name("date"),
        "is_weekend": F.when(F.col("weekday").isin(0, 6), 1).otherwise(0),
        "month": F.month("date"),
        "week_of_year": r_week_of_year("date"),
        "time_of_day_bucket": time_bucket(hour),
    })


def add_delay_features(df: DataFrame, repair_duration: bool = True) -> DataFrame:
    dep, arr = F.col("actual_departure_delay_min"), F.col("actual_arrival_delay_min")
    out = df.withColumns({
        "total_delay": dep + arr,
        "delay_change": arr - dep,
        "is_early_departure": F.when(dep < 0, 1).when(dep.isNotNull(), 0),
        "is_early_arrival": F.when(arr < 0, 1).when(arr.isNotNull(), 0),
        "trip_duration_scheduled": duration_minutes("sched_dep_datetime", "sched_arr_datetime"),
        "severe_delay": F.when(arr > 15, 1).when(arr.isNotNull(), 0),
    })
    if repair_duration:
        out = repair_nonpositive(out, "trip_duration_scheduled")
    return out


def repair_nonpositive(df: DataFrame, col: str) -> DataFrame:
    """NULL or <= 0 → median of the column (the median includes the bad values)."""
    med = exact_medians(df, [col])[col]
    bad = F.col(col).isNull() | (F.col(col) <= 0)
    return df.withColumn(col, F.when(bad, F.lit(med)).otherwise(F.col(col)))


def add_label_encodings(df: DataFrame, transport=TRANSPORT_MAP, weather=WEATHER_MAP,
                        event=EVENT_MAP, season=SEASON_MAP) -> DataFrame:
    return df.withColumns({
        "transport_type_enc": label_lookup("transport_type", transport),
        "weather_condition_enc": label_lookup("weather_condition", weather),
        "event_type_enc": label_lookup("event_type", event),
        "season_enc": label_lookup("season", season),
    })


def add_weather_scores(df: DataFrame, storm_values=STORM_VALUES) -> DataFrame:
    mx = F.broadcast(df.agg(F.max("wind_speed_kmh").alias("__mw"),
                            F.max(F.col("precipitation_mm") + 0.01).alias("__mp")))
    storm = F.when(F.col("weather_condition").isin(*storm_values), 1.0).otherwise(0.0)
    # a maximum of 0 leaves the ratio without a value, as does a missing one
    sev = r_round(0.3 * F.try_divide("wind_speed_kmh", "__mw")
                  + 0.4 * F.try_divide("precipitation_mm", "__mp") + 0.3 * storm, 4)
    return df.crossJoin(mx).withColumn("weather_severity_index", sev).drop("__mw", "__mp")


def add_interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "feels_like_impact": r_round(F.col("temperature_C") * F.col("wind_speed_kmh") / 100, 4),
        "event_impact_score": r_round(F.col("event_attendance_est") * F.col("traffic_congestion_index") / 1000, 4),
        "congestion_weather_combo": r_round(F.col("traffic_congestion_index") * F.col("weather_severity_index"), 4),
    })


def rate100(c: str = "delayed") -> Column:
    return F.avg(F.col(c).cast("double")) * 100


def station_stats(df: DataFrame, key: str = "origin_station") -> DataFrame:
    return df.groupBy(key).agg(
        r_round(F.avg("actual_departure_delay_min"), 2).alias("station_avg_dep_delay"),
        r_round(F.avg("actual_arrival_delay_min"), 2).alias("station_avg_arr_delay"),
        r_round(rate100(), 2).alias("station_delay_rate"),
        F.count("*").alias("station_total_trips"),
        r_round(F.stddev_samp("actual_arrival_delay_min"), 2).alias("station_sd_delay"),
        F.max("actual_arrival_delay_min").alias("station_max_delay"),
    )


def route_stats(df: DataFrame, key: str = "route_id") -> DataFrame:
    return df.groupBy(key).agg(
        r_round(F.avg("actual_arrival_delay_min"), 2).alias("route_avg_delay"),
        r_round(rate100(), 2).alias("route_delay_rate"),
        F.count("*").alias("route_total_trips"),
        r_round(F.stddev_samp("actual_arrival_delay_min"), 2).alias("route_delay_variability"),
    )


def settled(stats: DataFrame, key: str) -> DataFrame:
    """Group statistics computed once, before the rows they are joined back to; marked for broadcast if they are measured
    to be small, so that the rows aren't shuffled for a join that turns out small only after their shuffle."""
    ensure_checkpoint_dir(stats.sparkSession)
    done = stats.checkpoint()
    n, size = done.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).first()
    return F.broadcast(done) if n <= SMALL_ROWS and size <= SMALL_BYTES else done


def join_back(df: DataFrame, stats: DataFrame, key: str, cols: list[str],
              suffixes=("_x", "_y")) -> DataFrame:
    """Left join group statistics onto the fact table; suffix only clashing names."""
    right = stats.select(key, *cols)
    clash = [c for c in cols if c in df.columns]
    if clash:
        df = df.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return df.join(right, key, "left")


def scaling_params(df: DataFrame, cols=SCALE_COLS) -> DataFrame:
    """One pass: mean, sd, min, max per column, long form (rounded 4)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(F.col(c).cast("double")).alias(f"l{i}"), F.max(F.col(c).cast("double")).alias(f"h{i}")]
    stack = ", ".join(f"'{c}', a{i}, s{i}, l{i}, h{i}" for i, c in enumerate(cols))
    long = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) AS (Column, Mean, SD, Min, Max)")
    return long.select("Column", *[r_round(F.col(c), 4).alias(c) for c in ("Mean", "SD", "Min", "Max")])


def add_scaled(df: DataFrame, cols=SCALE_COLS, zscore: bool = True, minmax: bool = True) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"__a{i}"), F.stddev_samp(c).alias(f"__s{i}"),
                 F.min(c).alias(f"__l{i}"), F.max(c).alias(f"__h{i}")]
    params = F.broadcast(df.agg(*aggs))
    out = df.crossJoin(params)
    new = {}
    if zscore:
        for i, c in enumerate(cols):
            s = F.col(f"__s{i}")
            new[f"{c}_z"] = F.when(s > 0, r_round((F.col(c) - F.col(f"__a{i}")) / s, 4)).otherwise(F.lit(0.0))
    if minmax:
        for i, c in enumerate(cols):
            rng = F.col(f"__h{i}") - F.col(f"__l{i}")
            new[f"{c}_mm"] = F.when(rng > 0, r_round((F.col(c) - F.col(f"__l{i}")) / rng, 4)).otherwise(F.lit(0.0))
    return out.withColumns(new).drop(*[c for c in out.columns if c.startswith("__")])


def transform(cleaned: DataFrame, maps: LabelMaps = LabelMaps()) -> DataFrame:
    """Cleaned table → the 82-column transformed table (+ ingest_seq)."""
    df = add_datetimes(cleaned)
    df = add_temporal(df)
    df = add_delay_features(df)
    df = add_label_encodings(df, maps.transport, maps.weather, maps.event, maps.season)
    df = add_weather_scores(df, maps.storm)
    df = add_interactions(df)
    st, rt = settled(station_stats(df), "origin_station"), settled(route_stats(df), "route_id")
    df = join_back(df, st, "origin_station", ["station_avg_dep_delay", "station_delay_rate"])
    df = join_back(df, rt, "route_id", ["route_avg_delay", "route_delay_rate"], ("_station", "_route"))
    return add_scaled(df)


def feature_source(col: str) -> str:
    from .quality import TRIP_COLUMNS
    if col in TRIP_COLUMNS:
        return "Original"
    if col.endswith("_z"):
        return "Z-score normalization"
    if col.endswith("_mm"):
        return "Min-Max normalization"
    if col.endswith("_enc"):
        return "Label encoding"
    if col in ("station_avg_dep_delay", "station_delay_rate"):
        return "Station aggregation"
    if col in ("route_avg_delay", "route_delay_rate_route"):
        return "Route aggregation"
    return "Feature engineering"
