"""Aggregation queries bound to the stage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, first_seen_mode, grouped_quantile, mode_alpha, r_round
from ..operators import aggregate as A
from ..operators.features import route_stats, scaling_params, station_stats
from .stages import raw_trips as trips
from .oracle_ctes import with_clean, with_trips, with_xform
from .registry import register
from .stages import cleaned, transformed

ARR, DEP = A.ARR, A.DEP
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# The columns of the correlation matrix, in its order.
CORR_COLS = ["actual_departure_delay_min", "actual_arrival_delay_min", "temperature_C",
             "humidity_percent", "wind_speed_kmh", "precipitation_mm", "event_attendance_est",
             "traffic_congestion_index", "weekday", "total_delay", "delay_change", "trip_duration_scheduled",
             "weather_severity_index", "event_impact_score"]
# The oracle's own list.
CORR_SQL_COLS = """actual_departure_delay_min actual_arrival_delay_min temperature_C humidity_percent wind_speed_kmh
precipitation_mm event_attendance_est traffic_congestion_index weekday total_delay delay_change trip_duration_scheduled
weather_severity_index event_impact_score""".split()


@register("agg_shape", with_trips(
    "SELECT count(*) AS n_rows, CAST(24 AS INT) AS n_cols FROM trips"))
def agg_shape(spark, sf):
    df = trips(spark, sf)
    n_cols = len([c for c in df.columns if c != "ingest_seq"])  # ingest_seq stands for file order
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(n_cols).cast("int"))


@register("agg_station", with_clean(
    "SELECT origin_station, round(avg(actual_departure_delay_min), 2) + 0.0 AS station_avg_dep_delay, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS station_avg_arr_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS station_delay_rate, count(*) AS station_total_trips, "
    "round(stddev_samp(actual_arrival_delay_min), 2) + 0.0 AS station_sd_delay, "
    "max(actual_arrival_delay_min) AS station_max_delay FROM cleaned GROUP BY origin_station"))
def agg_station(spark, sf):
    return station_stats(cleaned(spark, sf))


@register("agg_route", with_clean(
    "SELECT route_id, round(avg(actual_arrival_delay_min), 2) + 0.0 AS route_avg_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS route_delay_rate, count(*) AS route_total_trips, "
    "round(stddev_samp(actual_arrival_delay_min), 2) + 0.0 AS route_delay_variability FROM cleaned GROUP BY route_id"))
def agg_route(spark, sf):
    return route_stats(cleaned(spark, sf))


@register("agg_hour_weekend", with_xform(
    "SELECT hour, is_weekend, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay_by_hour_day, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate_by_hour_day, count(*) AS trip_count_by_hour_day "
    "FROM transformed GROUP BY hour, is_weekend"))
def agg_hour_weekend(spark, sf):
    df = transformed(spark, sf)
    return df.groupBy("hour", "is_weekend").agg(
        r_round(F.avg(ARR), 2).alias("avg_delay_by_hour_day"),
        r_round(A.delay_rate(), 2).alias("delay_rate_by_hour_day"),
        F.count("*").alias("trip_count_by_hour_day"))


@register("agg_hour_daytype", with_xform(
    "SELECT hour, CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, count(*) AS total_trips, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate FROM transformed GROUP BY 1, 2"))
def agg_hour_daytype(spark, sf):
    df = transformed(spark, sf)
    dt = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("day_type")
    return A.group_delay(df, ["hour", dt])


@register("agg_weather", with_clean(
    "SELECT weather_condition, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate, count(*) AS total_trips "
    "FROM cleaned GROUP BY weather_condition"))
def agg_weather(spark, sf):
    return A.group_delay(cleaned(spark, sf), ["weather_condition"]).orderBy(F.desc("avg_delay"))


@register("agg_event", with_clean(
    "SELECT event_type, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, count(*) AS total_trips "
    "FROM cleaned GROUP BY event_type"))
def agg_event(spark, sf):
    return A.group_delay(cleaned(spark, sf), ["event_type"], with_rate=False).orderBy(F.desc("avg_delay"))


@register("agg_day_rate", with_xform(
    "SELECT day_name, CAST(CASE day_name WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
    "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 ELSE 7 END AS INT) AS day_order, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate, count(*) AS total_trips "
    "FROM transformed GROUP BY day_name"))
def agg_day_rate(spark, sf):
    df = transformed(spark, sf)
    order = F.create_map(*[x for i, d in enumerate(DAY_ORDER) for x in (F.lit(d), F.lit(i + 1))])
    g = df.groupBy("day_name").agg(r_round(A.delay_rate(), 2).alias("delay_rate"), F.count("*").alias("total_trips"))
    return g.withColumn("day_order", order[F.col("day_name")].cast("int")).orderBy("day_order")


@register("agg_daily_trend", with_clean(
    "SELECT date, round(avg(actual_arrival_delay_min), 4) + 0.0 AS avg_delay, count(*) AS total_trips "
    "FROM cleaned GROUP BY date"))
def agg_daily_trend(spark, sf):
    df = cleaned(spark, sf)
    return df.groupBy("date").agg(r_round(F.avg(ARR), 4).alias("avg_delay"), F.count("*").alias("total_trips"))


@register("agg_peak", with_clean(
    "SELECT CASE WHEN peak_hour = 1 THEN 'Peak' ELSE 'Off-Peak' END AS period, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, count(*) AS total_trips, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate FROM cleaned GROUP BY 1"))
def agg_peak(spark, sf):
    df = cleaned(spark, sf)
    return A.group_delay(df, [F.when(F.col("peak_hour") == 1, "Peak").otherwise("Off-Peak").alias("period")])


@register("agg_hour", with_xform(
    "SELECT hour, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, count(*) AS total_trips, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate FROM transformed GROUP BY hour"))
def agg_hour(spark, sf):
    return A.group_delay(transformed(spark, sf), ["hour"]).orderBy("hour")


@register("agg_class_balance", with_trips(
    "SELECT delayed, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) + 0.0 AS pct "
    "FROM trips GROUP BY delayed"))
def agg_class_balance(spark, sf):
    return A.class_balance(trips(spark, sf), "delayed")


_XT = [("transport_type", ["A", "N", "R"]), ("weather_condition", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]),
       ("season", ["Winter", "Spring", "Summer", "Autumn"]), ("peak_hour", [0, 1])]


def _xt_sql():
    parts = []
    for col, vals in _XT:
        cells = ", ".join(f"count(*) FILTER (WHERE {col} = {v!r}) AS n_{i}".replace('"', "'") for i, v in enumerate(vals))
        parts.append(f"SELECT '{col}' AS variable, delayed, {', '.join(f'n_{i}' for i in range(len(vals)))}"
                     f"{''.join(f', CAST(NULL AS BIGINT) AS n_{i}' for i in range(len(vals), 6))} "
                     f"FROM (SELECT delayed, {cells} FROM cleaned GROUP BY delayed)")
    return " UNION ALL ".join(parts)


@register("agg_crosstab", with_clean(_xt_sql()))
def agg_crosstab(spark, sf):
    """delayed × {transport, weather, season, peak}: one pass, pivot by filter."""
    df = cleaned(spark, sf)
    out = None
    for col, vals in _XT:
        cells = [F.count_if(F.col(col) == F.lit(v)).alias(f"n_{i}") for i, v in enumerate(vals)]
        g = df.groupBy("delayed").agg(*cells).select(
            F.lit(col).alias("variable"), "delayed", *[f"n_{i}" for i in range(len(vals))],
            *[F.lit(None).cast("long").alias(f"n_{i}") for i in range(len(vals), 6)])
        out = g if out is None else out.unionByName(g)
    return out


@register("agg_sanity_counts", with_trips(
    "SELECT count(*) FILTER (WHERE origin_station = destination_station) AS circular, "
    "count(*) FILTER (WHERE actual_departure_delay_min < 0) AS early_departures, "
    "count(*) FILTER (WHERE actual_arrival_delay_min < 0) AS early_arrivals, "
    "count(*) FILTER (WHERE actual_departure_delay_min > 10 AND delayed = 0) AS high_dep_not_delayed, "
    "count(*) FILTER (WHERE scheduled_arrival < scheduled_departure) AS overnight FROM trips"))
def agg_sanity_counts(spark, sf):
    from ..operators.quality import sanity_counts
    return sanity_counts(trips(spark, sf))


@register("agg_ranges", with_trips(
    "SELECT min(date) AS min_date, max(date) AS max_date, min(weekday) AS min_weekday, max(weekday) AS max_weekday FROM trips"))
def agg_ranges(spark, sf):
    df = trips(spark, sf)
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                  F.min("weekday").alias("min_weekday"), F.max("weekday").alias("max_weekday"))


_QCOLS = ["actual_departure_delay_min", "actual_arrival_delay_min", "event_attendance_est", "traffic_congestion_index"]


@register("agg_quantiles", with_trips(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM trips" for c in _QCOLS)))
def agg_quantiles(spark, sf):
    return A.quantiles_exact_agg(trips(spark, sf), _QCOLS, [0.25, 0.75])


_MCOLS = ["transport_type", "weather_condition", "event_type", "origin_station", "route_id", "holiday"]


def _mode_sql(c):
    return (f"SELECT '{c}' AS Column, CAST(v AS VARCHAR) AS mode FROM (SELECT {c} AS v, count(*) OVER (PARTITION BY {c}) AS n, "
            f"ingest_seq, event_attendance_est FROM trips WHERE {c} IS NOT NULL ORDER BY n DESC, ingest_seq, "
            "event_attendance_est LIMIT 1)")


@register("agg_mode", with_trips(" UNION ALL ".join(f"SELECT * FROM ({_mode_sql(c)})" for c in _MCOLS)))
def agg_mode(spark, sf):
    modes = first_seen_mode(trips(spark, sf), _MCOLS, ["ingest_seq", "event_attendance_est"])
    return spark.createDataFrame([(c, modes[c]) for c in _MCOLS], "Column string, mode string")


@register("agg_group_mode", with_clean(
    "SELECT origin_station, arg_min(weather_condition, (-n, weather_condition)) AS dominant_weather FROM "
    "(SELECT origin_station, weather_condition, count(*) AS n FROM cleaned GROUP BY 1, 2) GROUP BY origin_station"))
def agg_group_mode(spark, sf):
    return mode_alpha(cleaned(spark, sf), ["origin_station"], "weather_condition", "dominant_weather")


@register("agg_distinct_stations", with_trips(
    "SELECT CAST(count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM "
    "(SELECT origin_station AS v FROM trips UNION ALL SELECT destination_station FROM trips)"))
def agg_distinct_stations(spark, sf):
    return A.distinct_over(trips(spark, sf), ["origin_station", "destination_station"])


def _corr_sql(target: bool = False):
    aggs, parts = [], []
    for i, a in enumerate(CORR_SQL_COLS):
        for j, b in enumerate(CORR_SQL_COLS):
            if j > i:
                aggs.append(f"corr({a}, {b}) AS c_{i}_{j}")
    for i, a in enumerate(CORR_SQL_COLS):
        for j, b in enumerate(CORR_SQL_COLS):
            if target and (b != "actual_arrival_delay_min" or a == b):
                continue
            r = "1.0" if a == b else f"round(c_{min(i, j)}_{max(i, j)}, 6) + 0.0"
            if target:
                parts.append(f"SELECT '{a}' AS variable, CAST({r} AS DOUBLE) AS r FROM cr")
            else:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({r} AS DOUBLE) AS r FROM cr")
    cond = " AND ".join(f"{c} IS NOT NULL" for c in CORR_SQL_COLS)
    return f", cr AS (SELECT {', '.join(aggs)} FROM transformed WHERE {cond}) " + " UNION ALL ".join(parts)


@register("agg_corr_matrix", with_xform(_corr_sql()))
def agg_corr_matrix(spark, sf):
    return A.corr_long(transformed(spark, sf), CORR_COLS)


@register("agg_corr_target", with_xform(_corr_sql(True)))
def agg_corr_target(spark, sf):
    m = A.corr_long(transformed(spark, sf), CORR_COLS)
    return m.where((F.col("var2") == "actual_arrival_delay_min") & (F.col("var1") != "actual_arrival_delay_min")) \
        .select(F.col("var1").alias("variable"), F.col("r").alias("r")).orderBy(F.desc("r"))


@register("agg_zero_variance", with_xform(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, round(var_samp({c}), 6) + 0.0 AS variance, coalesce(var_samp({c}), 0) = 0 AS zero_variance FROM transformed"
    for c in CORR_COLS + ["holiday", "is_circular_trip"])))
def agg_zero_variance(spark, sf):
    return A.variance_table(transformed(spark, sf), CORR_COLS + ["holiday", "is_circular_trip"])


@register("agg_scaling_params", with_xform(" UNION ALL ".join(
    f"SELECT '{c}' AS Column, round(avg({c}), 4) + 0.0 AS Mean, round(stddev_samp({c}), 4) + 0.0 AS SD, "
    f"round(min({c}), 4) + 0.0 AS Min, round(max({c}), 4) + 0.0 AS Max FROM transformed"
    for c in __import__("tripflow.operators.features", fromlist=["SCALE_COLS"]).SCALE_COLS)))
def agg_scaling_params(spark, sf):
    return scaling_params(transformed(spark, sf))


@register("agg_day_hour_pivot", with_xform(
    "SELECT day_name, " + ", ".join(
        f"coalesce(round(avg(actual_arrival_delay_min) FILTER (WHERE hour = {h}), 2) + 0.0, 0.0) AS hour_{h}" for h in range(24))
    + " FROM transformed GROUP BY day_name"))
def agg_day_hour_pivot(spark, sf):
    return A.pivot_mean(transformed(spark, sf), "day_name", "hour", list(range(24)), ARR)


@register("agg_station_hour_pivot", with_xform(
    ", top AS (SELECT origin_station FROM (SELECT origin_station, rank() OVER (ORDER BY count(*) DESC) AS rk "
    "FROM transformed GROUP BY 1) WHERE rk <= 20) SELECT origin_station, " + ", ".join(
        f"coalesce(round(avg(actual_arrival_delay_min) FILTER (WHERE hour = {h}), 2) + 0.0, 0.0) AS hour_{h}" for h in range(24))
    + " FROM transformed SEMI JOIN top USING (origin_station) GROUP BY origin_station"))
def agg_station_hour_pivot(spark, sf):
    from pyspark.sql import Window
    df = transformed(spark, sf)
    top = (df.groupBy("origin_station").count()
           .withColumn("rk", F.rank().over(Window.orderBy(F.desc("count")))).where("rk <= 20"))
    sub = df.join(top.select("origin_station"), "origin_station", "left_semi")
    return A.pivot_mean(sub, "origin_station", "hour", list(range(24)), ARR)


@register("agg_histogram", with_clean(
    ", mm AS (SELECT min(actual_arrival_delay_min) AS lo, max(actual_arrival_delay_min) AS hi FROM cleaned), "
    "b AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((actual_arrival_delay_min - lo) / ((hi - lo) / 50)) + 1, 50) END AS INT) AS bin, lo, hi "
    "FROM cleaned, mm WHERE actual_arrival_delay_min IS NOT NULL) "
    "SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 6) + 0.0 AS bin_lo, round(lo + bin * ((hi - lo) / 50), 6) + 0.0 AS bin_hi, "
    "count(*) AS n FROM b GROUP BY bin, lo, hi"))
def agg_histogram(spark, sf):
    return A.histogram(cleaned(spark, sf), ARR, 50)


@register("agg_boxplot", with_clean(
    ", q AS (SELECT transport_type, count(actual_arrival_delay_min) AS n, min(actual_arrival_delay_min) AS mn, "
    "quantile_cont(actual_arrival_delay_min, 0.25) AS q1, quantile_cont(actual_arrival_delay_min, 0.5) AS md, "
    "quantile_cont(actual_arrival_delay_min, 0.75) AS q3, max(actual_arrival_delay_min) AS mx FROM cleaned GROUP BY 1) "
    "SELECT q.transport_type, n, round(mn, 4) + 0.0 AS min, round(q1, 4) + 0.0 AS q1, round(md, 4) + 0.0 AS median, "
    "round(q3, 4) + 0.0 AS q3, round(mx, 4) + 0.0 AS max, (SELECT count(*) FROM cleaned c WHERE c.transport_type = q.transport_type "
    "AND (actual_arrival_delay_min < q.q1 - 1.5 * (q.q3 - q.q1) OR actual_arrival_delay_min > q.q3 + 1.5 * (q.q3 - q.q1))) AS n_outliers FROM q"))
def agg_boxplot(spark, sf):
    return A.boxplot(cleaned(spark, sf), "transport_type", ARR)


@register("agg_linear_fit", with_clean(
    "SELECT round(regr_slope(actual_arrival_delay_min, traffic_congestion_index), 6) + 0.0 AS slope, "
    "round(regr_intercept(actual_arrival_delay_min, traffic_congestion_index), 6) + 0.0 AS intercept, "
    "round(regr_r2(actual_arrival_delay_min, traffic_congestion_index), 6) + 0.0 AS r2, "
    "CAST(regr_count(actual_arrival_delay_min, traffic_congestion_index) AS BIGINT) AS n FROM cleaned"))
def agg_linear_fit(spark, sf):
    return A.linear_fit(cleaned(spark, sf), ARR, "traffic_congestion_index")


@register("agg_binned_trend", with_clean(
    ", mm AS (SELECT min(temperature_C) AS lo, max(temperature_C) AS hi FROM cleaned) "
    "SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((temperature_C - lo) / ((hi - lo) / 20)) + 1, 20) END AS INT) AS bin, "
    "count(*) AS n, round(avg(temperature_C), 4) + 0.0 AS x_mean, round(avg(actual_arrival_delay_min), 4) + 0.0 AS y_mean, "
    "round(stddev_samp(actual_arrival_delay_min) / sqrt(count(*)), 4) + 0.0 AS y_se FROM cleaned, mm "
    "WHERE temperature_C IS NOT NULL AND actual_arrival_delay_min IS NOT NULL GROUP BY 1"))
def agg_binned_trend(spark, sf):
    return A.binned_trend(cleaned(spark, sf), "temperature_C", ARR, 20)


@register("agg_station_hour_features", with_xform(
    "SELECT origin_station, hour, CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, "
    "round(avg(actual_arrival_delay_min), 4) + 0.0 AS mean_delay, round(quantile_cont(actual_arrival_delay_min, 0.5), 4) + 0.0 AS median_delay, "
    "round(stddev_samp(actual_arrival_delay_min), 4) + 0.0 AS sd_delay, max(actual_arrival_delay_min) AS max_delay, "
    "sum(actual_arrival_delay_min) AS sum_delay, count(*) AS n, round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate "
    "FROM transformed GROUP BY 1, 2, 3"))
def agg_station_hour_features(spark, sf):
    df = transformed(spark, sf).withColumn(
        "day_type", F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday"))
    keys = ["origin_station", "hour", "day_type"]
    g = df.groupBy(*keys).agg(
        r_round(F.avg(ARR), 4).alias("mean_delay"), r_round(F.stddev_samp(ARR), 4).alias("sd_delay"),
        F.max(ARR).alias("max_delay"), F.sum(ARR).alias("sum_delay"), F.count("*").alias("n"),
        r_round(A.delay_rate(), 2).alias("delay_rate"))
    med = grouped_quantile(df, keys, ARR, 0.5, "median_delay")
    return g.join(med, keys).withColumn("median_delay", r_round(F.col("median_delay"), 4))


@register("agg_having", with_clean(
    "SELECT origin_station, destination_station, count(*) AS n, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay "
    "FROM cleaned GROUP BY 1, 2 HAVING count(*) > 10"))
def agg_having(spark, sf):
    df = cleaned(spark, sf)
    return (df.groupBy("origin_station", "destination_station")
            .agg(F.count("*").alias("n"), r_round(F.avg(ARR), 2).alias("avg_delay")).where(F.col("n") > 10))


@register("agg_delay_stats", with_clean(
    "SELECT round(avg(actual_arrival_delay_min), 4) + 0.0 AS mean_delay, round(quantile_cont(actual_arrival_delay_min, 0.5), 4) + 0.0 AS median_delay, "
    "round(stddev_samp(actual_arrival_delay_min), 4) + 0.0 AS sd_delay, max(actual_arrival_delay_min) AS max_delay, "
    "min(actual_arrival_delay_min) AS min_delay, round(avg(CASE WHEN actual_arrival_delay_min > 5 THEN 1.0 ELSE 0.0 END) * 100, 2) + 0.0 AS delay_rate FROM cleaned"))
def agg_delay_stats(spark, sf):
    df = cleaned(spark, sf)
    med = exact_quantiles(df, [ARR], [0.5])[ARR][0]
    return df.agg(r_round(F.avg(ARR), 4).alias("mean_delay"), F.stddev_samp(ARR).alias("sd"),
                  F.max(ARR).alias("max_delay"), F.min(ARR).alias("min_delay"),
                  r_round(F.avg(F.when(F.col(ARR) > 5, 1.0).otherwise(0.0)) * 100, 2).alias("delay_rate")) \
        .select("mean_delay", r_round(F.lit(med), 4).alias("median_delay"), r_round(F.col("sd"), 4).alias("sd_delay"),
                "max_delay", "min_delay", "delay_rate")


@register("agg_scatter_sample", with_clean(
    "SELECT trip_id, temperature_C, precipitation_mm, wind_speed_kmh, traffic_congestion_index, actual_arrival_delay_min "
    "FROM cleaned"))
def agg_scatter_sample(spark, sf):
    """Point data behind the four scatter plots: every row, pruned to the
    plotted columns."""
    df = cleaned(spark, sf)
    return df.select("trip_id", "temperature_C", "precipitation_mm", "wind_speed_kmh", "traffic_congestion_index", ARR)


@register("agg_cluster_ellipse", None)
def agg_cluster_ellipse(spark, sf):
    from .q_ml import kmeans_scores
    s = kmeans_scores(spark, sf)
    return s.groupBy("cluster").agg(F.count("*").alias("n"), r_round(F.avg("PC1"), 4).alias("mean_pc1"),
                                    r_round(F.avg("PC2"), 4).alias("mean_pc2"), r_round(F.var_samp("PC1"), 4).alias("var_pc1"),
                                    r_round(F.var_samp("PC2"), 4).alias("var_pc2"),
                                    r_round(F.covar_samp("PC1", "PC2"), 4).alias("cov_pc12"))
