"""DuckDB text of the trips → cleaned → transformed stages, used as CTEs in
oracle SQL.  Written independently of the Spark code path (window
row_number, quantile_cont, scalar subqueries) so agreement means something.
"""

from __future__ import annotations

from ..sources.fixtures import EVENT_MAP, SEASON_MAP, STORM_VALUES, TRANSPORT_MAP, WEATHER_MAP, trips_cte


# Spelt out here, so that a wrong list in an operator can't pass on both sides.
TRIP_COLUMNS = """trip_id date time transport_type route_id origin_station destination_station scheduled_departure
scheduled_arrival actual_departure_delay_min actual_arrival_delay_min weather_condition temperature_C humidity_percent
wind_speed_kmh precipitation_mm event_type event_attendance_est traffic_congestion_index holiday peak_hour weekday season
delayed""".split()
MEDIAN_COLS = """temperature_C humidity_percent wind_speed_kmh precipitation_mm event_attendance_est traffic_congestion_index
actual_departure_delay_min actual_arrival_delay_min""".split()
LABEL_COLS = """transport_type weather_condition event_type season route_id origin_station destination_station holiday
peak_hour delayed weekday""".split()
TIME_COLS = ["time", "scheduled_departure", "scheduled_arrival"]
OUTLIER_COLS = MEDIAN_COLS
SCALE_COLS = """actual_departure_delay_min actual_arrival_delay_min temperature_C humidity_percent wind_speed_kmh
precipitation_mm event_attendance_est traffic_congestion_index total_delay delay_change trip_duration_scheduled
weather_severity_index feels_like_impact event_impact_score congestion_weather_combo""".split()


def _mode_sql(c: str, src: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) OVER (PARTITION BY {c}) AS n, ingest_seq, "
            f"event_attendance_est FROM {src} WHERE {c} IS NOT NULL) "
            f"ORDER BY n DESC, ingest_seq, event_attendance_est LIMIT 1)")


def _case_map(c: str, m: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in m.items()) + " END"


def clean_ctes() -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in MEDIAN_COLS)
    sel = []
    for c in ["ingest_seq"] + TRIP_COLUMNS:
        if c in MEDIAN_COLS:
            sel.append(f"coalesce({c}, (SELECT {c} FROM c_med)) AS {c}")
        elif c in LABEL_COLS:
            sel.append(f"coalesce({c}, {_mode_sql(c, 'c1')}) AS {c}")
        elif c in TIME_COLS:
            sel.append(f"coalesce({c}, {_mode_sql(c, 'c1d')}) AS {c}")
        else:
            sel.append(c)
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in OUTLIER_COLS)
    sel4 = []
    for c in ["ingest_seq"] + TRIP_COLUMNS:
        if c in OUTLIER_COLS:
            lo = f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))"
            hi = f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
            sel4.append(f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least({c}, {hi}), {lo}) END AS {c}")
        else:
            sel4.append(c)
    return (
        trips_cte("duckdb") + ",\n"
        "c1 AS (SELECT * FROM trips WHERE trip_id IS NOT NULL AND NOT "
        "(actual_departure_delay_min IS NULL AND actual_arrival_delay_min IS NULL)),\n"
        "c1d AS (SELECT * FROM c1 WHERE date IS NOT NULL),\n"
        f"c_med AS (SELECT {med} FROM c1),\n"
        f"c2 AS (SELECT {', '.join(sel)} FROM c1d),\n"
        "c3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trip_id "
        "ORDER BY ingest_seq, event_attendance_est) AS rn FROM c2) WHERE rn = 1),\n"
        f"c_q AS (SELECT {q} FROM c3),\n"
        f"cleaned AS (SELECT {', '.join(sel4)}, CASE WHEN origin_station = destination_station "
        "THEN 1 ELSE 0 END AS is_circular_trip FROM c3, c_q)"
    )


def _ts(d: str, t: str) -> str:
    return f"CAST(CAST({d} AS VARCHAR) || ' ' || {t} AS TIMESTAMP)"


def transformed_ctes() -> str:
    storm = ", ".join(f"'{s}'" for s in STORM_VALUES)
    dep, arr = "actual_departure_delay_min", "actual_arrival_delay_min"
    x1 = (f"x1 AS (SELECT *, {_ts('date', 'time')} AS datetime, {_ts('date', 'scheduled_departure')} AS sched_dep_datetime, "
          f"CASE WHEN {_ts('date', 'scheduled_arrival')} < {_ts('date', 'scheduled_departure')} "
          f"THEN {_ts('date', 'scheduled_arrival')} + INTERVAL 1 DAY ELSE {_ts('date', 'scheduled_arrival')} END AS sched_arr_datetime "
          "FROM cleaned)")
    x2 = ("x2 AS (SELECT *, CAST(hour(datetime) AS INT) AS hour, dayname(date) AS day_name, "
          "CASE WHEN weekday IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, CAST(month(date) AS INT) AS month, "
          "CAST(floor((dayofyear(date) - 1) / 7) + 1 AS INT) AS week_of_year, "
          "CASE WHEN hour(datetime) >= 0 AND hour(datetime) < 6 THEN 'Night' WHEN hour(datetime) >= 6 AND hour(datetime) < 12 "
          "THEN 'Morning' WHEN hour(datetime) >= 12 AND hour(datetime) < 18 THEN 'Afternoon' "
          "WHEN hour(datetime) >= 18 AND hour(datetime) <= 23 THEN 'Evening' ELSE 'Unknown' END AS time_of_day_bucket, "
          f"{dep} + {arr} AS total_delay, {arr} - {dep} AS delay_change, "
          f"CASE WHEN {dep} < 0 THEN 1 ELSE 0 END AS is_early_departure, "
          f"CASE WHEN {arr} < 0 THEN 1 ELSE 0 END AS is_early_arrival, "
          "CAST(date_diff('second', sched_dep_datetime, sched_arr_datetime) AS DOUBLE) / 60.0 AS trip_duration_raw, "
          f"CASE WHEN {arr} > 15 THEN 1 ELSE 0 END AS severe_delay, "
          f"{_case_map('transport_type', TRANSPORT_MAP)} AS transport_type_enc, "
          f"{_case_map('weather_condition', WEATHER_MAP)} AS weather_condition_enc, "
          f"{_case_map('event_type', EVENT_MAP)} AS event_type_enc, "
          f"{_case_map('season', SEASON_MAP)} AS season_enc FROM x1)")
    x3 = ("x3 AS (SELECT * EXCLUDE (trip_duration_raw), CASE WHEN trip_duration_raw IS NULL OR trip_duration_raw <= 0 "
          "THEN (SELECT quantile_cont(trip_duration_raw, 0.5) FROM x2) ELSE trip_duration_raw END AS trip_duration_scheduled, "
          "round(0.3 * (wind_speed_kmh / (SELECT max(wind_speed_kmh) FROM x2)) + 0.4 * (precipitation_mm / "
          f"(SELECT max(precipitation_mm + 0.01) FROM x2)) + 0.3 * (CASE WHEN weather_condition IN ({storm}) THEN 1.0 ELSE 0.0 END), 4) + 0.0 "
          "AS weather_severity_index, round(temperature_C * wind_speed_kmh / 100, 4) + 0.0 AS feels_like_impact, "
          "round(event_attendance_est * traffic_congestion_index / 1000, 4) + 0.0 AS event_impact_score FROM x2)")
    x4 = ("x4 AS (SELECT *, round(traffic_congestion_index * weather_severity_index, 4) + 0.0 AS congestion_weather_combo FROM x3)")
    st = (f"x_st AS (SELECT origin_station, round(avg({dep}), 2) + 0.0 AS station_avg_dep_delay, "
          "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS station_delay_rate FROM x4 GROUP BY origin_station)")
    x5 = "x5 AS (SELECT x4.*, x_st.station_avg_dep_delay, x_st.station_delay_rate FROM x4 LEFT JOIN x_st USING (origin_station))"
    rt = (f"x_rt AS (SELECT route_id, round(avg({arr}), 2) + 0.0 AS route_avg_delay, "
          "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS route_delay_rate FROM x5 GROUP BY route_id)")
    x6 = "x6 AS (SELECT x5.*, x_rt.route_avg_delay, x_rt.route_delay_rate FROM x5 LEFT JOIN x_rt USING (route_id))"
    params = ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}"
                       for c in SCALE_COLS)
    z = ", ".join(f"CASE WHEN s_{c} > 0 THEN round(({c} - a_{c}) / s_{c}, 4) + 0.0 ELSE 0.0 END AS {c}_z"
                  for c in SCALE_COLS)
    mm = ", ".join(f"CASE WHEN h_{c} - l_{c} > 0 THEN round(({c} - l_{c}) / (h_{c} - l_{c}), 4) + 0.0 ELSE 0.0 END AS {c}_mm"
                   for c in SCALE_COLS)
    xp = f"x_p AS (SELECT {params} FROM x6)"
    xf = f"transformed AS (SELECT x6.*, {z}, {mm} FROM x6, x_p)"
    return ",\n".join([clean_ctes(), x1, x2, x3, x4, st, x5, rt, x6, xp, xf])


def with_trips(sql: str) -> str:
    return "WITH " + trips_cte("duckdb") + "\n" + sql


def with_clean(sql: str) -> str:
    return "WITH " + clean_ctes() + "\n" + sql


def with_xform(sql: str) -> str:
    return "WITH " + transformed_ctes() + "\n" + sql
