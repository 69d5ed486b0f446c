"""Window, sort and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import aggregate as A
from ..operators import windows as W
from ..sources.fixtures import table
from .oracle_ctes import with_clean, with_xform
from .registry import register
from .stages import cleaned, transformed

ARR = A.ARR


@register("win_station_rank", with_xform(
    "SELECT origin_station, count(*) AS total_trips, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay, "
    "round(avg(CAST(delayed AS DOUBLE)) * 100, 2) + 0.0 AS delay_rate, "
    "CAST(row_number() OVER (ORDER BY round(avg(actual_arrival_delay_min), 2) DESC, origin_station) AS INT) AS rank "
    "FROM transformed GROUP BY origin_station"))
def win_station_rank(spark, sf):
    """BI station ranking: aggregate, then rank the (small) grouped result."""
    g = transformed(spark, sf).groupBy("origin_station").agg(
        F.count("*").alias("total_trips"), r_round(F.avg(ARR), 2).alias("avg_delay"),
        r_round(A.delay_rate(), 2).alias("delay_rate"))
    return W.rank_rows(g, [F.desc("avg_delay"), F.asc("origin_station")], "rank")


@register("win_slice_max", with_clean(
    "SELECT origin_station, weather_condition, n FROM (SELECT origin_station, weather_condition, count(*) AS n, "
    "rank() OVER (PARTITION BY origin_station ORDER BY count(*) DESC) AS rk FROM cleaned GROUP BY 1, 2) WHERE rk = 1"))
def win_slice_max(spark, sf):
    counts = cleaned(spark, sf).groupBy("origin_station", "weather_condition").agg(F.count("*").alias("n"))
    return W.top1_with_ties(counts, ["origin_station"], "n")


def _route_share_sql(extra: str) -> str:
    return with_clean(
        ", s AS (SELECT route_id, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM cleaned GROUP BY route_id), "
        "c AS (SELECT route_id, n, pct + 0.0 AS pct, CAST(row_number() OVER (ORDER BY n DESC, route_id) AS INT) AS idx, "
        "round(sum(pct) OVER (ORDER BY n DESC, route_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) + 0.0 AS cum_pct FROM s) " + extra)


@register("win_cumulative_share", _route_share_sql("SELECT * FROM c"))
def win_cumulative_share(spark, sf):
    shares = A.class_balance(cleaned(spark, sf), "route_id").withColumnRenamed("pct", "pct")
    return W.cumulative_share(shares, "route_id", "n", "pct")


@register("win_threshold_index", _route_share_sql(
    "SELECT min(idx) FILTER (WHERE cum_pct >= 50) AS idx_50, min(idx) FILTER (WHERE cum_pct >= 85) AS idx_85, "
    "min(idx) FILTER (WHERE cum_pct >= 90) AS idx_90 FROM c"))
def win_threshold_index(spark, sf):
    shares = A.class_balance(cleaned(spark, sf), "route_id")
    c = W.cumulative_share(shares, "route_id", "n", "pct")
    return W.threshold_index(c, "cum_pct", "idx", [50, 85, 90])


@register("win_next_stop",
          "SELECT user_id, ts, event_type AS stop, value AS delay, lead(event_type) OVER w AS next_stop, "
          "lead(value) OVER w AS next_delay, round(lead(value) OVER w - value, 4) + 0.0 AS delay_increase "
          "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_next_stop(spark, sf):
    ev = table(spark, sf, "events")
    return W.next_in_sequence(ev, "user_id", ["ts", "event_id"], "event_type", "value").select(
        "user_id", "ts", F.col("event_type").alias("stop"), F.col("value").alias("delay"),
        F.col("next_event_type").alias("next_stop"), F.col("next_value").alias("next_delay"),
        r_round(F.col("next_value") - F.col("value"), 4).alias("delay_increase"))


@register("win_time_to_next",
          "SELECT user_id, event_id, ts, round(CAST(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 60000000.0, 6) + 0.0 AS minutes_to_next "
          "FROM events")
def win_time_to_next(spark, sf):
    ev = table(spark, sf, "events")
    return W.time_to_next(ev, "user_id", "ts", "event_id", "minutes_to_next")


@register("win_group_size_filter", with_clean(
    "SELECT trip_id, origin_station, destination_station, n_pair FROM (SELECT trip_id, origin_station, destination_station, "
    "count(*) OVER (PARTITION BY origin_station, destination_station, date) AS n_pair FROM cleaned) WHERE n_pair > 1"))
def win_group_size_filter(spark, sf):
    df = cleaned(spark, sf)
    return W.group_size_filter(df, ["origin_station", "destination_station", "date"], 1, "n_pair").select(
        "trip_id", "origin_station", "destination_station", "n_pair")


@register("srt_multi_key", with_clean(
    "SELECT origin_station, destination_station, date, trip_id, actual_arrival_delay_min FROM cleaned"))
def srt_multi_key(spark, sf):
    """Global multi-key sort (range-partitioned by Spark's sort: no single task)."""
    return cleaned(spark, sf).select("origin_station", "destination_station", "date", "trip_id", ARR).orderBy(
        F.asc("origin_station"), F.desc(ARR), F.asc("date"), F.asc("trip_id"))


def _topk_sql(key: str, k: int) -> str:
    return with_xform(
        f"SELECT {key}, avg_delay, CAST(rk AS INT) AS rank FROM (SELECT {key}, round(avg(actual_arrival_delay_min), 6) + 0.0 AS avg_delay, "
        f"rank() OVER (ORDER BY round(avg(actual_arrival_delay_min), 6) DESC) AS rk FROM transformed GROUP BY {key}) WHERE rk <= {k}")


def _topk(spark, sf, key, k):
    g = transformed(spark, sf).groupBy(key).agg(r_round(F.avg(ARR), 6).alias("avg_delay"))
    return W.top_n_with_ties(g, "avg_delay", k, "rank")


@register("topk_origin", _topk_sql("origin_station", 15))
def topk_origin(spark, sf):
    return _topk(spark, sf, "origin_station", 15)


@register("topk_destination", _topk_sql("destination_station", 15))
def topk_destination(spark, sf):
    return _topk(spark, sf, "destination_station", 15)


@register("topk_route", _topk_sql("route_id", 10))
def topk_route(spark, sf):
    return _topk(spark, sf, "route_id", 10)


@register("topk_busiest", with_xform(
    "SELECT origin_station, n, CAST(rk AS INT) AS rank FROM (SELECT origin_station, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk "
    "FROM transformed GROUP BY 1) WHERE rk <= 20"))
def topk_busiest(spark, sf):
    g = transformed(spark, sf).groupBy("origin_station").agg(F.count("*").alias("n"))
    return W.top_n_with_ties(g, "n", 20, "rank")
