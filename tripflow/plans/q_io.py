"""Source and sink queries and multi-table joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.fixtures import table, trips
from .oracle_ctes import with_clean, with_trips
from .registry import register
from .stages import cleaned, stage_path

_ALL = [f.name for f in io.TRIPS_SCHEMA.fields]


@register("src_trips_csv", with_trips("SELECT * FROM trips"))
def src_trips_csv(spark, sf):
    """Trips written as CSV (header, NA for null) and read back with the
    declared schema."""
    path = stage_path(spark, sf, "io/trips_csv")
    io.write_csv(trips(spark, sf), path)
    return io.read_csv(spark, path, io.TRIPS_SCHEMA)


@register("src_stage_parquet", with_clean("SELECT * FROM cleaned"))
def src_stage_parquet(spark, sf):
    return cleaned(spark, sf)


@register("sink_csv_roundtrip", with_clean(
    "SELECT origin_station, count(*) AS n, round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_delay FROM cleaned GROUP BY 1"))
def sink_csv_roundtrip(spark, sf):
    path = stage_path(spark, sf, "io/station_csv")
    from ..functions.stats import r_round
    g = cleaned(spark, sf).groupBy("origin_station").agg(F.count("*").alias("n"),
                                                          r_round(F.avg("actual_arrival_delay_min"), 2).alias("avg_delay"))
    io.write_csv(g, path)
    return io.read_csv(spark, path, "origin_station string, n long, avg_delay double")


@register("sink_parquet_roundtrip", with_clean("SELECT trip_id, date, origin_station, actual_arrival_delay_min FROM cleaned"))
def sink_parquet_roundtrip(spark, sf):
    """Stage sink partitioned by a coarse time key (year): pruning-friendly
    at scale without one folder per day."""
    path = stage_path(spark, sf, "io/trips_by_year")
    df = cleaned(spark, sf).select("trip_id", "date", "origin_station", "actual_arrival_delay_min").withColumn(
        "year", F.year("date"))
    io.write_parquet(df, path, ["year"])
    return spark.read.parquet(path).drop("year")


@register("sink_manifest")
def sink_manifest(spark, sf):
    root = stage_path(spark, sf, "manifest_demo")
    cl = cleaned(spark, sf)
    io.write_csv(cl.groupBy("origin_station").count(), root + "/reports/station_counts.csv")
    io.write_parquet(cl.select("trip_id", "origin_station"), root + "/cleaned/trips")
    return io.manifest(spark, root)


@register("src_star_load",
          "SELECT l_orderkey, l_linenumber, o_orderdate, o_orderpriority, p_brand, s_nationkey, l_extendedprice "
          "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
          "JOIN supplier ON l_suppkey = s_suppkey")
def src_star_load(spark, sf):
    """Fact + three dimensions; Catalyst prunes each scan to the used columns."""
    li, o, p, s = (table(spark, sf, n) for n in ("lineitem", "orders", "part", "supplier"))
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .select("l_orderkey", "l_linenumber", "o_orderdate", "o_orderpriority", "p_brand", "s_nationkey", "l_extendedprice"))


@register("jn_fact_dim",
          "SELECT o_orderpriority, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) + 0.0 AS revenue "
          "FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def jn_fact_dim(spark, sf):
    from ..functions.stats import r_round
    li, o, p = (table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left").join(p, li.l_partkey == p.p_partkey, "left")
    return j.groupBy("o_orderpriority", "p_brand").agg(F.count("*").alias("n"), r_round(F.sum("l_extendedprice"), 2).alias("revenue"))


@register("flt_self_loops", with_clean(
    "SELECT origin_station, destination_station, count(*) AS n FROM cleaned WHERE origin_station <> destination_station GROUP BY 1, 2"))
def flt_self_loops(spark, sf):
    df = cleaned(spark, sf).where(F.col("origin_station") != F.col("destination_station"))
    return df.groupBy("origin_station", "destination_station").agg(F.count("*").alias("n"))


@register("flt_in_top_set", with_clean(
    ", top AS (SELECT origin_station FROM (SELECT origin_station, rank() OVER (ORDER BY count(*) DESC) AS rk FROM cleaned GROUP BY 1) "
    "WHERE rk <= 5) SELECT trip_id, origin_station FROM cleaned SEMI JOIN top USING (origin_station)"))
def flt_in_top_set(spark, sf):
    """%in% a computed set → left-semi join (the set is aggregated first)."""
    from ..operators.windows import top_n_with_ties
    df = cleaned(spark, sf)
    top = top_n_with_ties(df.groupBy("origin_station").agg(F.count("*").alias("n")), "n", 5)
    return df.join(top.select("origin_station"), "origin_station", "left_semi").select("trip_id", "origin_station")


@register("set_union_by_name", with_clean(
    "SELECT 'origin' AS role, origin_station AS station, count(*) AS n, NULL::DOUBLE AS avg_delay FROM cleaned GROUP BY 2 "
    "UNION ALL SELECT 'destination', destination_station, NULL::BIGINT, round(avg(actual_arrival_delay_min), 2) + 0.0 FROM cleaned GROUP BY 2"))
def set_union_by_name(spark, sf):
    from ..functions.stats import r_round
    df = cleaned(spark, sf)
    a = df.groupBy(F.col("origin_station").alias("station")).agg(F.count("*").alias("n")).withColumn("role", F.lit("origin"))
    b = df.groupBy(F.col("destination_station").alias("station")).agg(
        r_round(F.avg("actual_arrival_delay_min"), 2).alias("avg_delay")).withColumn("role", F.lit("destination"))
    return a.unionByName(b, allowMissingColumns=True)


@register("set_union_distinct", with_trips(
    "SELECT origin_station AS station FROM trips UNION SELECT destination_station FROM trips"))
def set_union_distinct(spark, sf):
    df = trips(spark, sf)
    return df.select(F.col("origin_station").alias("station")).union(df.select("destination_station")).distinct()
