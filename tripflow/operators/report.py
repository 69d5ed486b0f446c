"""BI export tables: KPI long table, rankings, patterns, copy-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import r_round

# The 26 columns of the wide BI extract, identifiers first.
BI_COLUMNS = ["trip_id", "date", "hour", "transport_type", "route_id", "origin_station",
              "destination_station", "actual_departure_delay_min", "actual_arrival_delay_min",
              "weather_condition", "temperature_C", "precipitation_mm", "event_type",
              "event_attendance_est", "traffic_congestion_index", "holiday", "peak_hour", "weekday",
              "season", "delayed", "total_delay", "delay_change", "time_of_day_bucket", "is_weekend",
              "weather_severity_index", "event_impact_score"]

# KPI metric names in report order.
KPI_NAMES = ["Total Trips", "Delayed Trips", "On-Time Trips", "Delay Rate (%)",
             "Avg Arrival Delay (min)", "Avg Departure Delay (min)", "Max Arrival Delay (min)",
             "Unique Stations", "Unique Routes", "Date Range Start", "Date Range End"]


def num_text(c: Column) -> Column:
    """Number → text the way R prints it (integral values without '.0')."""
    d = c.cast("double")
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def kpi(df: DataFrame) -> DataFrame:
    """One aggregate pass (distinct stations via a stacked distinct) → 11 rows."""
    stations = df.select(F.explode(F.array("origin_station", "destination_station")).alias("s")).distinct().agg(
        (F.count("s") + F.max(F.col("s").isNull().cast("int"))).alias("k8"))
    d = F.col("delayed").cast("double")
    one = df.agg(
        F.count("*").alias("k0"), F.sum(d).alias("k1"), F.count_if(d == 0).alias("k2"),
        r_round(F.avg(d) * 100, 2).alias("k3"), r_round(F.avg("actual_arrival_delay_min"), 2).alias("k4"),
        r_round(F.avg("actual_departure_delay_min"), 2).alias("k5"), F.max("actual_arrival_delay_min").alias("k6"),
        (F.countDistinct("route_id") + F.max(F.col("route_id").isNull().cast("int"))).alias("k9"),
        F.min("date").cast("string").alias("k10"), F.max("date").cast("string").alias("k11"),
    ).crossJoin(stations)
    vals = [num_text(F.col(k)) for k in ("k0", "k1", "k2", "k3", "k4", "k5", "k6", "k8", "k9")] + \
           [F.col("k10"), F.col("k11")]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("idx"), F.lit(n).alias("Metric"), v.alias("Value"))
                    for i, (n, v) in enumerate(zip(KPI_NAMES, vals))])
    return one.select(F.explode(arr).alias("x")).select("x.idx", "x.Metric", "x.Value")


def copy_through(spark: SparkSession, src: str, dst: str, schema: T.StructType | str) -> DataFrame | None:
    """Re-export a report if it exists, else skip (returns None)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(src)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(src)
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(dst)
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(dst)
