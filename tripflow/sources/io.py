"""Typed CSV / Parquet sources and sinks, and the output manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import regex_category

# The declared schema of the trips file (no inference).
TRIPS_SCHEMA = T.StructType([
    T.StructField("trip_id", T.StringType()), T.StructField("ingest_seq", T.LongType()),
    T.StructField("date", T.DateType()), T.StructField("time", T.StringType()),
    T.StructField("transport_type", T.StringType()), T.StructField("route_id", T.StringType()),
    T.StructField("origin_station", T.StringType()), T.StructField("destination_station", T.StringType()),
    T.StructField("scheduled_departure", T.StringType()), T.StructField("scheduled_arrival", T.StringType()),
    T.StructField("actual_departure_delay_min", T.DoubleType()), T.StructField("actual_arrival_delay_min", T.DoubleType()),
    T.StructField("weather_condition", T.StringType()), T.StructField("temperature_C", T.DoubleType()),
    T.StructField("humidity_percent", T.DoubleType()), T.StructField("wind_speed_kmh", T.DoubleType()),
    T.StructField("precipitation_mm", T.DoubleType()), T.StructField("event_type", T.StringType()),
    T.StructField("event_attendance_est", T.DoubleType()), T.StructField("traffic_congestion_index", T.DoubleType()),
    T.StructField("holiday", T.IntegerType()), T.StructField("peak_hour", T.IntegerType()),
    T.StructField("weekday", T.IntegerType()), T.StructField("season", T.StringType()),
    T.StructField("delayed", T.IntegerType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
            .option("nullValue", "NA").option("mode", "PERMISSIVE").csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").option("dateFormat", "yyyy-MM-dd").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# Manifest categories by path prefix, first match wins.
MANIFEST_RULES = [(r"^cleaned/", "Cleaned Data"), (r"^plots/", "Plots"), (r"^models/", "Models"),
                  (r"^reports/", "Reports")]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Category, File for every file under ``root`` (paths only: the binary
    file source is asked for ``path`` alone, so no file content is read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path"))
    top = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    rel = F.expr("substring(path, locate(top, path) + length(top))")
    return (files.withColumn("top", F.lit(top)).select(rel.alias("File"))
            .select(regex_category("File", MANIFEST_RULES, "Other").alias("Category"), "File"))
