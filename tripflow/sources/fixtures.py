"""Test-table bindings.

``trips`` is the stand-in for the reference's single input table: 24 trip
columns (plus ``ingest_seq`` = file order) derived by arithmetic from the
TPC-H-like tables, with nulls, duplicates, outliers, overnight and circular
rows.  The same text runs in Spark and in DuckDB; only the weekday expression
differs (Spark's ``dayofweek`` is 1-based).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The stand-in trips view, kept verbatim so both engines see
# identical rows.  {dow} is the engine-specific 0-based weekday.
TRIPS_BASE = """
  SELECT l.*, o_orderdate, o_orderpriority, c_nationkey, s_nationkey, p_brand, p_type, p_size, c_mktsegment,
         l_orderkey * 7 + l_linenumber AS k,
         CAST((l_orderkey * 37 + l_partkey * 11) % 1440 AS INT) AS dep_min,
         CAST((l_orderkey * 37 + l_partkey * 11 + 16 + (l_orderkey * 3 + l_suppkey * 7) % 44) % 1440 AS INT) AS arr_min
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

TRIPS_SELECT = """
SELECT
  CASE WHEN k % 997 = 0 THEN NULL ELSE concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS trip_id,
  l_partkey * 1000 + l_suppkey AS ingest_seq,
  CAST(o_orderdate AS DATE) AS date,
  concat(lpad(CAST(CAST(floor(dep_min / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(dep_min % 60 AS STRING), 2, '0'), ':00') AS time,
  CASE WHEN k % 23 = 0 THEN NULL ELSE l_returnflag END AS transport_type,
  p_brand AS route_id,
  concat('Station_', CAST(s_nationkey AS STRING)) AS origin_station,
  concat('Station_', CAST(c_nationkey AS STRING)) AS destination_station,
  concat(lpad(CAST(CAST(floor(dep_min / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(dep_min % 60 AS STRING), 2, '0'), ':00') AS scheduled_departure,
  concat(lpad(CAST(CAST(floor(arr_min / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(arr_min % 60 AS STRING), 2, '0'), ':00') AS scheduled_arrival,
  CASE WHEN k % 31 = 0 THEN NULL ELSE CAST((l_partkey * 7 + l_linenumber * 3) % 22 AS DOUBLE) - 2 END AS actual_departure_delay_min,
  CASE WHEN k % 29 = 0 THEN NULL ELSE CAST((l_partkey * 5 + l_suppkey * 13 + l_linenumber) % 33 AS DOUBLE) - 3 END AS actual_arrival_delay_min,
  CASE WHEN k % 19 = 0 THEN NULL ELSE p_type END AS weather_condition,
  CAST((l_partkey * 3 + l_orderkey) % 41 AS DOUBLE) - 5 AS temperature_C,
  CAST((l_suppkey * 11 + l_orderkey) % 70 AS DOUBLE) + 30 AS humidity_percent,
  CAST(p_size AS DOUBLE) AS wind_speed_kmh,
  l_discount * 100 AS precipitation_mm,
  o_orderpriority AS event_type,
  CASE WHEN k % 41 = 0 THEN l_extendedprice * 5 ELSE l_extendedprice END AS event_attendance_est,
  CASE WHEN k % 17 = 0 THEN NULL ELSE l_quantity * 2 END AS traffic_congestion_index,
  CASE WHEN l_orderkey % 30 = 0 THEN 1 ELSE 0 END AS holiday,
  CASE WHEN floor(dep_min / 60) IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS peak_hour,
  CAST({dow} AS INT) AS weekday,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS delayed
FROM base
"""

SPARK_DOW = "dayofweek(o_orderdate) - 1"
DUCKDB_DOW = "dayofweek(o_orderdate)"

# Label maps that fit the stand-in view (transport = return
# flag, weather = part size class, event = order priority; the priority that
# plays "no event" is 0, the rest count up from 1; PROMO and SMALL are the two
# "storm" classes).
TRANSPORT_MAP = {"A": 1, "N": 2, "R": 3}
WEATHER_MAP = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
EVENT_MAP = {"4-NOT SPECIFIED": 0, "1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 4}
SEASON_MAP = {"Winter": 1, "Spring": 2, "Summer": 3, "Autumn": 4}
STORM_VALUES = ("PROMO", "SMALL")


# The same join for Spark: orders meet their customers before the long table meets them, so it is shuffled once less.
SPARK_BASE = TRIPS_BASE.replace(
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey")


def trips_sql(engine: str = "spark") -> str:
    dow = SPARK_DOW if engine == "spark" else DUCKDB_DOW
    return "WITH base AS (" + (SPARK_BASE if engine == "spark" else TRIPS_BASE) + ")" + TRIPS_SELECT.replace("{dow}", dow)


def trips_cte(engine: str = "duckdb") -> str:
    """CTE list ``base, trips`` for inlining in oracle SQL."""
    dow = SPARK_DOW if engine == "spark" else DUCKDB_DOW
    return "base AS (" + TRIPS_BASE + "), trips AS (" + TRIPS_SELECT.replace("{dow}", dow) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips view over the five source tables of ``sf_dir``.

    Built with ``spark.sql`` over per-call temp views so Catalyst prunes the
    unused columns of each scan and plans the star join (AQE turns the
    dimension joins into broadcasts only when their measured size is small).
    """
    for n in ("lineitem", "orders", "customer", "supplier", "part"):
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(trips_sql("spark"))
