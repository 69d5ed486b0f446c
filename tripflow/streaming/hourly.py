"""Structured Streaming form of the hourly delay series.

Trips arrive as Parquet files; each micro-batch is aggregated into tumbling
one-hour event-time windows with a watermark, and the running result is
upserted into a Parquet table through ``foreachBatch`` (complete state of
the windows touched by the batch, merged by window start).  With
``Trigger.AvailableNow`` the query drains the folder and stops, so the
result equals the batch ``hourly`` aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hourly_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str,
                  ts: str = "datetime", value: str = "actual_arrival_delay_min",
                  extra: str = "traffic_congestion_index", watermark: str = "1 hour") -> None:
    stream = (spark.readStream.schema(schema).parquet(src)
              .withColumn("__ts", F.col(ts).cast("timestamp")))
    agg = (stream.withWatermark("__ts", watermark)
           .groupBy(F.window("__ts", "1 hour").alias("w"))
           .agg(F.sum(value).alias("sum_delay"), F.count(value).alias("n_delay"), F.count("*").alias("trip_count"),
                F.sum(extra).alias("sum_cong"), F.count(extra).alias("n_cong")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # update mode hands over the windows changed by this batch (with
        # their full running state); keep the newest version of each window
        batch.select(F.col("w.start").alias("window_start"), "sum_delay", "n_delay", "trip_count", "sum_cong", "n_cong",
                     F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(out)

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_hourly(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per window → (date, hour, avg_delay, trip_count, avg_congestion)."""
    raw = spark.read.parquet(out)
    latest = raw.groupBy("window_start").agg(F.max_by(F.struct("sum_delay", "n_delay", "trip_count", "sum_cong", "n_cong"),
                                                      "batch_id").alias("s"))
    ts = F.col("window_start").cast("timestamp_ntz")
    return latest.select(F.to_date(ts).alias("date"), F.hour(ts).alias("hour"),
                         (F.col("s.sum_delay") / F.col("s.n_delay")).alias("avg_delay"),
                         F.col("s.trip_count").alias("trip_count"),
                         (F.col("s.sum_cong") / F.col("s.n_cong")).alias("avg_congestion"))
