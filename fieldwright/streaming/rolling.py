"""Counts of a key's events in sliding windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.streaming.common import drain, file_stream


def counts(events: DataFrame, length: str = "24 hours", slide: str = "6 hours", late: str = "40 days") -> DataFrame:
    """(user_id, window_start, n); events that come later than ``late`` after the newest one are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.window("at", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    """The last count of every window; each batch puts out those it changed, and counts only grow."""
    return drain(counts(file_stream(spark, path)), "rolling", "update").groupBy("user_id", "window_start").agg(F.max("n").alias("n")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
