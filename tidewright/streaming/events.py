"""Structured Streaming over the event table: an extension, as the reports themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """A stream of the event files in a folder."""
    shape = spark.read.parquet(f"{folder}/{glob}").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", glob).parquet(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, for which their times must have a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, late: str = "2 hours", width: str = "6 hours") -> DataFrame:
    """Counts and sums by tumbling window and type; windows close `late` behind the newest event. Works on streams and tables alike."""
    own = _marked(events, late)
    g = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", "cents")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """A user's events without a gap that long, as one session each."""
    own = _marked(events, late)
    g = own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")
