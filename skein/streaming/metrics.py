"""Crawl metrics as Structured Streaming queries; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of metric events; ts becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def totals(events: DataFrame) -> DataFrame:
    """Running count, sum and average by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def rates(events: DataFrame, width: str = "20 seconds", seconds: int = 20, late: str | None = None) -> DataFrame:
    """Events per second and type in fixed windows. late: watermark of a stream."""
    df = events.withWatermark("ts", late) if late else events
    counts = df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total", (F.col("n") / seconds).alias("per_second"))
