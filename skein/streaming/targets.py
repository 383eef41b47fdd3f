"""Crawl targets as a stream: given a bucket by priority, dropped below the last, appended to the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import registry
from ..sources import tables

TARGETS = "url string, seed_distance int, domain_dist int"


def read_targets(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(TARGETS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def routed(targets: DataFrame) -> DataFrame:
    """targets with domain, priority and bucket; those below the last bucket, and null URLs, go. Serves streams and batches."""
    p = registry.priority(F.col("url"), F.col("seed_distance"), F.col("domain_dist"))
    out = targets.where("url is not null").withColumns({"domain": U.domain(F.col("url")), "priority": p}).withColumn("bucket", registry.bucket(F.col("priority")))
    return out.where(F.col("bucket") < len(registry.BUCKETS))


def enqueue(targets: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to the frontier at path; returns the writer. A restart goes on behind the last batch in the
    checkpoint, whose files a repeated batch replaces."""

    def add(batch: DataFrame, number: int) -> None:
        tables.write_frontier(routed(batch), f"{path}/batch={number}")

    return targets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
