"""Tables, token files and registry files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import words


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a temporary one, in one local process only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-checkpoint-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeds(spark: SparkSession) -> DataFrame:
    """The seed list at distance 0 in the best bucket."""
    return spark.createDataFrame([(u,) for u in words("seeds")], "url string").select("url", F.lit(0).alias("seed_distance"), F.lit(0).alias("domain_dist"), F.lit(0).alias("bucket"))


def write_token_files(docs: DataFrame, path: str) -> None:
    """docs (url, words) as text records: <doc>, url, a word a line, </doc>."""
    body = F.concat_ws("\n", F.lit("<doc>"), F.col("url"), F.concat_ws("\n", "words"), F.lit("</doc>"))
    docs.select(body.alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, words) of token files; records without a start mark or url and words with white space are skipped."""
    raw = spark.read.option("lineSep", "</doc>\n").text(path)
    body = F.split(F.regexp_extract("value", r"(?s).*<doc>\n(.*)$", 1), "\n")
    kept = F.filter(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), lambda w: (w != "") & ~w.rlike(r"[ \t\x00]") & ~w.isin("</doc>", "<title>", "</title>"))
    return raw.select(body[0].alias("url"), kept.alias("words")).where("url <> ''")


def write_registry(store: DataFrame, path: str, final: bool = False) -> None:
    """Registry rows with URLs of at most 4096 bytes; the final write keeps crawled ones only."""
    rows = store.where(F.octet_length("url") <= 4096)
    (rows.where("crawled") if final else rows).write.mode("overwrite").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case URLs, titles over 8192 bytes emptied, anchors cut to 512 bytes; counts of anchors that are then equal add up."""
    df = spark.read.parquet(path)
    title = F.when(F.octet_length("title") > 8192, "").otherwise(F.col("title"))
    short = F.transform(F.map_entries("anchor_freqs"), lambda e: F.struct(_cut(e["key"], 512).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform("__short", lambda e: e["key"]))
    total = lambda k: F.aggregate(F.filter("__short", lambda e: e["key"] == k), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    anchors = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value"))))
    return df.withColumns({"url": F.lower("url"), "title": title, "__short": short}).withColumn("anchor_freqs", anchors).drop("__short")


def _cut(text: Column, size: int) -> Column:
    """text cut to size bytes, whole characters only."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, size), "ISO-8859-1")
    whole = F.encode(F.regexp_replace(cut, r"(?s)([\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]{0,1}|[\xF0-\xF7][\x80-\xBF]{0,2})$", ""), "ISO-8859-1")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.decode(whole, "UTF-8"))


def write_frontier(frontier: DataFrame, path: str) -> None:
    """The frontier by bucket, in place of what is there."""
    frontier.write.mode("overwrite").partitionBy("bucket").parquet(path)


def append_frontier(frontier: DataFrame, path: str) -> None:
    """Targets that come later, to the buckets they belong to."""
    frontier.write.mode("append").partitionBy("bucket").parquet(path)


def read_frontier(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """A stored frontier, or some buckets of it; other buckets' files aren't opened."""
    df = spark.read.parquet(path)
    return df if buckets is None else df.where(F.col("bucket").isin(buckets))
