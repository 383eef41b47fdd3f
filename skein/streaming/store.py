"""A registry kept by a stream of link updates: micro-batches rewrite the parts of it that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import logger
from ..operators import registry

#: Parts of a registry, by a hash of the URL. A batch rewrites the parts that its URLs are in.
PARTS = 64
_log = logger(__name__)


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """(number of the last batch, below before if given, version of each part); (-1, {}) if there is none."""
    fs, root = _fs(spark, f"{path}/manifest")
    done = [int(x.getPath().getName()) for x in fs.listStatus(root) if x.getPath().getName().isdigit()] if fs.exists(root) else []
    done = [n for n in done if (before is None or n < before) and fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[1])]
    if not done:
        return -1, {}
    rows = spark.read.schema("part int, version int").parquet(f"{path}/manifest/{max(done)}").collect()  # PARTS rows at most
    return max(done), {r.part: r.version for r in rows}


def _parts(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in registry.STORE.items())
    where = [f"{path}/data/{v}/part={p}" for p, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*where) if where else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The registry as of the last batch that was written whole."""
    return _parts(spark, path, _manifest(spark, path)[1])


def merge(batch: DataFrame, number: int, path: str, parts: int = PARTS, insert_filter: bool = False) -> None:
    """Merges batch number of link updates into the registry at path.

    Only parts with a URL of the batch are read and written. A batch that is repeated reads the version before it and
    writes the same again. Versions of parts that neither this batch's manifest nor the one before names are deleted.
    """
    spark = batch.sparkSession
    last, have = _manifest(spark, path, number)
    of = lambda c: F.pmod(F.xxhash64(F.lower(c)), F.lit(parts)).cast("int")
    touched = sorted(r.part for r in batch.where("url is not null").select(of("url").alias("part")).distinct().collect())
    if touched:
        rows = registry.upsert(batch, _parts(spark, path, {p: v for p, v in have.items() if p in touched}), insert_filter).drop("is_new")
        rows.withColumn("part", of("url")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/{number}")
        fs, root = _fs(spark, f"{path}/data/{number}")
        written = {int(x.getPath().getName()[5:]) for x in fs.listStatus(root) if x.getPath().getName().startswith("part=")}
    else:
        written = set()
    now = have | dict.fromkeys(written, number)
    spark.createDataFrame(sorted(now.items()), "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
    _log.info("batch %d rewrote %d of %d parts", number, len(written), parts)
    # what only the manifest before the last one names can't be read again, not even by a repeated batch
    older = _manifest(spark, path, last)[1] if last >= 0 else {}
    for p, v in older.items():
        if have.get(p) != v:
            fs, gone = _fs(spark, f"{path}/data/{v}/part={p}")
            fs.delete(gone, True)


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, parts: int = PARTS, insert_filter: bool = False):
    """Registry kept at path (see read_store): each micro-batch merges into it. Returns the writer."""
    return updates.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path, parts, insert_filter)).option("checkpointLocation", checkpoint)
