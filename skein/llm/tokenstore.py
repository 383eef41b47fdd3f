"""Token ids as Parquet: list columns with dictionary or delta encoding, bounded row groups, page indexes.

Files are written by Spark's own committed writer, so lost tasks are repeated and half-written
files never count. Rows are in doc_id order inside a file, pages are short and carry their least
and greatest doc_id: a range read skips row groups and pages, a metadata read never touches the
pages of the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import slices

#: Bytes of a row group, rows and bytes of a page.
ROW_GROUP, PAGE_ROWS, PAGE_BYTES = 16 << 20, 512, 128 << 10


def options(encoding: str = "dictionary", row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES) -> dict[str, str]:
    """Writer options. dictionary: ids as indices into a dictionary page, bit-packed; delta: differences, bit-packed."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    return {
        # version 2 pages: without a dictionary their integers are delta encoded
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.page.size": str(page_bytes),
        "parquet.columnindex.truncate.length": "64",
        "compression": "zstd",
    }


def write(tokens: DataFrame, path: str, encoding: str = "dictionary", clustered: bool = False, **sizes: int) -> None:
    """Write rows with doc_id and ids (and any metadata columns) to path, which must not exist.

    Rows are in doc_id order inside a file, null ids first; repeated rows are stored each and null lists stay
    null; an empty table makes a table without rows. A range read opens only the files whose ids it
    overlaps: few, where the input comes in doc_id order, as most tables do, or with clustered, which
    shuffles the rows into ranges of doc_id first (a range holds one id's rows even if they are many).
    """
    rows = tokens.repartitionByRange("doc_id") if clustered else tokens
    rows.sortWithinPartitions("doc_id").write.options(**options(encoding, **sizes)).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the tokens, a row for each stored one, nulls as stored; the tokens' pages aren't read."""
    df = spark.read.parquet(path)
    return df.select([c for c in df.columns if c != "ids"])


def tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, ids), of a range of doc_ids if given; row groups and pages outside it are skipped.

    A range leaves out rows without an id; without one all rows come, repeated ones too.
    """
    df = spark.read.parquet(path).select("doc_id", "ids")
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def encode_with_metadata(docs: DataFrame, model: str = pieces.MODEL) -> DataFrame:
    """Per row of docs: doc_id, lang, source, n_tokens, ids.

    Null and empty texts have no ids; null ids and metadata stay null, and so do lang and source where docs
    has no such column; repeated rows are stored each; further columns are left out. Ids are
    whole numbers (others make the cast fail). One pass, nothing shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.Pieces.load(model)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = own.encode(part.column("text"))
                size = pa.array((offsets[1:] - offsets[:-1]).astype("int32"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), size, pieces._list(ids, offsets)], ["doc_id", "lang", "source", "n_tokens", "ids"])

    extra = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long"), *extra, "text").mapInArrow(run, "doc_id long, lang string, source string, n_tokens int, ids array<int>")
