"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import langid, packing, simhash, suffix, toxicity
from skein.llm.common import bound_batches, discard, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose code length under some language's context tree is plausible."""
    return langid.keep_known(docs, langid.train(table(spark, sf_dir, "documents")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression distance calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    bound_batches(spark)
    return simhash.keep_first(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document or earlier in the same one; drops what is left without words."""
    bound_batches(spark)
    return suffix.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids in document order, with the documents whose tokens they are."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("packing", pack),
]
#: Compression lengths, suffix order and the packing program can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one has read it."""
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if spent is not None:
            discard(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
