"""Boolean, phrase and positional retrieval over postings (term, doc_id, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import query as Q


def candidates(postings: DataFrame, tree) -> DataFrame:
    """(doc_id, pos): per document that has any word of the query, the map from its words to their places.

    One shuffle of the query's own postings; the filter reaches the scan.
    """
    found = postings.where(F.col("term").isin(Q.all_words(tree)))
    return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("pos"))


def match(postings: DataFrame, text: str) -> DataFrame:
    """(doc_id, pos) of the documents that match; none if the query is empty or doesn't parse."""
    try:
        tree = Q.parse(text)
    except Q.QueryParseError:
        tree = None
    if tree is None or not Q.drivable(tree):
        return candidates(postings, Q.Term("")).where(F.lit(False))
    return candidates(postings, tree).where(Q.as_column(tree, Q.map_has(F.col("pos"))))


def positions(matched: DataFrame, text: str) -> DataFrame:
    """matched with places: one list for each positive word of the query, empty where absent."""
    names = Q.positive_words(Q.parse(text))
    return matched.withColumn("places", F.transform(F.array(*map(F.lit, names)), lambda w: F.coalesce(F.col("pos")[w], F.array().cast("array<int>"))))


def all_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, pos_1, ...) of the documents that have all terms: one scan of their postings, one shuffle."""
    found = postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("pos"))
    return found.where(F.size("pos") == len(set(terms))).select("doc_id", *(F.col("pos")[t].alias(f"pos_{i}") for i, t in enumerate(terms, 1)))


def without(postings: DataFrame, wanted: str, unwanted: str) -> DataFrame:
    one = lambda t: postings.where(F.col("term") == t).select("doc_id")
    return one(wanted).join(one(unwanted), "doc_id", "left_anti")


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def phrase(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, loc): the first place of the phrase in each document that has it. Documents without all words never get to positions."""
    have = all_of(postings, terms)
    starts = F.col("pos_1")
    for i in range(2, len(terms) + 1):
        starts = F.array_intersect(starts, _shifted(F.col(f"pos_{i}"), i - 1))
    return have.select("doc_id", F.array_min(starts).alias("loc")).where("loc is not null")


def capped(matched: DataFrame, limit: int, chunk: str | None = None) -> DataFrame:
    """The first limit matches by doc_id of each chunk, or of all."""
    if chunk is None:
        return matched.orderBy("doc_id").limit(limit)
    w = Window.partitionBy(chunk).orderBy("doc_id")
    return matched.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
