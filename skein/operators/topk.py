"""Bounded results: per group, overall, merged, paged. Equal scores are ordered by url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 10


def _order(tie: str) -> list[Column]:
    return [F.desc("score"), F.col(tie)]


def top(df: DataFrame, k: int = LIMIT, tie: str = "url") -> DataFrame:
    return df.orderBy(*_order(tie)).limit(k)


def top_per(df: DataFrame, group: str, k: int = LIMIT, tie: str = "url") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*_order(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge(parts: list[DataFrame], k: int = LIMIT, tie: str = "url") -> DataFrame:
    """Top k of several results; URLs that come twice stay twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, k, tie)


def page(df: DataFrame, number: int, size: int = LIMIT, tie: str = "url") -> DataFrame:
    return df.orderBy(*_order(tie)).offset((max(number, 1) - 1) * size).limit(size)
