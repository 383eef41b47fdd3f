"""What becomes of crawl targets: the worker's checks in their order, and what its answers change in the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.fetch import FAILED, REFUSED, TOO_MANY
from . import registry

#: Bytes below which a page is too thin to be parsed.
LEAST_BYTES = 3072


def outcomes(targets: DataFrame, store: DataFrame, allowed: DataFrame, answers: DataFrame) -> DataFrame:
    """targets (url, ...) with outcome: the first check that a target fails, or "parsed".

    In order: not https, blocked keyword, crawled (by the registry store), disallowed (url isn't in allowed), failed, busy
    (429: dropped, not queued again), refused, thin. answers: (url, status) as fetch gives them; a target without an answer
    failed. URLs of store are compared in lower case, others as they are.
    """
    known = registry.as_store(store).where("crawled").select(F.col("url").alias("__known"))
    may = allowed.select(F.col("url").alias("__may")).distinct()
    got = answers.groupBy(F.col("url").alias("__got")).agg(F.max("status").alias("__status"))
    joined = targets.join(known, F.lower("url") == F.col("__known"), "left").join(may, F.col("url") == F.col("__may"), "left").join(got, F.col("url") == F.col("__got"), "left")
    status = F.coalesce("__status", F.lit(FAILED))
    outcome = (
        F.when(~F.col("url").startswith("https://"), "not https").when(U.blocked_keyword(F.col("url")), "blocked").when(F.col("__known").isNotNull(), "crawled")
        .when(F.col("__may").isNull(), "disallowed").when(status == TOO_MANY, "busy").when(status == REFUSED, "refused").when(status < 0, "failed")
        .when(status < LEAST_BYTES, "thin").otherwise("parsed")
    )
    return joined.select(*targets.columns, outcome.alias("outcome"))


def crawled_marks(done: DataFrame) -> DataFrame:
    """Changes for registry.update_fields: pages that came, thin or not, are crawled."""
    return done.where(F.col("outcome").isin("thin", "parsed")).select("url", F.lit(True).alias("crawled")).distinct()
