"""Relevance factors as native columns, over rows of one candidate each.

Row: url, title, doc_len, n_seen, seed_distance, domain_dist, anchor_freqs (map word -> count),
places (array of ascending places, one a query word). A query's words and their document
frequencies are literals: words, freqs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import tld_weights
from ..functions import urls as U

DYNAMIC_SHARE = 0.72
WEIGHTS = {"proximity": 7, "times_seen": 8, "title": 15, "anchor": 8, "path": 12, "rarity_freq": 8, "phrase_bonus": 8, "early": 6, "host": 12, "slug": 10, "homepage": 10, "label": 10}
DYNAMIC_TOTAL = 114.0
STATIC_TOTAL = 30.0


def rarity(freqs: list[int]) -> list[float]:
    import math

    return [1 / (1 + math.log(1 + f)) for f in freqs]


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0.0))


def _weighted(hits: list[Column], freqs: list[int]) -> Column:
    rw = rarity(freqs)
    return _sum([F.when(h, F.lit(r)).otherwise(0.0) for h, r in zip(hits, rw)]) / F.lit(sum(rw))


def _empty(a: Column) -> Column:
    return F.size(a) == 0


def _adding_nearest(b: Column):
    """Adds to a sum 1/d of a place's distance d to the nearest one in b, if that is 1 to 20."""

    def add(s: Column, p: Column) -> Column:
        d = F.array_min(F.transform(b, lambda x: F.abs(p - x)))
        return s + F.when((d >= 1) & (d <= 20), 1.0 / d).otherwise(0.0)

    return add


def proximity(places: Column, n: int, doc_len: Column) -> Column:
    top, bottom, some = [], [], []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = places[i], places[j]
            both = ~_empty(a) & ~_empty(b)

            total = F.aggregate(a, F.lit(0.0), _adding_nearest(b))
            top.append(F.when(both, F.log(1 + total)).otherwise(0.0))
            bottom.append(F.when(both, F.log(1 + F.least(F.size(a), F.size(b)) / F.lit(float(j - i)))).otherwise(0.0))
            some.append(both)
    if not some:
        return F.lit(0.0)
    value = F.least(F.greatest(_sum(top) / _sum(bottom), F.lit(0.0)), F.lit(1.0))
    return F.when(reduce(lambda a, b: a | b, some) & (doc_len > 0), value).otherwise(0.0)


def times_seen(n_seen: Column) -> Column:
    return 1 / (1 + F.exp(-0.06 * (n_seen - 40)))


def title_match(title: Column, words: list[str], freqs: list[int]) -> Column:
    return _weighted([F.lower(title).contains(w) for w in words], freqs) * F.exp(-0.01 * F.octet_length(title))


def anchor(anchors: Column) -> Column:
    """Every anchor counts, whatever the query."""
    total = F.aggregate(F.map_values(anchors), F.lit(0).cast("long"), lambda s, x: s + x)
    kinds = F.size(anchors)
    volume = F.log(1.0 + total)
    return F.when((kinds > 0) & (total > 0), (volume / (volume + 2)) * (kinds / (kinds + 2.0))).otherwise(0.0)


def after_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#:]*)", 1)


def path_match(url: Column, words: list[str], freqs: list[int]) -> Column:
    return _weighted([F.lower(after_host(url)).contains(w) for w in words], freqs) * F.exp(-0.01 * F.octet_length(url))


def rarity_freq(places: Column, freqs: list[int]) -> Column:
    import math

    x = [-math.log(1 + f) for f in freqs]
    low, high = min(x), max(x)
    w = [1.0 if high == low else 0.2 + 0.8 * (v - low) / (high - low) for v in x]
    s = _sum([F.lit(k) * (1 - F.exp(-0.2 * F.size(places[i]))) for i, k in enumerate(w)]) / F.lit(sum(w))
    return 0.1 + 0.9 * s


def phrase_bonus(places: Column, n: int) -> Column:
    if n < 2:
        return F.lit(0.0)
    hits = _sum([F.size(F.array_intersect(F.transform(places[i], lambda a: a + 1), places[i + 1])) for i in range(n - 1)])
    return 1 - F.exp(-0.5 * hits / F.lit(float(n - 1)))


def early(places: Column, freqs: list[int], doc_len: Column) -> Column:
    rw = rarity(freqs)
    top, bottom = [], []
    for i, r in enumerate(rw):
        here = ~_empty(places[i])
        share = F.least(F.greatest(1 - F.array_min(places[i]) / doc_len, F.lit(0.0)), F.lit(1.0))
        top.append(F.when(here, r * share).otherwise(0.0))
        bottom.append(F.when(here, F.lit(r)).otherwise(0.0))
    return F.when((doc_len > 0) & (_sum(bottom) > 0), _sum(top) / _sum(bottom)).otherwise(0.0)


def host_match(url: Column, words: list[str], freqs: list[int]) -> Column:
    return _weighted([F.lower(host_of(url)).contains(w) for w in words], freqs)


def slug(url: Column, words: list[str], freqs: list[int]) -> Column:
    s = F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]*)", 1))
    hits = [(s == w) | s.startswith(w + "-") | s.startswith(w + "_") | s.startswith(w + ".") for w in words]
    return F.when(s.contains(":"), 0.0).otherwise(_weighted(hits, freqs)) * host_match(url, words, freqs)


def homepage(url: Column, words: list[str], freqs: list[int]) -> Column:
    return F.when(after_host(url).isin("", "/"), host_match(url, words, freqs)).otherwise(0.0)


def label(url: Column, words: list[str], freqs: list[int]) -> Column:
    """Each host label adds the weight of the first word equal to it; more than one may."""
    rw = rarity(freqs)
    parts = F.split(F.lower(host_of(url)), r"\.")

    def weight(x: Column) -> Column:
        out = None
        for w, r in zip(words, rw):
            out = F.when(x == w, F.lit(r)) if out is None else out.when(x == w, F.lit(r))
        return out.otherwise(0.0)

    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + weight(x)) / F.lit(sum(rw))


def factors(words: list[str], freqs: list[int]) -> dict[str, Column]:
    c = F.col
    n = len(words)
    return {
        "proximity": proximity(c("places"), n, c("doc_len")), "times_seen": times_seen(c("n_seen")), "title": title_match(c("title"), words, freqs),
        "anchor": anchor(c("anchor_freqs")), "path": path_match(c("url"), words, freqs), "rarity_freq": rarity_freq(c("places"), freqs),
        "phrase_bonus": phrase_bonus(c("places"), n), "early": early(c("places"), freqs, c("doc_len")), "host": host_match(c("url"), words, freqs),
        "slug": slug(c("url"), words, freqs), "homepage": homepage(c("url"), words, freqs), "label": label(c("url"), words, freqs),
    }


def dynamic_score(words: list[str], freqs: list[int]) -> Column:
    return _sum([WEIGHTS[k] * f for k, f in factors(words, freqs).items()]) / DYNAMIC_TOTAL


def _tld(ext: Column, default: float) -> Column:
    by: dict[float, list[str]] = {}
    for k, v in tld_weights().items():
        by.setdefault(v, []).append(k)
    out = None
    for v, names in by.items():
        out = F.when(ext.isin(names), v) if out is None else out.when(ext.isin(names), v)
    return out.otherwise(default)


def static_score(url: Column, seed_distance: Column, domain_dist: Column) -> Column:
    """Query-independent score. The scan starts at byte 8 for every scheme, so http:// hosts lose a character."""
    rest = F.substring(url, 9, 1 << 20)
    host = F.regexp_extract(rest, "^([^/?#:]*)", 1)
    tail = F.regexp_extract(rest, "^[^/?#:]*(.*)$", 1)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    digits = F.length(host) - F.length(F.regexp_replace(host, "[0-9]", ""))
    slashes = F.length(tail) - F.length(F.replace(tail, F.lit("/"), F.lit("")))
    g = lambda a, b: F.greatest(a, F.lit(b))
    return (
        7 * g(F.exp(-0.08 * (domain_dist + 1)), 0.05) + 4 * _tld(F.regexp_extract(host, r"([^.]*)$", 1), 0.2)
        + 1 * g(F.exp(-0.04 * (seed_distance + 1)), 0.05) + 3 * g((50.0 - F.octet_length(host)) / 50.0, 0.2) + 3 / (1 + 0.1 * dots)
        + 2 / (1 + 0.15 * digits) + 3 * g((150.0 - F.octet_length(url)) / 100.0, 0.2) + 4 * g(1.0 - 0.1 * slashes, 0.2)
        + 3 * F.when(tail.contains("?"), 0.0).otherwise(1.0)
    ) / STATIC_TOTAL


def total_score(words: list[str], freqs: list[int]) -> Column:
    s = static_score(F.col("url"), F.col("seed_distance"), F.col("domain_dist"))
    return s * (1 - DYNAMIC_SHARE) + dynamic_score(words, freqs) * DYNAMIC_SHARE


def bm25(tf: Column, doc_len: Column, df: Column, n: Column, k1: float = 1.2, b: float = 0.75, mean: float = 500.0) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / mean))


def enrich(found: DataFrame, registry: DataFrame, key: str | None = None) -> DataFrame:
    """Candidates (url, ...) with their registry row: n_seen, seed_distance, domain_dist, anchor_freqs, and its title unless
    they bring one. Those without a row, and those on gibberish hosts, go.

    key: a column of both to join by in place of the URL, where pages may share one and each has a row of its own."""
    of = (lambda: F.lower("url")) if key is None else (lambda: F.col(key))
    own = registry.select(
        of().alias("__key"), F.col("num_encountered").alias("n_seen"), "seed_distance", "domain_dist", F.coalesce("anchor_freqs", F.create_map().cast("map<string,bigint>")).alias("anchor_freqs"),
        *([] if "title" in found.columns else [F.coalesce("title", F.lit("")).alias("title")]),
    )
    return found.where(~U.gibberish(U.bare_host(F.col("url")))).join(own, of() == F.col("__key")).drop("__key")


def misses(found: DataFrame, registry: DataFrame) -> DataFrame:
    """(total, misses): candidates, and those without a registry row."""
    own = registry.select(F.lower("url").alias("__key"), F.lit(True).alias("__there"))
    return found.join(own, F.lower("url") == F.col("__key"), "left").agg(F.count("*").alias("total"), F.count_if(F.col("__there").isNull()).alias("misses"))


def score_of(urls: DataFrame, candidates: DataFrame, words: list[str], freqs: list[int], url_col: str = "url", key: str = "url") -> DataFrame:
    """urls with score: that of the candidate whose key (its URL by default) is in url_col, the best where several share it, -1 where there is none."""
    own = candidates.groupBy(F.col(key).alias("__url")).agg(F.max(total_score(words, freqs)).alias("score"))
    return urls.join(own, F.col(url_col) == F.col("__url"), "left").withColumn("score", F.coalesce("score", F.lit(-1.0))).drop("__url")
