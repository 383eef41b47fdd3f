"""robots.txt: statements to rule rows, and the rule that decides each URL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"^\s*(user-agent|allow|disallow|crawl-delay|sitemap)\s*:\s*([^#\r\n]*)", re.I)


def _decoded(value: str) -> str:
    """%xx decoded as UTF-8, but for an escaped slash; bytes that aren't UTF-8 stay escaped."""
    return re.sub(r"(?:%(?!2[fF])[0-9a-fA-F]{2})+", lambda m: _utf8(bytes.fromhex(m[0].replace("%", "")), m[0]), value)


def _utf8(raw: bytes, escaped: str) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return escaped


def parse(host: str, text: str, empty_disallow_blocks: bool = True) -> list[tuple]:
    """(host, agent, kind, pattern, literal_bytes, ends_dollar, regex) rows. Consecutive agents share what follows.

    An empty Disallow blocks everything here, unlike the usual convention, unless told otherwise.
    """
    rows: list[tuple] = []
    agents: list[str] = []
    closed = False
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        kind, value = m[1].lower(), m[2].strip()
        if kind == "user-agent":
            if closed:
                agents, closed = [], False
            agents.append(value.lower())
            continue
        if kind == "sitemap":
            rows.append((host, "*", kind, value, 0, False, ""))
            continue
        closed = True
        if kind == "disallow" and not value and not empty_disallow_blocks:
            continue
        pattern = _decoded(value[1:] if value.startswith("/") else value) if kind != "crawl-delay" else value
        dollar = pattern.endswith("$")
        body = pattern[:-1] if dollar else pattern
        regex = "^" + ".*".join(re.escape(x) for x in body.split("*")) + ("$" if dollar else "")
        rows += [(host, a, kind, pattern, len(pattern.replace("*", "").encode()), dollar, regex) for a in agents]
    return rows


SCHEMA = "host string, agent string, kind string, pattern string, literal_bytes int, ends_dollar boolean, regex string"


def rules(files: DataFrame) -> DataFrame:
    """Rule rows of files (host, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for h, b in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist()) for r in parse(h, b or "")]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("host", "body").mapInArrow(run, SCHEMA)


def decide(targets: DataFrame, rule: DataFrame, user_agent: str) -> DataFrame:
    """targets (url, host, path) with allowed. Of the rules that apply: most literal bytes, then an end mark,
    then allow, then a named agent; without one the URL is allowed."""
    mine = rule.where(F.col("kind").isin("allow", "disallow") & ((F.col("agent") == "*") | F.lit(user_agent.lower()).contains(F.col("agent"))))
    path = F.regexp_replace("path", "^/", "")
    hits = targets.join(mine.withColumnRenamed("host", "__host"), (F.col("host") == F.col("__host")) & F.regexp_like(path, F.col("regex")))
    order = F.struct("literal_bytes", "ends_dollar", (F.col("kind") == "allow").alias("allow"), (F.col("agent") != "*").alias("named"))
    best = hits.groupBy("url").agg(F.max(order).alias("best"))
    return targets.join(best, "url", "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).drop("best")


def site_settings(rule: DataFrame) -> DataFrame:
    """(host, crawl_delay, sitemaps): the largest delay that any rule of a host gives, null if none, and its distinct sitemaps in order."""
    delay = F.when(F.col("kind") == "crawl-delay", F.col("pattern").try_cast("double"))
    site = F.when(F.col("kind") == "sitemap", F.col("pattern"))
    return rule.groupBy("host").agg(F.max(delay).alias("crawl_delay"), F.sort_array(F.collect_set(site)).alias("sitemaps"))
