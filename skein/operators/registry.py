"""URL registry and frontier: priority, keyed upsert, routing of new URLs, queue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.tables import stored
from . import index
from .rank import _tld

#: Priority (in billionths) from which a URL goes to bucket 0, 1, ...; below the last it is dropped (bucket 8).
BUCKETS = (400, 300, 200, 100, 50, 40, 30, 20)
MAX_ANCHORS = 64


def _steps(exponent: Column, floor: float) -> Column:
    """2.718 to the whole part of a negative exponent, at least floor: a step function."""
    return F.greatest(F.pow(F.lit(2.718), exponent.cast("int").cast("double")), F.lit(floor))


def priority(url: Column, seed_distance: Column, domain_dist: Column) -> Column:
    """Crawl priority, 0 to about 1.4e9."""
    https = url.startswith("https")
    rest = F.when(https, F.substring(url, 9, 1 << 20)).otherwise(F.substring(url, 8, 1 << 20))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, "^[^/?#]*(.*)$", 1)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    digits = F.length(host) - F.length(F.regexp_replace(host, "[0-9]", ""))
    slashes = F.length(tail) - F.length(F.replace(tail, F.lit("/"), F.lit("")))
    g = lambda a, b: F.greatest(a, F.lit(b))
    value = (
        F.when(https, 1.0).otherwise(0.6) * _tld(F.regexp_extract(host, r"([^.]*)$", 1), 0.8) * _steps(-0.02 * seed_distance, 0.5)
        * g((50.0 - F.octet_length(host)) / 50.0, 0.5) * (1.0 / (1.0 + 0.1 * F.greatest(dots - 1, F.lit(0)))) * (1.0 / (1.0 + 0.25 * digits))
        * g((150.0 - F.octet_length(url)) / 100.0, 0.5) * g(1.0 - 0.1 * slashes, 0.4) * F.when(tail.contains("?"), 0.75).otherwise(1.0)
        * _steps(-0.08 * domain_dist, 0.3) * 1000000000.0
    )
    return F.when((F.octet_length(url) >= 8) & url.startswith("http"), value).otherwise(0.0).cast("int")


def bucket(score: Column) -> Column:
    out = None
    for i, least in enumerate(BUCKETS):
        hit = score >= least * 1_000_000
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(len(BUCKETS))


#: What a registry row holds. eot and eod are the words of a page's title and body.
STORE = {"url": "string", "num_encountered": "bigint", "seed_distance": "int", "domain_dist": "int", "eot": "int", "eod": "int", "title": "string", "crawled": "boolean", "anchor_freqs": "map<string,bigint>"}


def as_store(rows: DataFrame, *extra: str) -> DataFrame:
    """rows with all columns of STORE, and extra ones as they are, in lower case by url: what is missing is null, anchors are an empty map."""
    have = {c: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t) for c, t in STORE.items()}
    have["url"] = F.lower("url")
    have["crawled"] = F.coalesce(have["crawled"], F.lit(False))
    have["anchor_freqs"] = F.coalesce(have["anchor_freqs"], F.create_map().cast("map<string,bigint>"))
    return rows.select(*(v.alias(c) for c, v in have.items()), *extra)


def upsert(updates: DataFrame, store: DataFrame | None = None, insert_filter: bool = False, capacity: int | None = None, first_seen: str | None = None) -> DataFrame:
    """Registry rows (STORE and is_new) after link updates (url, anchors, num_encountered, seed_distance, domain_dist).

    Keyed by lower-case URL: encounters add up, distances take the least, every anchor occurrence counts. All else that
    the store has stays as it is; URLs it didn't have are is_new. Of more than MAX_ANCHORS anchors the most frequent stay
    (ties: first in order). Updates may also bring title, eot, eod and crawled of a page; non-null ones replace the store's.

    insert_filter: new URLs must be insertable(). capacity: new URLs are taken in URL order until the registry has so many
    rows. first_seen: column that orders updates; of a new URL's first update every word counts once. Null URLs are left out.
    """
    new = updates.where("url is not null").withColumn("url", F.lower("url"))
    old = None if store is None else as_store(store).withColumn("__old", F.lit(True))
    anchors = F.col("anchors")
    if first_seen:
        nth = F.row_number().over(Window.partitionBy("url").orderBy(first_seen))
        new = new.withColumn("__first", nth == 1)
        if old is not None:
            new = new.join(old.select("url", F.lit(True).alias("__known")), "url", "left").withColumn("__first", F.col("__first") & F.col("__known").isNull())
        anchors = F.when(F.col("__first"), F.array_distinct("anchors")).otherwise(F.col("anchors"))
    words = new.select("url", F.explode(anchors).alias("word")).groupBy("url", "word").agg(F.count("*").alias("n"))
    page = [c for c in ("title", "eot", "eod", "crawled") if c in updates.columns]
    base = new.groupBy("url").agg(F.sum("num_encountered").alias("__n"), F.min("seed_distance").alias("__s"), F.min("domain_dist").alias("__d"), *(F.max(c).alias(f"__{c}") for c in page))
    if old is None:
        old = as_store(base.select("url").limit(0)).withColumn("__old", F.lit(True))
    else:
        words = words.unionByName(old.select("url", F.explode("anchor_freqs").alias("word", "n"))).groupBy("url", "word").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("n"), "word"))
    freqs = words.withColumn("r", top).where(F.col("r") <= MAX_ANCHORS).groupBy("url").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "n")))).alias("__anchors"))
    both = old.join(base, "url", "full").join(freqs, "url", "left")
    out = both.select(
        "url", (F.coalesce("num_encountered", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("num_encountered"), F.least("seed_distance", "__s").cast("int").alias("seed_distance"),
        F.least("domain_dist", "__d").cast("int").alias("domain_dist"), *((F.coalesce(f"__{c}", c) if c in page else F.col(c)).alias(c) for c in ("eot", "eod", "title")),
        F.coalesce(*(["__crawled"] if "crawled" in page else []), "crawled", F.lit(False)).alias("crawled"),
        F.coalesce("__anchors", F.create_map().cast("map<string,bigint>")).alias("anchor_freqs"), F.col("__old").isNull().alias("is_new"),
    )
    if insert_filter:
        out = out.where(~F.col("is_new") | _insertable())
    if capacity is not None:
        room = max(0, capacity - out.where("not is_new").count())
        out = out.where("not is_new").unionByName(out.where("is_new").orderBy("url").limit(room))
    return out


def lookup(urls: DataFrame, store: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with what the registry says of each: has_url, has_crawled, num_encountered, seed_distance (65535 where
    unknown), title, anchor_freqs and domain_dist (null where unknown)."""
    own = as_store(store).select(F.col("url").alias("__key"), *(F.col(c).alias(f"__{c}") for c in ("crawled", "num_encountered", "seed_distance", "domain_dist", "title", "anchor_freqs")))
    got = urls.join(own, F.lower(url_col) == F.col("__key"), "left")
    return got.select(
        *urls.columns, F.col("__key").isNotNull().alias("has_url"), F.coalesce("__crawled", F.lit(False)).alias("has_crawled"), F.coalesce("__num_encountered", F.lit(0)).cast("long").alias("num_encountered"),
        F.coalesce("__seed_distance", F.lit(65535)).alias("seed_distance"), F.col("__domain_dist").alias("domain_dist"), F.coalesce("__title", F.lit("")).alias("title"), F.col("__anchor_freqs").alias("anchor_freqs"),
    )


def size_statistics(store: DataFrame, shards: int = 1) -> DataFrame:
    """(shard, n_urls, n_crawled, url_bytes, title_bytes, n_anchors) of a registry split by URL."""
    of = F.lit(0) if shards == 1 else U.shard(F.col("url"), shards)
    return as_store(store).groupBy(of.alias("shard")).agg(
        F.count("*").alias("n_urls"), F.count_if("crawled").alias("n_crawled"), F.sum(F.octet_length("url")).cast("long").alias("url_bytes"),
        F.sum(F.octet_length(F.coalesce("title", F.lit("")))).cast("long").alias("title_bytes"), F.sum(F.size("anchor_freqs")).cast("long").alias("n_anchors"),
    )


def _insertable() -> Column:
    # a bucket below the last means a priority of at least the last bound, which is tested once
    usable = priority(F.col("url"), F.col("seed_distance"), F.col("domain_dist")) >= BUCKETS[-1] * 1_000_000
    return usable & ~U.blocked_keyword(F.col("url"))


def insertable(rows: DataFrame) -> DataFrame:
    """Rows a registry would take as new: a usable priority and no blocked keyword."""
    return rows.where(_insertable())


def unseen(updates: DataFrame, store: DataFrame) -> DataFrame:
    """URLs of updates that the registry doesn't have, with priority bucket."""
    new = updates.select(F.lower("url").alias("url"), "seed_distance", "domain_dist").groupBy("url").agg(F.min("seed_distance").alias("seed_distance"), F.min("domain_dist").alias("domain_dist"))
    found = insertable(new).join(store.select("url"), "url", "left_anti")
    return found.withColumn("bucket", bucket(priority(F.col("url"), F.col("seed_distance"), F.col("domain_dist"))))


def with_hops(links: DataFrame, seed_hops: str | None = None, domain_hops: str | None = None) -> DataFrame:
    """links (src_url, url) with hop counts: one more than the source page's (column seed_hops, 0 without one), and the
    source's domain hops (column domain_hops), one more if the domain differs."""
    own = lambda c: F.lit(0) if c is None else F.coalesce(F.col(c).cast("int"), F.lit(0))
    differs = (U.domain(F.col("src_url")) != U.domain(F.col("url"))).cast("int")
    return links.withColumns({"seed_hops": own(seed_hops) + 1, "domain_hops": own(domain_hops) + differs})


def update_fields(store: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """store with the non-null fields of changes (by url); URLs the store doesn't have are ignored."""
    c = changes.select(F.lower("url").alias("url"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = store.join(c, "url", "left")
    return joined.select(*(F.coalesce(f"__{x}", x).alias(x) if x in fields else x for x in store.columns))


def per_domain(frontier: DataFrame, cap: int) -> DataFrame:
    """At most cap targets a domain, best bucket first, then by url."""
    w = Window.partitionBy("domain").orderBy("bucket", "url")
    return frontier.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= cap)


def best_bucket(frontier: DataFrame) -> DataFrame:
    low = frontier.agg(F.min("bucket").alias("bucket"))
    return frontier.join(F.broadcast(low), "bucket", "left_semi")


def feed(frontier: DataFrame, slots: int) -> DataFrame:
    """The best bucket that isn't empty with goes_to: "carousel" for slots targets a domain, "backoff" for the rest."""
    w = Window.partitionBy("domain").orderBy("url")
    return best_bucket(frontier).withColumn("goes_to", F.when(F.row_number().over(w) <= slots, "carousel").otherwise("backoff"))


#: Targets that a bucket of the frontier holds.
BUCKET_SLOTS = 1 << 24


def spilled(frontier: DataFrame, arrival: str, slots: int = BUCKET_SLOTS) -> DataFrame:
    """frontier with the bucket each target is pushed to: its own, or the next that has a free slot when it
    arrives; len(BUCKETS), which drops it, if none has. arrival: whole numbers in the order of coming.

    One step a bucket: of those that it or the one before passes on, the first slots stay.
    """
    done = frontier.where(F.col("bucket") >= len(BUCKETS))
    passed = frontier.limit(0)
    for b in range(len(BUCKETS)):
        here = frontier.where(F.col("bucket") == b).unionByName(passed.withColumn("bucket", F.lit(b).cast(frontier.schema["bucket"].dataType)))
        placed = stored(index.ranked(here, arrival), "spill")  # else the plan would double with each bucket
        done = done.unionByName(placed.where(F.col("__rank") <= slots).drop("__rank"))
        passed = placed.where(F.col("__rank") > slots).drop("__rank")
    return done.unionByName(passed.withColumn("bucket", F.lit(len(BUCKETS)).cast(frontier.schema["bucket"].dataType)))


def pop_order(frontier: DataFrame, arrival: str) -> DataFrame:
    """frontier with place: inside a bucket the last that came is first. No bucket is ordered by one task."""
    placed = index.ranked(frontier, arrival, "bucket")
    many = frontier.groupBy("bucket").agg(F.count("*").alias("__many"))
    return placed.join(F.broadcast(many), "bucket").withColumn("place", (F.col("__many") - F.col("__rank") + 1).cast("int")).drop("__many", "__rank")


def within_quota(pages: DataFrame, arrival: str, quota: int = 1 << 20) -> DataFrame:
    """The first quota pages by arrival: where a crawl stops."""
    return index.ranked(pages, arrival).where(F.col("__rank") <= quota).drop("__rank")


def polite(frontier: DataFrame, gap: int = 2) -> DataFrame:
    """Earliest start second of each target with one request a domain every gap seconds."""
    w = Window.partitionBy("domain").orderBy("bucket", "url")
    return frontier.withColumn("start_s", (F.row_number().over(w) - 1) * gap)
