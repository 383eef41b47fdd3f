"""Worked values of text, URL, scoring and frontier functions."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import crawl, html, rank, registry, robots


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) else 'int'}" for i, v in enumerate(values)))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


WORDS = {"foo* bar": ["foobar"], "and/or": ["andor"], "1,000": ["1000"], "can't": ["cant"], "sci-fi": ["sci", "fi"], "3.14 a.b": ["314", "a", "b"], "": [], "Héllo": ["hllo"], "x y": ["x", "y"]}


@pytest.mark.parametrize("text", WORDS)
def test_words(spark, text):
    assert one(spark, T.words_of, text) == WORDS[text]
    assert html.scan(text.encode(), cut_unknown=False).words == WORDS[text]


@pytest.mark.parametrize(("w", "s"), [("running", "run"), ("jumped", "jump"), ("falling", "fall"), ("quickly", "quick"), ("hopeful", "hope"), ("darkness", "dark"), ("boxes", "box"), ("cats", "cat"), ("teacher", "teach"), ("sing", "sing"), ("red", "red"), ("stopped", "stop"), ("passing", "pass"), ("buzzing", "buzz")])
def test_stem(spark, w, s):
    assert one(spark, T.stem, w) == s


NORMAL = {
    "https://www.Example.com/A/": "https://example.com/A", "http://example.com": "http://example.com/", "https://example.com:443/x#top": "https://example.com/x",
    "https://example.com:8080/x": None, "HTTP://example.com/": None, "https://example.com/a?b=1": None, "https://example.com/x.PNG": None, "https://example.xyz/": None,
    "https://fr.example.com/": None, "https://example.com/de/x": None, "https://co.pinterest.com/a": None, "https://bcdfghjklmn.com/": None, "https://example.com/termsheet": None,
    "https://example.com/1/2/3/4/5/6/7/8/9": None, "https://example.com/a%20b": None, "ftp://example.com/": None,
}


@pytest.mark.parametrize("url", NORMAL)
def test_normalize(spark, url):
    assert one(spark, U.normalize, url) == NORMAL[url]


@pytest.mark.parametrize(
    ("url", "seed", "dom", "value", "bucket"),
    [
        ("https://mit.edu", 1, 0, 1393200000, 0), ("https://example.com", 0, 0, 1021800000, 0), ("https://example.com", 49, 12, 1021800000, 0), ("https://example.com", 50, 13, 187969094, 3),
        ("https://example.com", 50, 25, 153270000, 3), ("https://a.b.c.d.example123.com", 0, 0, 274285714, 2), ("http://example123.biz", 50, 0, 127378285, 3), ("ftp://x.com/aaaa", 0, 0, 0, 8),
    ],
)
def test_priority(spark, url, seed, dom, value, bucket):
    got = one(spark, registry.priority, url, seed, dom)
    assert abs(got - value) <= 1
    assert one(spark, lambda a, b, c: registry.bucket(registry.priority(a, b, c)), url, seed, dom) == bucket


def test_scores(spark):
    assert one(spark, lambda u: rank.static_score(u, F.lit(0), F.lit(0)), "https://example.com/") == pytest.approx(28.989874 / 30, abs=1e-6)
    assert one(spark, lambda n: rank.times_seen(n), 40) == pytest.approx(0.5)
    places = F.array(F.array(F.lit(1), F.lit(5)), F.array(F.lit(2), F.lit(9)))
    assert one(spark, lambda _: rank.phrase_bonus(places, 2), 0) == pytest.approx(1 - math.exp(-0.5))
    places = F.array(F.array(F.lit(10), F.lit(30)), F.array(F.lit(11), F.lit(60)))
    assert one(spark, lambda _: rank.proximity(places, 2, F.lit(100)), 0) == pytest.approx(0.654574, abs=1e-6)


def test_scan():
    page = b'<html><title>A Page</title><script>var x = "</p>";</script><!-- no --><p>one two&amp;three can&rsquo;t <foo bar</p><a  href="/x/y">Go <b>There</b></a> end<a href=\'n\'>no</a>tail'
    got = html.scan(page, "https://h.com/p/q", cut_unknown=False)
    assert got.words == ["a", "page", "one", "two", "three", "cant", "<foo", "bar", "go", "there", "end", "no"]
    assert got.title == " A Page" and got.title_words == 2 and got.links == [("https://h.com/x/y", ["go", "there"])]
    assert html.scan(b"<p>" + b"*" * 200 + b"after</p>").body_words is None
    assert html.scan(b"<p>" + b"zzqq " * 50 + b"</p>").body_words is None
    assert len(html.scan(b"<p>" + b"zzqq " * 50 + b"</p>").words) == 20
    assert html.scan(b"").words == []


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok$\n\nUser-agent: bot\nDisallow: /*.cgi\nAllow: /a%2fb\n"
    rule = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"))
    paths = {"private/x": False, "private/ok": True, "private/okay": False, "run.cgi": False, "free": True}
    df = spark.createDataFrame([(f"http://h/{p}", "h", p) for p in paths], "url string, host string, path string")
    assert {r.path: r.allowed for r in robots.decide(df, rule, "bot/1").collect()} == paths
    assert {r.path: r.allowed for r in robots.decide(df, rule, "other").collect()}["run.cgi"]
    assert robots.parse("h", "User-agent: *\nDisallow:\n")[0][3] == "" and robots.parse("h", "User-agent: *\nDisallow:\n", False) == []


def test_upsert(spark):
    kind = "url string, anchors array<string>, num_encountered long, seed_distance int, domain_dist int"
    first = registry.upsert(spark.createDataFrame([("HTTP://A/", ["x", "x"], 1, 3, 2), ("http://a/", ["y"], 2, 5, 1)], kind))
    assert [(r.url, r.num_encountered, r.seed_distance, r.domain_dist, r.anchor_freqs) for r in first.collect()] == [("http://a/", 3, 3, 1, {"x": 2, "y": 1})]
    again = registry.upsert(spark.createDataFrame([("http://a/", ["y"], 1, 9, 9), ("http://b/", [], 1, 1, 1)], kind), first)
    assert {r.url: (r.num_encountered, r.anchor_freqs) for r in again.collect()} == {"http://a/": (4, {"x": 2, "y": 2}), "http://b/": (1, {})}


def test_nested_anchor_words(spark):
    pages = spark.createDataFrame([(1, '<a href="/x"><b>Big</b> <i>day</i></a><a class=q href="/y">plain</a><a href="/z"></a>')], "page_id long, html string")
    assert sorted((r.href, r.word) for r in html.anchor_words(pages).collect()) == [("/x", "big"), ("/x", "day"), ("/y", "plain")]


def test_embeds(spark):
    pages = spark.createDataFrame([(1, '<embed type="x" src="/a.swf"><EMBED src="b">'), (2, "<embed>"), (3, None)], "page_id long, html string")
    assert sorted(tuple(r) for r in html.embeds(pages).collect()) == [(1, "/a.swf"), (1, "b")]
    assert [u for u, _ in html.scan(b'<embed src="/a.swf">', "http://h/p").links] == ["/a.swf"]


def test_robots_decode():
    assert robots._decoded("/caf%C3%A9/%2f%20x%2") == "/caf\u00e9/%2f x%2" and robots._decoded("%ff%41") == "%ff%41" and robots._decoded("%41%2Fb") == "A%2Fb"


def test_robots_settings(spark):
    body = "User-agent: *\nCrawl-delay: 2\nCrawl-delay: bad\nSitemap: b\nUser-agent: z\nCrawl-delay: 9.5\nSitemap: a\nSitemap: a"
    rows = robots.site_settings(robots.rules(spark.createDataFrame([("h", body), ("k", "Disallow: /"), ("m", "User-agent: *\nDisallow: /x")], "host string, body string"))).collect()
    assert {r.host: (r.crawl_delay, r.sitemaps) for r in rows} == {"h": (9.5, ["a", "b"]), "m": (None, [])}


def test_hops(spark):
    links = spark.createDataFrame([("http://a.com/1", "http://a.com/2", 3, 2), ("http://a.com/1", "http://b.com/", None, None)], "src_url string, url string, s int, d int")
    assert [(r.seed_hops, r.domain_hops) for r in registry.with_hops(links, "s", "d").collect()] == [(4, 2), (1, 1)]
    assert [(r.seed_hops, r.domain_hops) for r in registry.with_hops(links).collect()] == [(1, 0), (1, 1)]


def test_enrich_drops_what_the_registry_lacks(spark):
    found = spark.createDataFrame([("http://A.com/", 1), ("http://b.com/", 2), ("http://bcdfghjklmn.com/", 3)], "url string, page_id long")
    store = spark.createDataFrame([("http://a.com/", 7, 1, 0, "T"), ("http://bcdfghjklmn.com/", 1, 1, 1, "T")], "url string, num_encountered long, seed_distance int, domain_dist int, title string").withColumn("anchor_freqs", F.lit(None).cast("map<string,bigint>"))
    assert [(r.page_id, r.n_seen, r.title, r.anchor_freqs) for r in rank.enrich(found, store).collect()] == [(1, 7, "T", {})]
    assert tuple(rank.misses(found, store).first()) == (3, 1)


def test_rarest_first_and_places(spark):
    df = spark.createDataFrame([(["b", "a", "c", "b", "new"], {"a": 5, "b": 5, "c": 1}, [2, 4, 9])], "w array<string>, n map<string,bigint>, p array<int>")
    r = df.select(T.rarest_first(F.col("w"), F.col("n")).alias("w"), T.place_in_sorted(F.col("p"), F.lit(9)).alias("at"), T.place_in_sorted(F.col("p"), F.lit(3)).alias("none")).first()
    assert (r.w, r.at, r.none) == (["new", "c", "a", "b"], 2, -1)


def test_crawl_outcomes(spark):
    urls = {"http://a.com/": "not https", "https://a.com/casino": "blocked", "https://a.com/Known": "crawled", "https://a.com/no": "disallowed", "https://a.com/busy": "busy", "https://a.com/404": "refused", "https://a.com/lost": "failed", "https://a.com/none": "failed", "https://a.com/thin": "thin", "https://a.com/ok": "parsed"}
    status = {"https://a.com/busy": -4, "https://a.com/404": -3, "https://a.com/lost": -1, "https://a.com/thin": 3071, "https://a.com/ok": 3072}
    blocked = next(k for k in urls if urls[k] == "blocked")
    t = spark.createDataFrame([(u,) for u in urls], "url string")
    store = spark.createDataFrame([("https://a.com/known", True), ("https://a.com/ok", False)], "url string, crawled boolean")
    done = crawl.outcomes(t, store, t.where("url not like '%/no'"), spark.createDataFrame(list(status.items()), "url string, status int"))
    got = {r.url: r.outcome for r in done.collect()}
    assert got | {blocked: "blocked"} == urls and got[blocked] in ("blocked", "failed")
    assert {r.url for r in crawl.crawled_marks(done).collect()} == {"https://a.com/thin", "https://a.com/ok"}


def test_repl():
    from types import SimpleNamespace

    from skein import repl

    pages = {("x", 1): [SimpleNamespace(url="u", title="T", score=0.5)], ("x", 2): []}
    assert list(repl.answers(["x", "+", "", "never"], lambda q, n: pages[q, n])) == ["  1. 0.5000  T  u", "1 results on page 1", "0 results on page 2"]


def test_scanned_words_equal_the_rules(spark):
    import random

    import pyarrow as pa

    from skein.functions import scan

    r = random.Random(3)
    texts = [None, "", *WORDS, *("".join(r.choice(list("aZ19 ,.:'-é Â’\n_")) for _ in range(r.randrange(14))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    want = dict(rows.select("i", F.coalesce(T.words_of(F.col("t")), F.array().cast("array<string>"))).collect())
    for size in (1, 3000):  # texts one by one, and many at once
        at = 0
        for part in scan.runs(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), limit=size):
            flat, n = scan.scan(part.column("text"))
            flat = flat.to_pylist()
            for k in n.tolist():
                assert flat[:k] == want[at], texts[at]
                flat, at = flat[k:], at + 1
        assert at == len(texts)
