"""Sources, sinks and streams."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from skein import log
from skein.operators import index, registry, retrieve
from skein.sources import fetch, tables
from skein.streaming import metrics, store, targets


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([("http://a/", ["x", "y"]), ("http://b/", ["z"])], "url string, words array<string>").coalesce(1)
    tables.write_token_files(docs, str(tmp_path / "t"))
    assert {r.url: r.words for r in tables.read_token_files(spark, str(tmp_path / "t")).collect()} == {"http://a/": ["x", "y"], "http://b/": ["z"]}


def test_index_files(spark, sf, tmp_path):
    from skein.functions import text

    post = index.invert(text.tokens(tables.table(spark, sf, "documents")))
    index.write(post, str(tmp_path / "i"))
    again = index.read(spark, str(tmp_path / "i"))
    assert again.count() == post.count()
    plan = index.lookup(again, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan or "In(term" in plan or "EqualTo(term,the)" in plan


def test_registry_files(spark, tmp_path):
    df = spark.createDataFrame([("http://A/", "t" * 9000, True, {"x": 1}), ("http://b/", "t", False, {})], "url string, title string, crawled boolean, anchor_freqs map<string,bigint>")
    tables.write_registry(df, str(tmp_path / "r"), final=True)
    assert [(r.url, r.title) for r in tables.read_registry(spark, str(tmp_path / "r")).collect()] == [("http://a/", "")]


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(src))
    q = metrics.totals(metrics.read_events(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: {r.event_type: (r.n, round(r.total, 3)) for r in df.collect()}
    assert rows(spark.table("totals")) == rows(metrics.totals(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))))


def test_upsert_stream(spark, tmp_path):
    kind = "url string, anchors array<string>, num_encountered long, seed_distance int, domain_dist int"
    for i in range(2):
        spark.createDataFrame([("http://a/", ["w"], 1, i, i)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = store.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = store.read_store(spark, str(tmp_path / "store")).first()
    assert (row.num_encountered, row.seed_distance, row.anchor_freqs) == (2, 0, {"w": 2})


def test_politeness_stream(spark, tmp_path):
    import datetime as dt

    from skein.streaming import politeness

    base = dt.datetime(2024, 1, 1)
    rows = [("a", f"u{i}", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 1, 10])] + [("b", "v", base)]
    spark.createDataFrame(rows, "domain string, url string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, url string, ts timestamp").parquet(str(tmp_path / "in"))
    q = politeness.schedule(stream).writeStream.format("memory").queryName("polite").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.url: (r.start - base).total_seconds() for r in spark.table("polite").collect()}
    assert got == {"u0": 0, "u1": 2, "u2": 4, "u3": 10, "v": 0}


def test_token_files_go_on_behind_damage(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("junk\n<doc>\nhttp://a/\nx\n</doc>\nno start\nhttp://lost/\ny\n</doc>\n<doc>\nhttp://cut/\nz\n<doc>\nhttp://b/\nq\nw w\n</doc>\n")
    assert {r.url: r.words for r in tables.read_token_files(spark, str(tmp_path / "t")).collect()} == {"http://a/": ["x"], "http://b/": ["q"]}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(3, "the cat, the dog", "u3"), (1, "a cat", "u1"), (2, None, "u2"), (4, "", "u4"), (None, "lost", "u")], "doc_id long, text string, url string")
    own = index.build(docs, str(tmp_path / "idx" / "a"), keep=("url",), chunk_docs=2)
    assert {(r.term, r.doc_id): (r.pos, r.tf, r.chunk) for r in own.postings.collect()} == {("the", 3): ([1, 3], 2, 1), ("cat", 3): ([2], 1, 1), ("dog", 3): ([4], 1, 1), ("a", 1): ([1], 1, 0), ("cat", 1): ([2], 1, 0)}
    assert {(r.term, r.n_docs, r.n_posts) for r in own.dictionary.collect()} == {("the", 1, 2), ("cat", 2, 2), ("dog", 1, 1), ("a", 1, 1)}
    assert sorted(tuple(r) for r in own.chunks().collect()) == [(0, 2, 2, 1, 2), (1, 2, 4, 3, 4)]
    assert own.n_docs(["cat", "none"]) == [2, 0]
    assert {r.doc_id: r.url for r in own.urls(spark.createDataFrame([(1,), (9,)], "doc_id long")).collect()} == {1: "u1", 9: index.NO_URL}
    assert index.discover(spark, str(tmp_path / "idx")) and not index.discover(spark, str(tmp_path / "nothing"))
    plan = retrieve.match(own.postings, "cat -dog")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [cat,dog])" in plan and "MapInArrow" not in plan and "regexp" not in plan
    with pytest.raises(Exception):  # noqa: B017
        index.build(docs, str(tmp_path / "idx" / "a"))


def test_chunks_end_at_bytes(spark):
    rows = spark.createDataFrame([(i * 10**9, 10) for i in range(10)], "doc_id long, n long")
    got = [r.chunk for r in index.chunked(rows, 4, weight=F.col("n"), limit=25).orderBy("doc_id").collect()]
    want = [i // 4 + i * 10 // 25 for i in range(10)]
    assert got == want


STORE = "url string, title string, eot int, eod int, crawled boolean, num_encountered long, seed_distance int, domain_dist int, anchor_freqs map<string,bigint>"
UPDATE = "url string, anchors array<string>, num_encountered long, seed_distance int, domain_dist int, nth int"


def test_upsert_keeps_what_the_store_has(spark):
    old = spark.createDataFrame([("http://a.com/", "T", 3, 9, True, 5, 4, 1, {"w": 2}), ("http://z.com/", "Z", 1, 1, False, 1, 9, 2, {})], STORE)
    new = spark.createDataFrame([("http://A.com/", ["w", "w", "v"], 2, 7, 0, 1), ("http://b.com/", ["x", "x"], 1, 2, 2, 2), ("http://b.com/", ["x", "x"], 1, 3, 2, 3), (None, ["q"], 1, 1, 1, 4)], UPDATE)
    got = {r.url: r for r in registry.upsert(new, old).collect()}
    a = got["http://a.com/"]
    assert (a.title, a.eot, a.eod, a.crawled, a.num_encountered, a.seed_distance, a.domain_dist, a.anchor_freqs, a.is_new) == ("T", 3, 9, True, 7, 4, 0, {"w": 4, "v": 1}, False)
    assert (got["http://z.com/"].title, got["http://z.com/"].num_encountered, got["http://z.com/"].is_new) == ("Z", 1, False)
    b = got["http://b.com/"]
    assert (b.num_encountered, b.seed_distance, b.anchor_freqs, b.is_new, b.crawled, b.title) == (2, 2, {"x": 4}, True, False, None) and len(got) == 3
    # of a new URL's first update every word counts once
    assert {r.url: r.anchor_freqs for r in registry.upsert(new, old, first_seen="nth").collect()} == {"http://a.com/": {"w": 4, "v": 1}, "http://b.com/": {"x": 3}, "http://z.com/": {}}
    # a full registry takes no new URL, but still updates
    assert {r.url: r.num_encountered for r in registry.upsert(new, old, capacity=2).collect()} == {"http://a.com/": 7, "http://z.com/": 1}


def test_upsert_filters_new_urls_only(spark):
    old = spark.createDataFrame([("ftp://low/", None, None, None, None, 1, 1, 1, None)], STORE)
    new = spark.createDataFrame([("ftp://low/", [], 1, 1, 1, 1), ("ftp://new/", [], 1, 1, 1, 1), ("https://example.com", [], 1, 0, 0, 1)], UPDATE)
    assert {r.url for r in registry.upsert(new, old, insert_filter=True).collect()} == {"ftp://low/", "https://example.com"}


def test_lookup(spark):
    old = spark.createDataFrame([("http://a.com/", "T", 3, 9, True, 5, 4, 1, {"w": 2})], STORE)
    rows = {r.url: r for r in registry.lookup(spark.createDataFrame([("HTTP://a.com/",), ("http://b.com/",)], "url string"), old).collect()}
    assert tuple(rows["HTTP://a.com/"])[1:] == (True, True, 5, 4, 1, "T", {"w": 2}) and tuple(rows["http://b.com/"])[1:] == (False, False, 0, 65535, None, "", None)


def test_registry_anchors_are_cut_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([("http://A/", "t", True, {"é" * 300: 1, "é" * 256: 2, "é" * 256 + "x": 4, "short": 8, "a" + "é" * 300: 16})], "url string, title string, crawled boolean, anchor_freqs map<string,bigint>")
    tables.write_registry(df, str(tmp_path / "r"))
    assert tables.read_registry(spark, str(tmp_path / "r")).first().anchor_freqs == {"é" * 256: 7, "short": 8, "a" + "é" * 255: 16}


def test_store_rewrites_only_touched_parts(spark, tmp_path):
    path = str(tmp_path / "s")
    row = lambda u, n: (u, ["w"], n, 1, 1)
    batch = lambda *rows: spark.createDataFrame(rows, "url string, anchors array<string>, num_encountered long, seed_distance int, domain_dist int")
    store.merge(batch(*(row(f"http://{i}/", 1) for i in range(40))), 0, path, parts=8)
    store.merge(batch(row("http://3/", 10)), 1, path, parts=8)
    assert len(list((tmp_path / "s" / "data" / "1").glob("part=*"))) == 1
    store.merge(batch(row("http://3/", 10)), 1, path, parts=8)  # repeated: the same again
    got = {r.url: r.num_encountered for r in store.read_store(spark, path).collect()}
    assert len(got) == 40 and got["http://3/"] == 11 and got["http://4/"] == 1
    store.merge(batch(row("http://3/", 100)), 2, path, parts=8)
    store.merge(batch(row("http://3/", 1000)), 3, path, parts=8)
    assert {r.url: r.num_encountered for r in store.read_store(spark, path).collect()}["http://3/"] == 1111
    assert not list((tmp_path / "s" / "data" / "1").glob("part=*"))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    kind = "url string, anchors array<string>, num_encountered long, seed_distance int, domain_dist int"

    def run() -> dict:
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = store.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp"), parts=4).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r.url: r.num_encountered for r in store.read_store(spark, str(tmp_path / "store")).collect()}

    for n in (1, 2):
        spark.createDataFrame([("http://a/", [], n, 1, 1), (f"http://{n}/", [], 1, 1, 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run()
    assert got == {"http://a/": 3, "http://1/": 1, "http://2/": 1}


def test_target_stream(spark, tmp_path):
    rows = [("https://mit.edu", 1, 0), ("ftp://x.com/aaaa", 0, 0), ("https://example.com", 50, 13), (None, 1, 1)]
    spark.createDataFrame(rows, targets.TARGETS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = targets.enqueue(targets.read_targets(spark, str(tmp_path / "in")), str(tmp_path / "f"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.url, r.bucket) for r in tables.read_frontier(spark, str(tmp_path / "f")).collect()} == {("https://mit.edu", 0), ("https://example.com", 3)}


def test_frontier_files(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("a", 0), ("b", 3), ("c", 3)], "url string, bucket int")
    tables.write_frontier(rows, path)
    tables.append_frontier(spark.createDataFrame([("d", 0)], "url string, bucket int"), path)
    assert {(r.url, r.bucket) for r in tables.read_frontier(spark, path).collect()} == {("a", 0), ("b", 3), ("c", 3), ("d", 0)}
    best = tables.read_frontier(spark, path, [0])
    assert {r.url for r in best.collect()} == {"a", "d"} and "PartitionFilters: [isnotnull(bucket" in best._jdf.queryExecution().executedPlan().toString()


def test_spill(spark):
    rows = spark.createDataFrame([(i, 0 if i < 5 else 7) for i in range(9)], "page_id long, bucket int")
    got = {r.page_id: r.bucket for r in registry.spilled(rows, "page_id", 2).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 7, 6: 7, 7: 8, 8: 8}


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/loop":
            self.send_response(302)
            self.send_header("Location", "/loop")
        else:
            self.send_response({"/busy": 429, "/gone": 404}.get(self.path, 200))
        self.end_headers()
        if self.path in ("/", "/big"):
            self.wfile.write(b"<p>hello" * (1 if self.path == "/" else 20_000))

    def log_message(self, *args):
        pass


def test_fetch(spark):
    site = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{site.server_port}"
    urls = [f"{at}/", f"{at}/big", f"{at}/busy", f"{at}/gone", f"{at}/loop", "http://127.0.0.1:1/", "ftp://x/", None]
    got = {r.url: r for r in fetch.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), schemes=("http",)).collect()}
    site.shutdown()
    assert [got[u].status for u in urls] == [8, fetch.MAX_BYTES, fetch.TOO_MANY, fetch.REFUSED, fetch.FAILED, fetch.FAILED, fetch.FAILED, fetch.FAILED]
    assert got[f"{at}/"].html == "<p>hello" and got[f"{at}/gone"].html is None
    assert fetch.fetch_one(f"{at}/", schemes=("https",))[0] == fetch.FAILED


def test_log():
    import io

    out = io.StringIO()
    handler = log.show(1, out)
    log.logger("skein.x").info("said")
    log.logger("y").debug("unsaid")
    log.logging.getLogger("skein").removeHandler(handler)
    assert "INFO skein.x: said" in out.getvalue() and "unsaid" not in out.getvalue()


def test_index_in_many_parts(spark, tmp_path, monkeypatch):
    """Postings are in ranges of (term, doc_id), each whole; documents come back from them, rows that share an id as one."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(index, "PART_TOKENS", 64)
    monkeypatch.setattr(index, "PACK_ROWS", 100)
    texts = {i: " ".join(["the", f"w{i % 7}", "x" * 40 + str(i % 3), f"only{i}", "the", "end"][: 1 + i % 6]) for i in range(400)}
    docs = spark.createDataFrame([*texts.items(), (5, "the b"), (5, "a"), (-7, "minus")], "doc_id long, text string").repartition(3)
    own = index.build(docs, str(tmp_path / "i"), chunk_docs=50, chunk_bytes=None)
    post = own.postings.collect()
    assert len(post) == own.postings.where("size(pos) = tf").count() == sum(len(set(t.split())) for t in texts.values()) + 4
    of = {r.doc_id: r.chunk for r in own.documents.where("doc_id <> 5").collect()}
    assert all(r.chunk == of[r.doc_id] for r in post if r.doc_id != 5)
    files = [pq.read_table(f).select(["term", "doc_id"]).to_pylist() for f in glob.glob(f"{tmp_path}/i/postings/*.parquet")]
    spans = sorted([(r["term"], r["doc_id"]) for r in rows] for rows in files if rows)
    assert len(spans) > 4 and all(s == sorted(s) for s in spans) and all(a[-1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(any(t == "the" for t, _ in s) for s in spans) > 2
    back = {r.doc_id: r.words for r in index.rebuild(own.postings).collect()}
    assert {k: v for k, v in back.items() if k not in (5, -7)} == {k: t.split() for k, t in texts.items() if k != 5}
    assert back[-7] == ["minus"] and back[5] == [w for _, w in sorted((i, w) for t in (texts[5], "the b", "a") for i, w in enumerate(t.split()))]


def test_build_shuffles_packed_rows(spark, tmp_path):
    """No join of the postings, whatever the size of the documents table; one shuffle of them, in few rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(2000).selectExpr("id AS doc_id", "concat('the of w', id, ' a b c d e f') AS text")
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("build", "")
        own = index.build(docs, str(tmp_path / "i"))
        spark.sparkContext.setJobGroup("", "")
        stages = {s for j in tracker.getJobIdsForGroup("build") for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store, wrote = spark.sparkContext._jsc.sc().statusStore(), []
        for s in stages:
            try:
                wrote.append(store.lastStageAttempt(s).shuffleWriteRecords())
            except Exception:  # noqa: BLE001, S112 - a stage that was skipped
                continue
        assert own.postings.count() == 18000
        assert wrote and max(wrote) < 18000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
