"""The pipeline's stages on a real table and on awkward ones."""

import duckdb
import numpy as np

import corpus_pipeline as P
from skein.llm import simhash, suffix
from skein.llm.queries import ORACLE, QUERIES

from .test_operators import KIND, ROWS, cut_brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    held = [docs]
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
        sizes.append(held[-1].count())
        if i < len(P.STAGES) - 1:
            assert held[-1].columns == docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    assert sizes[1] >= 0.99 * sizes[0] and sizes[2] <= sizes[1] and sizes[3] < sizes[2] and 0 < sizes[4] <= sizes[3]
    left = {r.doc_id: r.text for r in held[3].collect()}
    got = {r.doc_id: [*map(str.lower, suffix_words(r.text))] for r in held[4].collect()}
    want = cut_brute([(i, " ".join(map(str.lower, suffix_words(t)))) for i, t in left.items()], suffix.MIN_WORDS)
    assert got == {i: w for i, w in want.items() if w or not suffix_words(left[i])}
    assert {d for r in held[5].collect() for d in r.doc_ids} <= set(got)
    run = P.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, held[5].collect()))


def suffix_words(text: str) -> list[str]:
    import re

    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)


def test_no_pair_of_near_copies_survives(spark, sf):
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.keep_first(docs).collect()
    p, n = simhash.fingerprints(pa.array([r.text for r in kept]))
    close = sum(int((np.bitwise_count(p[i + 1 :] ^ p[i]).sum(axis=1) <= simhash.RADIUS).sum()) for i in range(len(p)) if n[i])
    assert close <= 0.02 * len(kept)


def test_stages_on_awkward_tables(spark, sf):
    docs = spark.createDataFrame(ROWS, KIND)
    for rows in (docs, docs.where("false")):
        for name, stage in P.STAGES:
            out = stage(spark, rows, sf)
            assert out.count() <= max(len(ROWS), 400) and (name == "packing" or out.columns == rows.columns)


def test_queries(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert len({n.split("_")[0] for n in QUERIES}) == 10
    for name, make in QUERIES.items():
        df = make(spark, sf)
        rows = df.collect()
        if name in ORACLE:
            cols = sorted(df.columns)
            r = con.sql(ORACLE[name])
            at = [r.columns.index(c) for c in cols]
            assert sorted(tuple(x[c] for c in cols) for x in rows) == sorted(tuple(x[i] for i in at) for x in r.fetchall())
        else:
            assert rows


def test_rows_that_share_ids_do_not_swell_the_language_sample(spark, monkeypatch):
    from skein.llm import langid

    rows = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda samples, order: seen.update(samples))
    langid.train(rows, sample_docs=10)
    assert {k: len(set(v)) for k, v in seen.items()} == {"en": 10, "de": 10}
    again = dict(seen)
    langid.train(rows.repartition(7), sample_docs=10)
    assert seen == again


def test_stages_bound_batches(spark, sf):
    from skein.llm.common import BATCHES

    before = {k: spark.conf.get(k, None) for k in BATCHES}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for _, stage in P.STAGES:
            for k in BATCHES:
                spark.conf.set(k, str(1 << 28))
            stage(spark, docs, sf)
            assert all(int(spark.conf.get(k)) <= most for k, most in BATCHES.items())
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "7")
        P.pack(spark, docs, sf)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "7"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
