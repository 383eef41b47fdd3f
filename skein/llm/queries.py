"""The registered queries of this subpackage. Each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, langid, packing, pieces, rabitq, simhash, spotsigs, suffix, tokenstore, toxicity
from .common import shared_dir, table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.groups(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), check=True)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole table's tokens to the shared folder and returns what is read back."""
    path = f"{shared_dir(spark)}/skein-tokens-{uuid.uuid4().hex}"
    tokenstore.write(tokenstore.encode_with_metadata(table(spark, sf_dir, "documents")), path)
    return spark.read.parquet(path)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract_pages(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.groups(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_store": op4_token_store,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}
def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in sorted(set(names)))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LETTER = r"A-Za-z0-9\x{80}-\x{10FFFF}"

ORACLE: dict[str, str] = {
    "op2_suffix_array_dedup": f"""
        WITH p AS (SELECT doc_id, text, regexp_extract(text, '^[^{_LETTER}]*', 0) AS lead_in, regexp_extract_all(text, '[{_LETTER}]+[^{_LETTER}]*') AS ps FROM documents),
        w AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS loc FROM p),
        x AS (SELECT *, translate(regexp_extract(piece, '^[{_LETTER}]+', 0), {_LOWER}) AS word FROM w),
        g AS (SELECT doc_id, loc, piece, CASE WHEN count(*) OVER run = 50 THEN md5(string_agg(word, ' ') OVER run) END AS gram FROM x
            WINDOW run AS (PARTITION BY doc_id ORDER BY loc ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        r AS (SELECT doc_id, loc, piece, gram IS NOT NULL AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, loc) > 1 AS again FROM g),
        k AS (SELECT doc_id, loc, piece, max(again::INT) OVER (PARTITION BY doc_id ORDER BY loc ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
        t AS (SELECT doc_id, string_agg(piece, '' ORDER BY loc) FILTER (NOT gone) AS kept, count(*) AS n, count(*) FILTER (gone) AS c FROM k GROUP BY doc_id)
        SELECT doc_id, lead_in || coalesce(kept, '') AS text, coalesce(n, 0)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS cut_words FROM p LEFT JOIN t USING (doc_id)""",
    "op1_spotsigs": f"""
        WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS loc FROM (SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents)),
        m AS (SELECT *, word IN ({_in(spotsigs.ANCHORS)}) AS spot, word NOT IN ({_in(spotsigs.COMMON)}) AS plain FROM w),
        n AS (SELECT *, sum(plain::INT) OVER (PARTITION BY doc_id ORDER BY loc) AS upto FROM m),
        content AS (SELECT doc_id, list(word ORDER BY loc) AS ws FROM n WHERE plain GROUP BY doc_id),
        sig AS (SELECT DISTINCT doc_id, word || ' ' || array_to_string(ws[upto + 1 : upto + 3], ' ') AS s FROM n JOIN content USING (doc_id) WHERE spot AND upto + 3 <= len(ws)),
        size AS (SELECT doc_id, count(*) AS n FROM sig GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sig a JOIN sig b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        whole AS (SELECT doc_id, md5(string_agg(word, ' ' ORDER BY loc)) AS ws FROM w GROUP BY doc_id),
        equal AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS least FROM whole),
        edge AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE p.n >= 3 AND q.n >= 3 AND k / (p.n + q.n - k)::DOUBLE >= 0.5
            UNION SELECT doc_id, least FROM equal WHERE doc_id <> least UNION SELECT least, doc_id FROM equal WHERE doc_id <> least),
        reach(a, b) AS (SELECT x, x FROM edge UNION SELECT reach.a, edge.y FROM reach JOIN edge ON edge.x = reach.b),
        root AS (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(size.n, 0)::INT AS n_signatures, coalesce(r, d.doc_id) AS group_id, coalesce(r, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN root USING (doc_id)""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings),
        r AS (SELECT class_id, v FROM e WHERE vec_id = class_id),
        p AS (SELECT a.class_id AS x, b.class_id AS y FROM r a JOIN r b ON a.class_id <> b.class_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        n AS (SELECT x, count(*) AS n FROM p GROUP BY x),
        reach(a, b) AS (SELECT x, x FROM p UNION SELECT reach.a, p.y FROM reach JOIN p ON p.x = reach.b),
        root AS (SELECT a AS class_id, min(b) AS r FROM reach GROUP BY a)
        SELECT vec_id, class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(r, class_id) AS group_id, vec_id = coalesce(r, class_id) AS kept
        FROM e LEFT JOIN n ON n.x = class_id LEFT JOIN root USING (class_id)""",
}
