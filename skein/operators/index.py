"""Positional inverted index: build, statistics, lookups, round trip, storage.

A stored index is a folder of three tables: postings in term order with their chunk, the
dictionary with document and occurrence counts, and the documents with lengths and chunk.
Searches read it; nothing is tokenised again.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan
from ..log import logger

#: Documents of a chunk, and bytes of its postings, at which the next begins.
CHUNK_DOCS, CHUNK_BYTES = 500_000, 512 << 20
#: Bytes that a posting counts for a chunk.
POST_BYTES = 4
NO_URL = "<invalid-doc>"
POSTINGS = "term string, doc_id long, pos array<int>, tf int"
#: Occurrences in a part of the postings, and in the sample from which the parts' bounds are; rows that are packed at once.
PART_TOKENS, SAMPLE_TOKENS, PACK_ROWS = 1 << 21, 1 << 19, 1 << 19
_log = logger(__name__)


def _posted(part: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of the texts of a run of rows (doc_id, text), document by document."""
    flat, size = scan.scan(part.column("text"))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) + 1).astype(np.int32)
    key = row * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    ends = np.append(head, len(s)).astype(np.int32)
    pos = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order[head]])), part.column("doc_id").take(pa.array(row[order[head]])), pos, pa.array(np.diff(ends).astype(np.int32))], ["term", "doc_id", "pos", "tf"])


def postings_of(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """invert() of documents whose texts are a column: a document's words lie in one row, so nothing is shuffled.

    Null ids and texts without words have no postings; rows that share an id have postings each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_posted(part) for batch in batches for part in scan.runs(batch))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null").mapInArrow(run, POSTINGS)


def _packed(batches: Iterator[pa.RecordBatch], of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows by the part they go to, compressed: (part, rows), a row a part for PACK_ROWS rows. of: each row's part, and its place in it."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not len(rows):
            return
        part, place = of(rows)
        order = np.lexsort((place, part))
        rows, part = rows.take(pa.array(order)).combine_chunks().to_batches()[0], part[order]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        blobs = []
        for i, j in zip(head, np.append(head[1:], len(part))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows.slice(i, j - i))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield from out(held)
            held, n = [], 0
    if held:
        yield from out(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("rows"):
            yield from pa.ipc.open_stream(blob.as_buffer())


PACKED = "part int, rows binary"


def _parts(tokens: int, cores: int) -> int:
    """Parts for so many occurrences: PART_TOKENS in each, fewer if cores would be idle."""
    return max(1, -(-tokens // PART_TOKENS), min(cores, tokens // (PART_TOKENS >> 4)))


def _range_bounds(sample: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n - 1 bounds (term, doc_id) that cut a sample of postings into even ranges. Terms are cut to 32 bytes; those that long aren't cut apart."""
    term = np.array(sample.column("term").to_pylist(), "S32")
    doc = np.where(np.char.str_len(term) < 32, sample.column("doc_id").to_numpy(), np.iinfo(np.int64).min)
    if n < 2 or not len(term):
        return term[:0], doc[:0]
    order = np.lexsort((doc, term))
    at = np.unique(np.arange(1, n) * len(order) // n)
    return term[order[at]], doc[order[at]]


def _range_of(terms: pa.Array, doc: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many bounds are at or below each (term, doc_id), and a number for each term."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    known = np.array(coded.dictionary.to_pylist(), "S32")
    low, high = (np.searchsorted(bounds[0], known, side)[code] for side in ("left", "right"))
    while (on := np.flatnonzero(low < high)).size:  # bounds inside of a term
        mid = (low[on] + high[on]) // 2
        below = bounds[1][mid] <= doc[on]
        low[on] = np.where(below, mid + 1, low[on])
        high[on] = np.where(below, high[on], mid)
    return low, code


def invert(tok: DataFrame) -> DataFrame:
    """(term, doc_id, pos, tf): ascending places of each term in each document. One shuffle, partial lists first."""
    return tok.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("loc")).alias("pos")).withColumn("tf", F.size("pos"))


def term_statistics(tok: DataFrame) -> DataFrame:
    """(term, n_docs, n_posts). Counts per document first, so the second shuffle has a row a term and partition."""
    per = tok.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_posts"))


def dictionary(tok: DataFrame) -> DataFrame:
    """term_statistics of the terms an index stores: those that begin with a letter or digit."""
    return term_statistics(tok).where(F.col("term").rlike("^[a-z0-9]"))


def first_letters(words: DataFrame) -> DataFrame:
    """Per leading character: first term and number of terms."""
    return words.groupBy(F.substring("term", 1, 1).alias("slot")).agg(F.min("term").alias("first_term"), F.count("*").alias("n_terms"))


#: Ids in a block of ranked(): ranks are counted inside blocks and offset by the blocks before.
ID_BLOCK = 1 << 16


def ranked(rows: DataFrame, id_col: str, group: str | None = None, weight: Column | None = None) -> DataFrame:
    """rows with __rank, the place in the order of whole-number ids (of each group), from 1, and with weight also __before,
    the sum of it over the rows before.

    Only the table of blocks, a row for ID_BLOCK ids that occur, is ordered as a whole; a block is one task's at a time.
    """
    keys = ["__b"] if group is None else [group, "__b"]
    blocks = rows.withColumn("__b", F.floor(F.col(id_col) / ID_BLOCK)).withColumn("__w", F.lit(0).cast("long") if weight is None else weight.cast("long"))
    sizes = blocks.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__w").alias("__s"))
    over = Window.orderBy("__b") if group is None else Window.partitionBy(group).orderBy("__b")
    before = sizes.select(*keys, (F.sum("__n").over(over) - F.col("__n")).alias("__first"), (F.sum("__s").over(over) - F.col("__s")).alias("__sum"))
    inside = Window.partitionBy(*keys).orderBy(id_col)
    nth = blocks.withColumns({"__rank": F.row_number().over(inside), "__before": F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")})
    out = nth.join(before, keys).withColumns({"__rank": F.col("__rank") + F.col("__first"), "__before": F.col("__before") + F.col("__sum")})
    return out.select(*rows.columns, "__rank", *([] if weight is None else ["__before"]))


def chunked(docs: DataFrame, size: int = CHUNK_DOCS, id_col: str = "doc_id", weight: Column | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """docs with chunk: ids in order; the next chunk begins behind size documents or, with weight, where the running
    sum of weights passes a multiple of limit."""
    out = ranked(docs, id_col, weight=weight)
    chunk = F.floor((F.col("__rank") - 1) / size)
    if weight is not None:
        chunk = chunk + F.floor(F.col("__before") / limit)
    return out.withColumn("chunk", chunk.cast("int")).select(*docs.columns, "chunk")


def rebuild(postings: DataFrame) -> DataFrame:
    """(doc_id, words): documents again from their postings, which are shuffled packed; a part of the documents is one task's at a time."""
    spark = postings.sparkSession
    tokens = postings.agg(F.sum(F.size("pos")).alias("n")).first().n or 0
    n = _parts(tokens, spark.sparkContext.defaultParallelism)

    def of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc = rows.column("doc_id").to_numpy()
        return (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(n), doc

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(_unpacked(batches))
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        term, pos = (rows.column(c).chunk(0) for c in ("term", "pos"))
        coded = term.dictionary_encode()
        tf = pc.list_value_length(pos).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = np.empty(len(coded.dictionary), np.int64)  # words at one place, in rows that share an id, are in order
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        code = np.repeat(coded.indices.to_numpy(), tf)
        ids, doc = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
        doc, loc = np.repeat(doc, tf), pos.flatten().to_numpy()
        order = np.lexsort((rank[code], loc, doc))
        ends = np.searchsorted(doc[order], np.arange(len(ids) + 1))
        code = code[order]
        for a in range(0, len(ids), 256):
            cut = ends[a : a + 257]
            words = coded.dictionary.take(pa.array(code[cut[0] : cut[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256]), pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), words)], ["doc_id", "words"])

    rows = postings.select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("array<int>").alias("pos")).where("size(pos) > 0")
    return rows.mapInArrow(lambda batches: _packed(batches, of), PACKED).repartitionById(n, F.col("part")).mapInArrow(whole, "doc_id long, words array<string>")


def length_histogram(words: DataFrame) -> DataFrame:
    """Terms per decade of posting-list length."""
    decade = F.floor(F.log10(F.col("n_posts") + 0.5)).cast("int")
    return words.groupBy(decade.alias("decade")).agg(F.count("*").alias("n_terms"), F.sum("n_posts").alias("n_posts"), F.round(F.avg("n_posts"), 4).alias("mean_posts"))


def write(postings: DataFrame, path: str) -> None:
    """Postings in term order over and inside files, so that a term lookup skips files and row groups; never over
    an existing index. Ranges of (term, doc_id) split a frequent term's list over several files."""
    _write(postings.repartitionByRange("term", "doc_id"), path)


def _write(ranges: DataFrame, path: str) -> None:
    rows = ranges.sortWithinPartitions("term", "doc_id")
    rows.write.option("parquet.block.size", str(8 << 20)).option("parquet.page.row.count.limit", "2000").option("compression", "zstd").mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(terms))


@dataclasses.dataclass
class Index:
    """A stored index: postings (term, doc_id, pos, tf, chunk), dictionary (term, n_docs, n_posts), documents
    (doc_id, doc_len, chunk and what else was kept)."""

    postings: DataFrame
    dictionary: DataFrame
    documents: DataFrame

    def n_docs(self, terms: list[str]) -> list[int]:
        """Documents that have each term: one filtered read of the dictionary, as many rows as terms."""
        have = {r.term: r.n_docs for r in self.dictionary.where(F.col("term").isin(terms)).collect()}
        return [have.get(t, 0) for t in terms]

    def chunks(self) -> DataFrame:
        """(chunk, n_docs, n_words, first_doc, last_doc) of the chunks there are."""
        return self.documents.groupBy("chunk").agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_words"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    def urls(self, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """ids with url; ids that the index doesn't have get NO_URL."""
        known = self.documents.select(F.col("doc_id").alias(id_col), "url")
        return ids.join(known, id_col, "left").withColumn("url", F.coalesce("url", F.lit(NO_URL)))

    def heads(self, k: int = 3) -> DataFrame:
        """The first k postings of each term: what a dump shows."""
        nth = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
        return self.postings.withColumn("nth", nth).where(F.col("nth") <= k)


def build(docs: DataFrame, path: str, text: Column | None = None, id_col: str = "doc_id", keep: tuple[str, ...] = (), chunk_docs: int = CHUNK_DOCS, chunk_bytes: int | None = CHUNK_BYTES) -> Index:
    """Writes the index of docs to path, which must not exist, and opens it.

    text: the column of texts, by default text. keep: columns kept in the documents table (url, title).
    chunk_bytes: None for chunks that end at chunk_docs documents only.
    Texts are written once beside the index and deleted at the end; postings are shuffled once, packed, into ranges of
    (term, doc_id), whose bounds are from a sample; the dictionary is counted from what was written.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, (F.col("text") if text is None else text).alias("__text")).where("doc_id is not null")
    schema = T.StructType([*own.schema, T.StructField("doc_len", T.LongType())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.runs(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scan.scan(part.column("__text"))[1])], [*part.schema.names, "doc_len"])

    own.mapInArrow(measured, schema).write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/texts")
    held = spark.read.schema(schema).parquet(f"{path}/texts")
    lengths = held.select("doc_id", *keep, "doc_len")
    (chunked(lengths, chunk_docs) if chunk_bytes is None else chunked(lengths, chunk_docs, weight=F.col("doc_len") * POST_BYTES, limit=chunk_bytes)).write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    # ids are in the order of chunks: a row a chunk says which one an id is in
    starts = sorted((r.first, r.chunk) for r in documents.groupBy("chunk").agg(F.min("doc_id").alias("first")).collect())
    first, chunk_of = np.array([r[0] for r in starts], np.int64), np.array([r[1] for r in starts], np.int32)
    n_docs, tokens = documents.agg(F.count("*"), F.sum("doc_len")).first()
    n = _parts(tokens or 0, spark.sparkContext.defaultParallelism)
    some = max(1, min(tokens // SAMPLE_TOKENS, n_docs // 256)) if tokens else 1
    sample = postings_of(held.where(F.pmod(F.xxhash64("doc_id"), F.lit(some)) == 0), "doc_id", F.col("__text")).select("term", "doc_id") if n > 1 else None
    bounds = _range_bounds(pa.table({"term": pa.array([], pa.string()), "doc_id": pa.array([], pa.int64())}) if sample is None else sample.toArrow(), n)

    def of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _range_of(rows.column("term").chunk(0), rows.column("doc_id").to_numpy(), bounds)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.runs(batch):
                rows = _posted(part)
                chunk = chunk_of[np.searchsorted(first, rows.column("doc_id").to_numpy(), side="right") - 1]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(chunk)], [*rows.schema.names, "chunk"])

    packed = held.select("doc_id", F.col("__text").alias("text")).where("doc_len > 0").mapInArrow(lambda batches: _packed(posted(batches), of), PACKED)
    _write(packed.repartitionById(n, F.col("part")).mapInArrow(_unpacked, f"{POSTINGS}, chunk int"), f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings")
    counts = posts.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").cast("long").alias("n_posts"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/dictionary")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/texts")
    fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)
    _log.info("index written to %s", path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "dictionary", "documents")))


def discover(spark: SparkSession, path: str) -> list[str]:
    """Paths of the whole indexes under path, in name order: folders that have all three tables, each committed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = sorted(str(x.getPath()) for x in fs.listStatus(root) if x.isDirectory()) if fs.exists(root) else []
    return [f for f in found if all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{f}/{t}/_SUCCESS")) for t in ("postings", "dictionary", "documents"))]
