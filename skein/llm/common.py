"""Shared helpers: table reading, shared-folder tables, and a vectorised word scanner.

Texts reach Python as Arrow batches; the scanner works on the whole UTF-8 buffer of
a batch at once, so no operator loops over characters in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; bounds the memory of the numpy temporaries.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 17
#: Bytes of an Arrow batch, and rows of a Parquet reader's, at most. Readers hold a whole batch of texts, and twice that while it
#: grows: Spark's 4096 rows and 64 MB are hundreds of MB a task where texts are long. Results don't depend on either.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256}
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes to BATCHES, where they are larger or unbounded; smaller ones stay."""
    for key, most in BATCHES.items():
        now = spark.conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a temporary one, in one local process only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-checkpoint-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, which nothing may read any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def string_parts(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts. The offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most limit text bytes (a longer single text is a run by itself)."""
    _, offsets = string_parts(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield batch.slice(row, end - row)
        row = end


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
    return out


#: Powers for one run of HASH_BYTES bytes; longer texts are hashed run by run, so these never grow.
_POWERS = _power_table(_MULT, HASH_BYTES + 1)
_INVERSES = _power_table(_INV, HASH_BYTES + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants); a bijection."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower case for ASCII; identity elsewhere.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a normalised word keeps: ASCII letters and digits, and every byte of a longer character.
_WORDCHAR = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORDCHAR[_a:_b] = True


class Words:
    """The words of a batch of texts.

    hash: 64-bit hash of each word; start, end: its bytes in raw; doc: row of each word;
    first: index of each row's first word, with the total at the end.
    """

    __slots__ = ("hash", "start", "end", "doc", "first", "raw", "offsets")


def _edges(raw: np.ndarray, inside_of: np.ndarray) -> np.ndarray:
    """Positions where runs of bytes that inside_of marks begin and end, in turn."""
    found, last = [], False
    for a in range(0, len(raw), HASH_BYTES):
        inside = inside_of[raw[a : a + HASH_BYTES]]
        flips = np.empty(len(inside), bool)
        flips[0] = inside[0] != last
        np.not_equal(inside[1:], inside[:-1], out=flips[1:])
        found.append(np.flatnonzero(flips) + a)
        last = bool(inside[-1])
    if last:
        found.append(np.array([len(raw)]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Hash of each span raw[start:end]; spans ascend and don't overlap. fold: byte that stands for each byte.

    Equal spans have equal hashes wherever they stand. Runs of HASH_BYTES are summed at a time, and a longer span piece by piece.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + HASH_BYTES, side="right"))
            if j <= i:
                total = 0
                for a in range(lo, int(end[i]), HASH_BYTES):
                    piece = raw[a : min(a + HASH_BYTES, int(end[i]))]
                    piece = (piece if fold is None else fold[piece]).astype(np.uint64) + np.uint64(1)
                    total += int((piece * _POWERS[: len(piece)]).sum()) * pow(_MULT, a - lo, 1 << 64)
                out[i] = total & _MASK
                i += 1
                continue
            piece = raw[lo : int(end[j - 1])]
            piece = (piece if fold is None else fold[piece]).astype(np.uint64)
            piece += np.uint64(1)
            piece *= _POWERS[: len(piece)]
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(piece, out=sums[1:])
            # scaling to the same power makes equal spans equal wherever they stand
            out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * _INVERSES[start[i:j] - lo]
            i = j
    return mix(out)


def words(col: pa.Array, normalised: bool = False) -> Words:
    """White-space separated words of each text of a string column, hashed.

    normalised: words are runs of letters and digits, ASCII case ignored; punctuation separates.
    Words never cross rows. Null and empty texts have none. Beyond the text itself, memory is that
    of the words found (about 40 bytes each).
    """
    raw, offsets = string_parts(col)
    out = Words()
    out.raw, out.offsets = raw, offsets
    table = _WORDCHAR if normalised else ~_SPACE
    edges = _edges(raw, table)
    # a text that ends in a word and a next one that starts with a word
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    joined = cuts[table[raw[cuts - 1]] & table[raw[cuts]]]
    if len(joined):
        edges = np.sort(np.concatenate([edges, joined, joined]), kind="stable")
    out.start, out.end = edges[0::2], edges[1::2]
    out.first = np.searchsorted(out.start, offsets, side="left")
    out.doc = np.repeat(np.arange(len(col)), np.diff(out.first))
    out.hash = span_hashes(raw, out.start, out.end, _LOWER if normalised else None)
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (n - k + 1 of them); rows are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for j in range(1, k):
            acc = acc * np.uint64(_MULT) + h[j : j + n]
    return mix(acc)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every pair, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def hash_word(word: str) -> int:
    """The hash that words() gives one word (Python form, for lists of known words)."""
    total = 0
    for i, b in enumerate(word.encode()):
        total = (total + (b + 1) * pow(_MULT, i, 1 << 64)) & _MASK
    return int(mix(np.array([total], np.uint64))[0])


def in_blocks(rows: DataFrame, key: str, node: str, block: int, sizes: DataFrame) -> DataFrame:
    """rows such that any two that share a key still do, in groups of about 2 * block rows at most.

    sizes: (key, n) of the keys with more than block rows, stored, so that the planner knows its size and
    broadcasts it only if it is small. The rows of such a key are spread over n / block blocks by their
    node; every two blocks meet under a key of their own. Rows of other keys pass as they are.
    """
    count = F.ceil(F.col("__n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), count).cast("int")
    others = F.when(F.col("__n").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), count - 1), lambda x: x != own))
    sized = rows.join(sizes.select(F.col(key), F.col("n").alias("__n")), key, "left").withColumn("__own", own).withColumn("__other", F.explode(others))
    met = F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other"))
    return sized.withColumn(key, F.when(F.col("__other") < 0, F.col(key).cast("long")).otherwise(met)).select(rows.columns)
