"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A vector, less the mean, is normalised and rotated by a fixed random orthogonal matrix; the
signs are its code, and the stored factor <code, vector> turns code products into unbiased
estimates of inner products with a known error. The other side of a pair enters as 4-bit
planes, so an estimate is four ANDs and bit counts. Only pairs whose upper confidence bound
reaches the threshold are computed exactly, from the stored vectors.

Equal vectors are one class first. Candidates are pairs of classes whose directions from the
mean agree in one of several patterns of signs along random lines. The number of signs follows
from the number of vectors, so that buckets keep their size, the number of patterns from the
threshold, the mean and the wanted recall; a bucket that is large all the same is split into
blocks that meet in pairs. Every row is a query, and no bucket, candidate or partner count is
capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, ragged, stored
from .graph import components

#: Least cosine of near copies.
THRESHOLD = 0.95
#: Least share of the pairs at the threshold itself that come together as candidates; nearer pairs are found more surely.
RECALL = 0.99
#: Vectors that a bucket should hold if signs were even, the fewest signs of a pattern, the most patterns, and rows of a block.
BUCKET, LEAST_BITS, MOST_BANDS, BLOCK = 256, 14, 512, 4096
#: Width of the confidence bound in standard errors of the estimate.
SIGMAS = 4.0
_QUERY_BITS = 4
_PAIRS = 1 << 18


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix, dim x padded width (a multiple of 64)."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(10).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def plan_bands(rows: int, threshold: float, spread: float, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a pattern, number of patterns). spread: mean squared length of unit vectors less their mean, by which
    the same distance is a wider angle. A pair at angle a agrees in a pattern with probability (1 - a / pi) ** signs."""
    angle = math.acos(max(-1.0, min(1.0, 1 - (1 - threshold) / max(spread, 1e-9))))
    share = 1 - angle / math.pi
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    while True:
        same = share**bits
        bands = 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log1p(-same)) if same > 0 else MOST_BANDS + 1
        if bands <= MOST_BANDS or bits <= 1:
            return bits, min(bands, MOST_BANDS)
        bits -= 1  # fewer signs, larger buckets: more work for the same recall


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim, count))


class Codes:
    """Codes and correction factors of rows of vectors about a centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        self.norm = np.linalg.norm(x, axis=1)
        unit = x / np.where(self.norm > 0, self.norm, 1)[:, None]
        off = unit - centre
        self.size = np.linalg.norm(off, axis=1)
        turned = (off / np.where(self.size > 0, self.size, 1)[:, None]) @ rotation(x.shape[1])
        self.wide = turned.shape[1]
        self.bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        #: <code, vector>: what the code keeps of the direction; 1 / it makes estimates unbiased
        self.kept = np.abs(turned).sum(axis=1) / np.sqrt(self.wide)
        self.centre_dot = unit @ centre
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.where(high > low, (high - low) / (2**_QUERY_BITS - 1), 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        self.low, self.step, self.levels = low, step, level.sum(axis=1).astype(np.int64)
        self.planes = np.stack([np.packbits(level >> k & 1, axis=1, bitorder="little").view(np.uint64) for k in range(_QUERY_BITS)], 1)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)


def estimate(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, wide: int, centre_square: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine, standard error) of rows j (codes) against rows i (4-bit queries)."""
    both = np.zeros(len(i), np.int64)
    for k in range(_QUERY_BITS):
        both += np.bitwise_count(c["bits"][j] & c["planes"][i, k]).sum(axis=1).astype(np.int64) << k
    # <code, query> with code entries of +-1/sqrt(wide)
    product = (2 * (c["step"][i] * both + c["low"][i] * c["ones"][j]) - c["step"][i] * c["levels"][i] - c["low"][i] * wide) / np.sqrt(wide)
    kept = np.maximum(c["kept"][j], 1e-6)
    scale = c["size"][i] * c["size"][j]
    cosine = scale * product / kept + c["centre_dot"][i] + c["centre_dot"][j] - centre_square
    error = np.sqrt(np.maximum(1 - kept**2, 0)) / kept / np.sqrt(max(wide - 1, 1)) + c["step"][i] * np.sqrt(wide / 12) / np.sqrt(wide) / kept
    return cosine, scale * error


_FIXED = ["size", "kept", "centre_dot", "low", "step", "levels", "ones"]


def _blobs(a: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(a)
    width = data.nbytes // max(len(data), 1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(data.tobytes())])


def _unblob(col: pa.Array, dtype: type, width: int) -> np.ndarray:
    if not len(col):
        return np.zeros((0, width), dtype)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(col), width)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that have an id and a direction."""
    v = F.col(vector_col)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(id_a, id_b, cosine) of pairs of rows, id_a < id_b, whose cosine is at least threshold; cosine has 6 decimals.

    Null ids, null vectors, vectors with null or non-finite entries, empty ones and zero ones have no
    direction and no pairs. Vectors are compared with those of their own length, one search a length.
    Equal vectors are pairs (always found: they share every pattern), so m of them make m * (m - 1) / 2
    rows: groups() is for tables with many copies. Rows that share an id aren't pairs of each other;
    repeated rows count once. Ids are whole numbers. Other columns are ignored. An empty table gives no pairs.
    """
    rows = stored(_usable(vectors, id_col, vector_col).distinct(), "vectors")
    return _pairs(rows, threshold, recall).groupBy("id_a", "id_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def groups(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """One row per distinct id: vec_id, class_id, n_links, group_id, kept (vec_id = group_id).

    class_id is the least id with the same vector, n_links the number of other classes within threshold of
    it, group_id the least id of what links and equal vectors join. Copies are never expanded into pairs: output
    and the rows that are compared grow with the distinct vectors and the links between them. Ids whose vectors
    are null, empty, zero or hold null or non-finite entries are classes of their own without links; null
    ids have no row. An id with several vectors takes the least class and all links. Vectors are
    compared with those of their own length. Other columns are ignored; an empty table gives no rows.
    """
    usable = _usable(vectors, id_col, vector_col)
    classes = stored(usable.groupBy("v").agg(F.min("id").alias("id")), "classes")
    member = stored(usable.join(classes.withColumnRenamed("id", "class_id"), "v").select("id", "class_id").distinct(), "members")
    links = stored(_pairs(classes, threshold, recall).select("id_a", "id_b").distinct(), "links")
    both = links.unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    many = both.groupBy(F.col("id_a").alias("class_id")).agg(F.count("*").alias("n"))
    own = member.join(many, "class_id", "left").groupBy("id").agg(F.min("class_id").alias("class_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))
    root = components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(member.select(F.col("id").alias("a"), F.col("class_id").alias("b"))))
    every = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    group = F.coalesce("root", "id")
    out = every.join(own, "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("group_id"), (F.col("id") == group).alias("kept"))


def _pairs(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Near pairs of rows (id, v), stored, one search a length. A vector alone with its length has no partner."""
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    found = [_pairs_of(rows.where(F.size("v") == d), d, threshold, recall) for d in lengths]
    return reduce(DataFrame.unionByName, found, rows.sparkSession.createDataFrame([], "id_a long, id_b long, cosine double"))


def _pairs_of(rows: DataFrame, dim: int, threshold: float, recall: float) -> DataFrame:
    """(id_a, id_b, cosine) of near pairs of rows (id, v), whose vectors all have length dim."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            total += (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], ["s", "n"])

    # the mean of all unit vectors: one row of numbers a partition comes to the driver
    parts = rows.select("v").mapInArrow(sums, "s array<double>, n long").agg(*(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(dim)), F.sum("n").alias("n")).first()
    centre = np.array([parts[k] for k in range(dim)]) / parts["n"]
    square = float(centre @ centre)
    bits, bands = plan_bands(parts["n"], threshold, 1 - square, recall)
    wide = -(-dim // 64) * 64
    words = wide // 64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = directions(dim, bands * bits)
        weights = 1 << np.arange(bits)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = part.column("v").flatten().to_numpy().reshape(-1, dim)
                c = Codes(x, centre)
                off = x / c.norm[:, None] - centre
                key = ((off @ lines > 0).reshape(len(x), bands, bits) * weights).sum(axis=2) + (np.arange(bands) << bits)
                take = np.repeat(np.arange(len(x)), bands)
                blob = np.concatenate([c.bits, c.planes.reshape(len(x), -1)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1).astype(np.int64)), part.column("id").take(pa.array(take)), _blobs(blob[take]), *(pa.array(np.asarray(getattr(c, f), np.float64)[take]) for f in _FIXED)],
                    ["band", "id", "code", *_FIXED],
                )

    banded = rows.mapInArrow(code, "band long, id long, code binary, " + ", ".join(f"{f} double" for f in _FIXED))
    large = stored(banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            band, ids = t["band"], t["id"]
            n = len(band)
            end = np.searchsorted(band, band, side="right")
            partners = end - np.arange(n) - 1
            c = {f: t[f] for f in _FIXED} | {"bits": t["code"][:, :words], "planes": t["code"][:, words:].reshape(n, _QUERY_BITS, words)}
            c["levels"], c["ones"] = c["levels"].astype(np.int64), c["ones"].astype(np.int64)
            upto, row = np.cumsum(partners), 0
            while row < n:
                stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + _PAIRS, side="right")))
                i = np.repeat(np.arange(row, stop), partners[row:stop])
                j = ragged(np.arange(row, stop) + 1, partners[row:stop])
                row = stop
                for a in range(0, len(i), 4 * _PAIRS):
                    p, q = i[a : a + 4 * _PAIRS], j[a : a + 4 * _PAIRS]
                    cosine, error = estimate(c, p, q, wide, square)
                    on = (cosine + SIGMAS * error >= threshold) & (ids[p] != ids[q])
                    x, y = ids[p[on]], ids[q[on]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["id_a", "id_b"])

        held: list[dict[str, np.ndarray]] = []
        size = 0

        def joined() -> dict[str, np.ndarray]:
            return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: batch.column(k).to_numpy() for k in ("band", "id", *_FIXED)}
            t["code"] = _unblob(batch.column("code"), np.uint64, words * (1 + _QUERY_BITS))
            held.append(t)
            size += batch.num_rows
            if size >= 50_000 and t["band"][0] != t["band"][-1]:
                whole = joined()
                cut = int(np.searchsorted(whole["band"], whole["band"][-1]))
                yield from pairs({k: x[:cut] for k, x in whole.items()})
                held = [{k: x[cut:] for k, x in whole.items()}]
                size = len(held[0]["band"])
        if size:
            yield from pairs(joined())

    maybe = in_blocks(banded, "band", "id", BLOCK, large).repartition("band").sortWithinPartitions("band").mapInArrow(solve, "id_a long, id_b long").distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy().reshape(-1, dim) for k in ("va", "vb"))
            dot = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b"), pa.array(dot)], ["id_a", "id_b", "cosine"])

    pairs = maybe.join(rows.select(F.col("id").alias("id_a"), F.col("v").alias("va")), "id_a").join(rows.select(F.col("id").alias("id_b"), F.col("v").alias("vb")), "id_b")
    return pairs.select("id_a", "id_b", "va", "vb").mapInArrow(exact, "id_a long, id_b long, cosine double").where(F.col("cosine") >= threshold)
