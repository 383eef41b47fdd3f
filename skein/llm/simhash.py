"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has 256 bits, from its set of words. Texts whose fingerprints agree
on one of several samples of bits are compared: the fingerprints of a bucket lie
as vertical bit planes, 64 to a machine word, and a query's distances to 64 of them at a
time are counted by carry-save adders. Words in which every distance is above RADIUS are
abandoned every PLANES_AT_ONCE planes. Texts within RADIUS are joined into groups.

How many bits a sample has follows from the number of fingerprints, so that buckets keep
their size; how many samples there are follows from the radius and the wanted recall. A
bucket that is large all the same is split into blocks that meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_blocks, mix, ragged, slices, stored, words
from .graph import components, join_labels

BITS = 256
#: Largest Hamming distance of near copies; 44 of 256 bits is a cosine of about 0.86 between word sets.
RADIUS = 44
#: Least share of the pairs at the radius itself that samples bring together; nearer pairs are found more surely.
RECALL = 0.98
#: Fingerprints that a bucket should hold if their bits were even, and the fewest bits of a sample.
BUCKET, LEAST_BITS = 2048, 12
#: Rows of a bucket that are solved together; larger buckets are split into blocks.
BLOCK = 8192
PLANES_AT_ONCE = 32
#: Queries of each bucket in one round; groups found so far are left out of the next round's comparisons.
ROUND = 64
_BLOCK = 1 << 14


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 words of 64 bits, number of distinct words) of each text. Texts without words have 0 of them."""
    w = words(col, normalised=True)
    n = len(col)
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(40)).astype(np.int64)
    word = key & np.uint64((1 << 40) - 1)
    count = np.bincount(doc, minlength=n)
    out = np.zeros((n, BITS // 64), np.uint64)
    if not len(key):
        return out, count
    # one byte lane per bit holds 255 words; blocks never cross texts, and so many blocks are looked at together
    first = np.cumsum(count) - count
    blocks = -(-count // 255)
    of = np.repeat(np.arange(n), blocks)
    starts = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * 255
    stops = np.append(starts[1:], len(key))
    at_once = 1024
    with np.errstate(over="ignore"):
        for k in range(BITS // 64):
            ones = np.zeros((n, 64), np.int64)
            for a in range(0, len(starts), at_once):
                part = starts[a : a + at_once]
                mixed = mix(word[part[0] : stops[min(a + at_once, len(starts)) - 1]] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                lanes = np.unpackbits(mixed.view(np.uint8)).view(np.uint64).reshape(-1, 8)
                sums = np.add.reduceat(lanes, part - part[0], axis=0).view(np.uint8).reshape(len(part), 64)
                own = of[a : a + at_once]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                ones[own[heads]] += np.add.reduceat(sums.astype(np.int64), heads, axis=0)
            has = np.flatnonzero(count)
            out[has, k] = np.packbits(ones[has] * 2 > count[has][:, None], axis=1).view(np.uint64)[:, 0]
    return out, count


def plan_bands(rows: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a sample, number of samples). A pair that differs in a share p of its bits is found with probability
    1 - (1 - (1 - p) ** bits) ** samples."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    same = (1 - radius / BITS) ** bits
    return bits, 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log1p(-same))


def band_positions(bits: int = LEAST_BITS, bands: int = plan_bands(1)[1]) -> np.ndarray:
    """The sampled bits of every band; fixed, so that runs agree."""
    r = np.random.default_rng(9)
    return np.stack([r.permutation(BITS)[:bits] for _ in range(bands)])


def within(planes: np.ndarray, valid: np.ndarray, radius: int, flips: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lanes within radius. planes: BITS x words; at: target word of each comparison; flips: BITS x comparisons,
    all ones where the query's bit is set; valid: lanes that count. Returns one word of lanes per comparison."""
    out = np.zeros(len(at), np.uint64)
    live = np.flatnonzero(valid)
    depth = int(BITS).bit_length()
    counter = [np.zeros(len(live), np.uint64) for _ in range(depth)]
    for b in range(0, BITS, PLANES_AT_ONCE):
        if not len(live):
            break
        x = planes[b : b + PLANES_AT_ONCE, at[live]] ^ flips[b : b + PLANES_AT_ONCE, live]
        level, rank = list(x), 0
        # carry-save: three words of a weight become one of it and one of the next
        while level:
            carries = []
            level.append(counter[rank])
            while len(level) >= 3:
                p, q, r = level.pop(), level.pop(), level.pop()
                u = p ^ q
                level.append(u ^ r)
                carries.append((p & q) | (u & r))
            if len(level) == 2:
                p, q = level
                carries.append(p & q)
                level = [p ^ q]
            counter[rank] = level[0]
            rank += 1
            level = carries if rank < depth else []
        # lanes still at most radius: compare the vertical counters with the constant from the top bit down
        less, same = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
        for k in range(depth - 1, -1, -1):
            if radius >> k & 1:
                less |= same & ~counter[k]
                same &= counter[k]
            else:
                same &= ~counter[k]
        good = (less | same) & valid[live]
        on = good != 0
        if b + PLANES_AT_ONCE >= BITS:
            out[live] = good
        elif not on.all():
            live = live[on]
            counter = [c[on] for c in counter]
    return out


def near_in_buckets(prints: np.ndarray, start: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each row: the least row that it is linked to inside its bucket.

    prints: rows x 4, the rows of a bucket side by side; start: first row of each bucket. A pair that
    groups found in earlier rounds already link isn't compared again, which leaves the groups exact.
    """
    n = len(prints)
    label = np.arange(n)
    end = np.concatenate([start[1:], [n]]).astype(np.int64)
    size = end - start
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1)
    wide = -(-n // 64)
    padded = np.zeros((BITS, wide * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(BITS, wide)
    full = ~np.uint64(0)
    rank = np.arange(n) - np.repeat(start, size)
    bucket_end = np.repeat(end, size)
    for lo in range(0, int(size.max(initial=0)) - 1, ROUND):
        q = np.flatnonzero((rank >= lo) & (rank < lo + ROUND) & (np.arange(n) + 1 < bucket_end))
        from_word, to_word = (q + 1) >> 6, (bucket_end[q] - 1) >> 6
        total = to_word - from_word + 1
        first = np.cumsum(total) - total
        for a in range(0, len(q), _BLOCK):
            part = slice(a, min(a + _BLOCK, len(q)))
            # a bucket of very many words is met in more than one block
            spans = total[part]
            query = np.repeat(q[part], spans)
            at = ragged(from_word[part], spans)
            for c in range(0, len(query), _BLOCK):
                qq, ww = query[c : c + _BLOCK], at[c : c + _BLOCK]
                low = np.clip(qq + 1 - ww * 64, 0, 64)
                high = np.clip(bucket_end[qq] - ww * 64, 0, 64)
                valid = np.where(low < 64, full << np.minimum(low, 63).astype(np.uint64), np.uint64(0))
                valid &= np.where(high < 64, (np.uint64(1) << np.minimum(high, 63).astype(np.uint64)) - np.uint64(1), full)
                if lo:
                    lanes = np.minimum(ww[:, None] * 64 + np.arange(64), n - 1)
                    apart = label[lanes] != label[qq][:, None]
                    valid &= np.packbits(apart, axis=1, bitorder="little").view(np.uint64)[:, 0]
                on = valid != 0
                qq, ww, valid = qq[on], ww[on], valid[on]
                if not len(qq):
                    continue
                flips = np.negative(bits[qq].T.astype(np.uint64))
                hit = within(planes, valid, radius, flips, ww)
                row = np.flatnonzero(hit)
                if len(row):
                    lane = np.unpackbits(hit[row].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    i, j = np.nonzero(lane)
                    label = join_labels(label, qq[row[i]], ww[row[i]] * 64 + j)
    return label


_FP = ", ".join(f"f{k} long" for k in range(BITS // 64))
_COLS = [f"f{k}" for k in range(BITS // 64)]


def prints_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0..f3) of each row that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p, count = fingerprints(part.column("text"))
                ok = count > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(ok)), *(pa.array(p[ok, k].view(np.int64)) for k in range(len(_COLS)))], ["doc_id", *_COLS])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_FP}")


def _banded(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    positions = band_positions(bits, bands)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                f = np.stack([part.column(c).to_numpy() for c in _COLS], 1)
                every = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1), axis=1)
                band = np.stack([every[:, p] @ weights + (b << bits) for b, p in enumerate(positions)], 1)
                take = np.repeat(np.arange(len(f)), bands)
                yield pa.RecordBatch.from_arrays([pa.array(band.reshape(-1)), part.column("node").take(pa.array(take)), *(pa.array(f[take, k]) for k in range(len(_COLS)))], ["band", "node", *_COLS])

    return nodes.select("node", *_COLS).mapInArrow(run, f"band long, node long, {_FP}")


def _edges(banded: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: list[np.ndarray]) -> pa.RecordBatch:
            band, node, f = t[0], t[1], np.stack(t[2:], 1).view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            size = np.diff(np.concatenate([start, [len(band)]]))
            many = np.repeat(size > 1, size)  # rows alone in their bucket have no partner
            node, f = node[many], f[many]
            size = size[size > 1]
            label = near_in_buckets(f, np.cumsum(size) - size, radius) if len(size) else np.zeros(0, np.int64)
            on = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[label[on]])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= 20_000 and held[-1][0][0] != held[-1][0][-1]:
                t = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(t[0], t[0][-1]))  # the last bucket may go on in the next batch
                yield solve([x[:cut] for x in t])
                held, rows = [[x[cut:] for x in t]], len(t[0]) - cut
        if rows:
            yield solve([np.concatenate(x) for x in zip(*held)])

    return banded.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long")


def _near(nodes: DataFrame, radius: int, recall: float) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes that are within radius."""
    banded = _banded(nodes, *plan_bands(nodes.count(), radius, recall))
    large = stored(banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
    return _edges(in_blocks(banded, "band", "node", BLOCK, large), radius)


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """Near-copy groups: doc_id, group_id (least doc_id of the group), kept (doc_id = group_id).

    One row per distinct id of a text that has words; a text without partner is its own group.
    Null ids, null texts and texts without letters or digits have no fingerprint and no row.
    Ids are whole numbers (others make the cast fail). Rows that share an id count as one document.
    Equal fingerprints always share a group, others within radius with at least the probability
    recall for each pair. Other columns of docs are ignored.
    """
    prints = stored(prints_of(docs, id_col, text_col), "prints")
    same = stored(prints.groupBy(*_COLS).agg(F.min("doc_id").alias("node")), "nodes")
    near = _near(same, radius, recall)
    exact = prints.join(same, _COLS).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    root = components(near.unionByName(exact))
    ids = prints.select("doc_id").distinct()
    group = F.coalesce("root", "doc_id")
    return ids.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", group.alias("group_id"), (F.col("doc_id") == group).alias("kept"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the near copies of an earlier (lower doc_id) document; all columns, whatever their names.

    Rows without an id or a fingerprint (see groups) stay. Of rows that share an id, one stays: the one
    whose text sorts first (a null text first of all), of equal texts any.
    """
    gone = groups(docs, radius).where("not kept").select(F.col("doc_id").alias("gone"))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"))
    left = whole.where("id is not null").join(gone, F.col("id") == F.col("gone"), "left_anti")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row.text"))
    one = left.withColumn("nth", nth).where("nth = 1").select("row").unionByName(whole.where("id is null").select("row"))
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
