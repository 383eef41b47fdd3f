"""SpotSigs: fingerprints of chains of content words behind common-word anchors.

A signature is an anchor and the next CHAIN words that aren't common ones. A text is the set
of its signatures; near copies have a Jaccard similarity of at least THRESHOLD. The search is
exact: in any fixed order of signatures, two such sets share one among their first
n - ceil(THRESHOLD * n) + 1 (n: set size), and their sizes lie within a factor THRESHOLD.

Texts whose words are the same are one group, however few signatures they have; near copies are
looked for among texts of LEAST_SIGNATURES signatures or more.

Order is free, so signatures that many texts hold come last (a bounded table of the heaviest,
counted over all texts): a passage that thousands share is then rarely what brings texts
together. A bucket's sets are sorted by size and read as a stream; partners end where the size
partition does, which is all that is held, and a pair is compared only if its sizes and the
signatures behind the shared one still allow the threshold. A bucket that is large all the same
is split into blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, hash_word, mix, ragged, slices, stored, words
from .graph import components, join_labels

THRESHOLD = 0.5
CHAIN = 3
#: Fewer signatures than this don't tell texts apart; such texts are near copies only of texts with the same words.
LEAST_SIGNATURES = 3
#: Sets of a bucket that are solved together; larger buckets are split into blocks.
BLOCK = 4096
#: A signature that the heavy table counts more often goes to its blocks at once: the window that looks for buckets with the
#: same sets would be one task's.
WINDOW_ROWS = 1 << 20
#: Entries of the table of heavy signatures, and the count in one batch of rows from which one is looked at.
HEAVY, HEAVY_LOCAL = 100_000, 4
ANCHORS = "the a an is le la un une est der die das ein ist el una es".split()
COMMON = ANCHORS + (
    "of and to in that it for was on are as with his they at be this have from or had by but not what were we "
    "les de des du et en que qui dans pour par sur pas ne ce il elle au aux se son sa avec plus "
    "und den von zu mit sich des auf für nicht im eine als auch an dem er hat dass sie nach bei "
    "los las del y por con su para como lo al más o pero no"
).split()
_PAIRS = 1 << 17
_SENT = 1 << 20


def _known(names: list[str]) -> np.ndarray:
    return np.unique(np.array([hash_word(x) for x in names], np.uint64))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all texts side by side, offsets); each text's are distinct and ascending."""
    return _signatures(words(col, normalised=True), len(col))


def _signatures(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    common = _among(w.hash, _known(COMMON))
    spots = np.flatnonzero(_among(w.hash, _known(ANCHORS)))
    content = np.flatnonzero(~common)
    # first content word behind each anchor; the whole chain must lie in the text
    first = np.searchsorted(content, spots)
    ok = first + CHAIN <= len(content)
    spots, first = spots[ok], first[ok]
    ok = w.doc[content[first + CHAIN - 1]] == w.doc[spots] if len(spots) else np.zeros(0, bool)
    spots, first = spots[ok], first[ok]
    with np.errstate(over="ignore"):
        h = w.hash[spots].copy()
        for k in range(CHAIN):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[content[first + k]])
    doc = w.doc[spots]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    off = (offsets * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _unpack(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    if not len(col):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw.view(kind), (off - off[0]) // np.dtype(kind).itemsize


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def similar(flat: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets i and j is at least threshold. Sets are runs of distinct values in flat."""
    pair = np.arange(len(i), dtype=np.uint64) << np.uint64(32)
    both = np.concatenate([np.repeat(pair, size[x]) | flat[ragged(first[x], size[x])] for x in (i, j)])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
    common = np.bincount(twice.astype(np.int64), minlength=len(i))
    return common >= threshold * (size[i] + size[j] - common) - 1e-9


def _solve(key: np.ndarray, node: np.ndarray, rest: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) of buckets: rows of a key side by side by ascending set size. rest: signatures behind the shared one."""
    n = len(key)
    label = np.arange(n)
    # a set has partners up to size / threshold: the end of its partition
    bucket = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    scaled = bucket * (int(size.max(initial=0)) * 4.0 + 4) + size
    end = np.searchsorted(scaled, scaled + size * (1 / threshold - 1) + 1e-6, side="right")
    rank = np.arange(n) - np.searchsorted(bucket, bucket, side="left")
    for lo in range(0, int(rank.max(initial=0)) + 1, 16):
        q = np.flatnonzero((rank >= lo) & (rank < lo + 16) & (end > np.arange(n) + 1))
        many = end[q] - q - 1
        upto = np.cumsum(many)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, side="right")))
            i, j = np.repeat(q[a:b], many[a:b]), ragged(q[a:b] + 1, many[a:b])
            a = b
            need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
            on = (label[i] != label[j]) & (1 + np.minimum(rest[i], rest[j]) >= need) & (node[i] != node[j])
            i, j = i[on], j[on]
            for c in range(0, len(i), _PAIRS // 8):
                x, y = i[c : c + _PAIRS // 8], j[c : c + _PAIRS // 8]
                on = label[x] != label[y]
                x, y = x[on], y[on]
                hit = similar(flat, first, size, x, y, threshold)
                label = join_labels(label, x[hit], y[hit])
    on = np.flatnonzero(label != np.arange(n))
    return on, label[on]


def _edges(sent: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, limit = 0, 20_000

        def solve(cut: int | None) -> pa.RecordBatch:
            nonlocal held, rows
            key, node, rest, size, flat = (np.concatenate(x) for x in zip(*held))
            first = np.cumsum(size) - size
            a, b = _solve(key, node, rest, flat.astype(np.uint64), first, size, threshold)
            # of the last bucket, sets that larger ones can still be near to go on; links that were found are found again
            on = np.zeros(len(key), bool) if cut is None else (key == key[-1]) & (size >= threshold * size[-1])
            held = [(key[on], node[on], rest[on], size[on], flat[np.repeat(on, size)])]
            rows = int(on.sum())
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, off = _unpack(batch.column("sigs"), np.uint32)
            held.append((batch.column("key").to_numpy(), batch.column("node").to_numpy(), batch.column("rest").to_numpy().astype(np.int64), np.diff(off), flat))
            rows += batch.num_rows
            if rows >= limit:
                yield solve(0)
                limit = max(20_000, 2 * rows)
        if rows:
            yield solve(None)

    return sent.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-copy groups: doc_id, n_signatures, group_id (least doc_id of the group), kept (doc_id = group_id).

    One row per distinct id of a row with an id. Texts with the same words in the same order (case and
    punctuation aside) are always one group, and so are equal sets of LEAST_SIGNATURES signatures or more;
    null texts and those without words are groups of their own. Rows that share an id count as one document
    (n_signatures: the largest). Groups are the connected components of these and of all pairs with a Jaccard
    similarity of at least threshold among texts of LEAST_SIGNATURES signatures or more, 64-bit hashes aside.
    Ids are whole numbers (others make the cast fail). Other columns of docs are ignored; an empty table gives no rows.
    """

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), normalised=True)
                h, off = _signatures(w, part.num_rows)
                # few signatures: the digest is that of the words in their order, else that of the set
                few, some = np.diff(off) < LEAST_SIGNATURES, np.diff(w.first) > 0
                with np.errstate(over="ignore"):
                    nth = np.arange(len(w.hash)) - w.first[w.doc]
                    digest = []
                    for salt in (1, 2):
                        x = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))])
                        y = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash + mix((nth + salt * 0x9E3779B9).astype(np.uint64))))])
                        digest.append(pa.array(np.where(few, y[w.first[1:]] - y[w.first[:-1]], x[off[1:]] - x[off[:-1]]).view(np.int64)))
                cols = [part.column("doc_id"), pa.array(np.diff(off).astype(np.int32)), pa.array(some), *digest, _binary(h, off)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "some", "d1", "d2", "sigs"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    spots = stored(rows.mapInArrow(spot, "doc_id long, n int, some boolean, d1 long, d2 long, sigs binary"), "spots")
    # equal sets have equal 128-bit digests: one of them stands for all
    told = spots.where(F.col("n") >= LEAST_SIGNATURES)
    nodes = stored(told.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("sigs").alias("sigs")), "sets")

    def heavy_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(_unpack(batch.column("sigs"), np.uint64)[0], return_counts=True)
            on = n >= HEAVY_LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(n[on])], ["h", "n"])

    top = nodes.select("sigs").mapInArrow(heavy_here, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).collect()
    order = np.argsort(np.array([r.h for r in top], np.int64).view(np.uint64), kind="stable")
    table = docs.sparkSession.sparkContext.broadcast((np.array([r.h for r in top], np.int64).view(np.uint64)[order], np.array([r.n for r in top], np.int64)[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, count = table.value
        for batch in batches:
            flat, off = _unpack(batch.column("sigs"), np.uint64)
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            weight = np.zeros(len(flat), np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, flat), len(heavy) - 1)
                weight = np.where(heavy[at] == flat, count[at], 0)
            by = np.lexsort((flat, weight, row))
            nth = np.arange(len(flat)) - off[row]
            on = nth < prefix_size(size, threshold)[row]
            key, of = flat[by][on], pa.array(row[on])
            blocks = np.where(weight > window_rows, -(-weight // block), 0)[by][on]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("node").take(of), pa.array((size[row] - nth - 1)[on].astype(np.int32)), pa.array(blocks.astype(np.int32))], ["key", "node", "rest", "blocks"])

    window_rows, block = WINDOW_ROWS, BLOCK
    every = nodes.select("node", "sigs").mapInArrow(prefixes, "key long, node long, rest int, blocks int")
    shared = every.where("blocks = 0").select("key", "node", "rest")
    # Near copies share many signatures, whose buckets hold the same texts: one of such buckets is enough. The
    # bound on what lies behind the first shared signature is the largest of theirs.
    at = Window.partitionBy("key")
    often = shared.withColumns({"m": F.count("*").over(at), "b1": F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(at), "b2": F.sum(F.xxhash64("node", F.lit(2)).cast("decimal(20,0)")).over(at)}).where("m > 1")
    buckets = often.groupBy("m", "b1", "b2", "node").agg(F.max("rest").alias("rest")).withColumn("key", F.xxhash64("m", "b1", "b2"))
    buckets = buckets.select("key", "node", "rest", F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(0).cast("int").alias("blocks")).unionByName(every.where("blocks > 0"))
    # every two blocks of a large bucket meet under a key of their own
    count = F.greatest("blocks", F.lit(2))
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    others = F.when(F.col("blocks") == 0, F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), count - 1), lambda x: x != F.col("own")))
    met = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    buckets = buckets.withColumn("own", own).withColumn("other", F.explode(others)).withColumn("key", met)
    listed = buckets.groupBy("node").agg(F.collect_list(F.struct("key", "rest")).alias("keys"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            per = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat_keys = keys.flatten()
            flat, off = _unpack(batch.column("sigs"), np.uint64)
            size = np.diff(off)
            of = np.repeat(np.arange(len(size)), per)
            upto, a = np.cumsum(size[of]), 0
            while a < len(of):
                # rows of at most _SENT signatures together, one row at least
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _SENT, side="right")))
                o = of[a:z]
                data = (flat[ragged(off[o], size[o])] >> np.uint64(32)).astype(np.uint32)
                # two signatures of a set that share their upper half would count twice: they are too rare to matter for a threshold
                k = flat_keys.slice(a, len(o))
                yield pa.RecordBatch.from_arrays(
                    [k.field("key"), batch.column("node").take(pa.array(o)), k.field("rest"), pa.array(size[o].astype(np.int32)), _binary(data, np.concatenate([[0], np.cumsum(size[o])]))],
                    ["key", "node", "rest", "n", "sigs"],
                )
                a = z

    sent = nodes.join(listed.hint("shuffle_hash"), "node").select("node", "sigs", "keys").mapInArrow(send, "key long, node long, rest int, n int, sigs binary")
    near = _edges(sent, threshold)
    same = told.select("doc_id", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    few = spots.where((F.col("n") < LEAST_SIGNATURES) & F.col("some")).select("doc_id", "d1", "d2")
    firsts = few.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1")
    same = same.unionByName(few.join(firsts, ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    root = components(near.unionByName(same)).withColumnRenamed("node", "doc_id")
    ids = spots.groupBy("doc_id").agg(F.max("n").alias("n_signatures"))
    group = F.coalesce("root", "doc_id")
    return ids.join(root, "doc_id", "left").select("doc_id", "n_signatures", group.alias("group_id"), (F.col("doc_id") == group).alias("kept"))
