"""Order-preserving packing of documents into token windows by dynamic programming.

Documents of a shard (a run of the table in doc_id order) follow each other as sentences with
known token counts, and their tokens go with them, so that windows hold token ids. Window cuts lie at sentence or document boundaries. A window of n tokens costs its
padding (capacity - n) or, beyond the capacity, TRUNCATION for each token lost; only its last
sentence may be truncated, so no window swallows sentences whole. A cut inside a document costs
SPLIT. With S the running token count and f the least cost up to a boundary, both forms of a
window's cost split into a part of its begin and a part of its end, and the begins that each
form allows are a range that only moves on: the best ones are the heads of two monotone
queues, which every boundary enters and leaves once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import MODEL, Pieces

CAPACITY = 2048
#: Cost of a token that is cut off, and of a cut inside a document, in padding tokens.
TRUNCATION, SPLIT = 4, 16
#: Documents a shard has on average, and the most shards: in larger tables a shard has more documents.
SHARD_DOCS, MOST_SHARDS = 1024, 1 << 16
#: Tokens from which a shard is packed up to the document that it is at; the next window begins behind that.
SOLVE_TOKENS = 1 << 20


def cuts(tokens: list[int], boundary: list[bool], capacity: int, truncation: int = TRUNCATION, split: int = SPLIT) -> tuple[int, list[int]]:
    """(least cost, ends of the windows) for sentences with these token counts.

    boundary[i]: a document ends behind sentence i. Of equal costs the window that isn't truncated
    wins, then the longer one.
    """
    total, best, begin = [0], [0], [0]
    whole: deque[int] = deque([0])  # begins of windows that hold all up to j
    over: deque[int] = deque()  # begins whose window ends inside the sentence before j
    n, enter = len(tokens), 0
    for j in range(1, n + 1):
        s, before = total[-1] + tokens[j - 1], total[-1]
        total.append(s)
        while enter < j and s - total[enter] > capacity:
            if whole and whole[0] == enter:
                whole.popleft()
            v = best[enter] - truncation * total[enter]
            while over and best[over[-1]] - truncation * total[over[-1]] > v:
                over.pop()
            over.append(enter)
            enter += 1
        while over and before - total[over[0]] >= capacity:
            over.popleft()
        cost, at = None, 0
        if whole:
            at = whole[0]
            cost = best[at] + total[at] + capacity - s
        if over:
            c = best[over[0]] + truncation * (s - total[over[0]] - capacity)
            if cost is None or c < cost:
                cost, at = c, over[0]
        cost += 0 if boundary[j - 1] or j == n else split
        best.append(cost)
        begin.append(at)
        while whole and best[whole[-1]] + total[whole[-1]] > cost + s:
            whole.pop()
        whole.append(j)
    ends = []
    j = n
    while j:
        ends.append(j)
        j = begin[j]
    return best[n], ends[::-1]


def _pack_run(shard: int, window: int, doc: np.ndarray, counts: list[np.ndarray], ids: np.ndarray, capacity: int, truncation: int, split: int) -> pa.RecordBatch:
    """Windows of documents that follow each other, numbered from window on."""
    tokens = np.concatenate(counts)
    per = np.array([len(c) for c in counts])
    row = np.repeat(np.arange(len(doc)), per)
    boundary = np.ones(len(tokens), bool)
    boundary[:-1] = row[1:] != row[:-1]
    ends = cuts(tokens.tolist(), boundary.tolist(), capacity, truncation, split)[1]
    total = np.concatenate([[0], np.cumsum(tokens)])
    doc_begin = total[np.concatenate([[0], np.cumsum(per)])[:-1]]
    out: dict[str, list] = {k: [] for k in ("shard", "window", "n_tokens", "padding", "truncated", "doc_ids", "first_token", "tokens")}
    held, size_of = [], []
    at = 0
    for k, end in enumerate(ends):
        size = int(total[end] - total[at])
        rows = np.arange(row[at], row[end - 1] + 1)
        lo = np.maximum(doc_begin[rows], total[at])
        stop = min(total[end], total[at] + capacity)
        hi = np.minimum(np.append(doc_begin[rows[1:]], total[end]), stop)
        whole = hi > lo
        out["shard"].append(shard)
        out["window"].append(window + k)
        out["n_tokens"].append(min(size, capacity))
        out["padding"].append(max(capacity - size, 0))
        out["truncated"].append(max(size - capacity, 0))
        out["doc_ids"].append(doc[rows][whole].tolist())
        out["first_token"].append((lo - doc_begin[rows])[whole].tolist())
        out["tokens"].append((hi - lo)[whole].tolist())
        held.append(ids[total[at] : stop])
        size_of.append(int(stop - total[at]))
        at = end
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size_of)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *held])))
    return pa.RecordBatch.from_arrays([*(pa.array(out[f.name], f.type) for f in _ARROW), lists], [*_ARROW.names, "ids"])


_RESULT = "shard long, window int, n_tokens int, padding int, truncated int, doc_ids array<long>, first_token array<int>, tokens array<int>, ids array<int>"
_ARROW = pa.schema([("shard", pa.int64()), ("window", pa.int32()), ("n_tokens", pa.int32()), ("padding", pa.int32()), ("truncated", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("first_token", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def shard_starts(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> np.ndarray:
    """The ids at which shards begin, ascending: those whose hash is 0 modulo the documents a shard has.

    Which they are follows from the ids alone, not from how the table is split or how dense ids are.
    About MOST_SHARDS ids at most come to the driver, whatever the table's size.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    per = max(shard_docs, -(-ids.count() // MOST_SHARDS))
    return np.array(sorted(r.id for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(per)) == 0).distinct().collect()), np.int64)


def pack(docs: DataFrame, capacity: int = CAPACITY, truncation: int = TRUNCATION, split: int = SPLIT, shard_docs: int = SHARD_DOCS, model: str = MODEL, solve_tokens: int = SOLVE_TOKENS) -> DataFrame:
    """Windows of docs (doc_id, text) in doc_id order: shard, window, n_tokens, padding, truncated, side by
    side doc_ids, first_token, tokens (which tokens of which documents a window holds), and ids, the tokens.

    Tokens are those of pieces.encode. Token ids are shuffled, never text. Documents without an id have
    no place in the order and are left out; null and empty texts have no tokens and are in no window.
    Rows that share an id follow each other, shorter first; equal rows are packed each. Ids are whole
    numbers (others make the cast fail). Other columns are ignored. A sentence of more tokens than the
    capacity is cut at words into sentences that fit (one of a single word can't be, and is truncated).
    A shard is packed up to a document's end whenever it has gathered solve_tokens tokens, which bounds
    memory by them and one document. An empty table gives no windows.
    """
    starts = docs.sparkSession.sparkContext.broadcast(shard_starts(docs, shard_docs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            for part in slices(batch):
                ids, offsets, tokens, per = pieces.encoded_sentences(part.column("text"), capacity)
                counts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(tokens.astype(np.int32)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                shard = np.searchsorted(starts.value, part.column("doc_id").to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("doc_id"), counts, lists], ["shard", "doc_id", "counts", "ids"]).filter(pa.array(per > 0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, window, held = None, 0, []
        size = 0

        def done() -> pa.RecordBatch:
            doc, counts, ids = zip(*held)
            return _pack_run(shard, window, np.array(doc), list(counts), np.concatenate(ids), capacity, truncation, split)

        for batch in batches:
            docs_, shards = batch.column("doc_id").to_numpy(), batch.column("shard").to_numpy()
            lists = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("counts", "ids")]
            for k in range(batch.num_rows):
                if held and (shards[k] != shard or size >= solve_tokens):
                    out = done()
                    yield out
                    window = window + out.num_rows if shards[k] == shard else 0
                    held, size = [], 0
                shard = int(shards[k])
                counts, ids = (flat[off[k] : off[k + 1]] for flat, off in lists)
                held.append((int(docs_[k]), counts.astype(np.int64), ids.copy()))
                size += len(ids)
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    measured = rows.mapInArrow(measure, "shard long, doc_id long, counts array<int>, ids array<int>")
    ordered = measured.repartition("shard").sortWithinPartitions("shard", "doc_id", F.size("counts"), F.xxhash64("counts"), F.xxhash64("ids"))
    return ordered.mapInArrow(solve, _RESULT)
