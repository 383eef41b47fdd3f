"""Suffix-array dedup: longest-previous-factor arrays remove later copies of long passages.

Words are runs of letters and digits, ASCII case ignored. A passage of MIN_WORDS words or
more that stands earlier, in an earlier document (by doc_id) or earlier in the same one, is
cut; its first copy stays. A suffix array over a whole corpus can't be spread over machines,
so suffixes are bucketed first by an anchor that any two copies share:

1. Every run of MIN_WORDS words is marked by its least GRAM-word hash (a minimiser). Equal
   runs have equal anchors at equal places, so anchors seen once can't lie in a repeat.
2. For an anchor seen more often, the words that any run marked by it can reach go to the
   anchor's bucket. Every run that repeats lies whole in a bucket with its earlier copy.
3. A bucket's texts, in document order, get a suffix array (prefix doubling) and LCPs; the
   nearest smaller positions before and after in suffix order give the longest previous
   factor of each position. Factors of MIN_WORDS or more are cut.
4. An anchor seen more than HOT times, such as a line that millions of documents share, would
   make a bucket that no task can hold. Its bucket is split until only equal runs are in one:
   by the hashes of the runs of MIN_WORDS words that it marks. Of a run's copies all but the
   first are cut, and the first is found by a minimum in two steps, over SALTS parts and then
   over the parts' firsts, so nothing is gathered.

The result is exact: a word is cut if and only if a run of MIN_WORDS words that covers it
has an earlier equal one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_hashes, mix, ragged, slices, stored, string_parts, words

MIN_WORDS = 50
GRAM = 12
#: Words of buckets that one suffix array covers; larger buckets go on with what was new in them so far.
BATCH_WORDS = 1 << 20
#: Occurrences from which an anchor's bucket is split by runs, and the parts over which the copies of a run are spread.
HOT, SALTS = 512, 64


def anchors(w, min_words: int = MIN_WORDS, gram: int = GRAM) -> np.ndarray:
    """Indices of the words at which the minimisers of all runs of min_words words begin (runs don't leave a text)."""
    n = len(w.hash)
    wide = min_words - gram + 1
    g = gram_hashes(w.hash, gram)
    if len(g) < wide:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    # least key of each window, by doubling
    have, least = 1, key
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    begin = np.arange(len(least))
    inside = w.doc[begin] == w.doc[np.minimum(begin + min_words - 1, n - 1)]
    inside &= begin + min_words <= n
    at = (least[inside] & low).astype(np.int64)
    return np.unique(at)


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]), dtype=np.uint32)
    return out


def previous_factors(word: np.ndarray, left: np.ndarray, bucket: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each position, 0 where below least.

    word: symbols of all texts side by side; left: words from a position to the end of its text;
    bucket: texts of different buckets never match. Suffixes are sorted by their first words up to the
    power of two at or above least: lengths are exact up to that, and longer ones at least that.
    """
    n = len(word)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    levels = [_rank(bucket.astype(np.uint32), word)]
    span = 1
    while span < least:
        nxt = np.zeros(n, np.uint32)
        ok = np.flatnonzero(left > span)
        nxt[ok] = levels[-1][ok + span]
        levels.append(_rank(levels[-1], nxt))
        span *= 2
    # only suffixes whose first least words also start another suffix can have such a factor
    size = np.bincount(levels[-1] if span == least else levels[-2])
    near = np.flatnonzero((left >= least) & (size[levels[-1] if span == least else levels[-2]] > 1))
    sa = near[np.argsort(levels[-1][near], kind="stable")]
    m = len(sa)
    if not m:
        return out
    lcp = np.zeros(m, np.int64)
    a, b = sa[:-1], sa[1:]
    same = np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            x, y = a + same, b + same
            ok = (same < left[a]) & (same < left[b])
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            same += ok << k
    lcp[1:] = np.minimum(same, np.minimum(left[a], left[b]))
    best = np.zeros(m, np.int64)
    for back in (True, False):
        # est: nearest entry not yet known to be later in the text; low: least LCP on the way to it
        est = np.arange(m) - 1 if back else np.arange(m) + 1
        low = lcp.copy() if back else np.concatenate([lcp[1:], [0]])
        todo = np.flatnonzero(low >= least)
        while len(todo):
            jump = todo[sa[est[todo]] > sa[todo]]
            low_next, est_next = np.minimum(low[jump], low[est[jump]]), est[est[jump]]
            low[jump], est[jump] = low_next, est_next
            todo = jump[low_next >= least]
        best = np.maximum(best, np.where(low >= least, low, 0))
    out[sa] = best
    return out


_SENT = ["h", "h2", "salt", "doc_id", "tag", "start", "words"]


def _blobs(data: np.ndarray, size: np.ndarray, missing: bool = False) -> pa.Array:
    if missing:
        return pa.nulls(len(size), pa.binary())
    offsets = np.concatenate([[0], np.cumsum(size * data.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _shipped(batch: pa.RecordBatch, min_words: int, gram: int, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """What goes to the buckets from a batch (doc_id, tag, text, at): of an anchor the words that its runs can reach,
    of a hot one (h null) the two hashes of each run that it marks."""
    lists = batch.column("at")
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), counts)
    pos = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
    hot = ~np.asarray(flat.field("h").is_valid())
    w = words(batch.column("text"), normalised=True)
    total = np.diff(w.first)

    def rows(h: pa.Array, h2: pa.Array, salt: np.ndarray, of: np.ndarray, start: np.ndarray, blob: pa.Array) -> pa.RecordBatch:
        take = pa.array(of)
        return pa.RecordBatch.from_arrays([h, h2, pa.array(salt.astype(np.int32)), batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(start.astype(np.int32)), blob], _SENT)

    cold = np.flatnonzero(~hot)
    begin = np.maximum(pos - (min_words - gram), 0)
    size = np.minimum(pos + min_words, total[row]) - begin
    upto, a = np.cumsum(size[cold]), 0
    while a < len(cold):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + at_once, side="right")))
        k = cold[a:z]
        data = (w.hash[ragged(w.first[row[k]] + begin[k], size[k])] >> np.uint64(32)).astype(np.uint32)
        yield rows(flat.field("h").take(pa.array(k)), pa.array(np.zeros(len(k), np.int64)), np.zeros(len(k)), row[k], begin[k], _blobs(data, size[k]))
        a = z
    if not hot.any():
        return
    # runs whose minimiser is a hot anchor: all runs that hold it, which covers those it marks
    first = begin[hot]
    last = np.minimum(pos[hot], total[row[hot]] - min_words)
    starts = np.unique(ragged((w.first[row[hot]] + first)[last >= first], (last - first + 1)[last >= first]))
    h = gram_hashes(w.hash, min_words)[starts]
    with np.errstate(over="ignore"):
        h2 = gram_hashes(mix(w.hash + np.uint64(0x5851F42D4C957F2D)), min_words)[starts]
    doc = w.doc[starts]
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    salt = 1 + (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
    yield rows(pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), salt, doc, starts - w.first[doc], _blobs(h, np.zeros(len(h), np.int64), missing=True))


class _Solver:
    """Repeats of the buckets of one sorted partition. A bucket has at most HOT anchors, so memory is bounded by
    batch_words and one bucket (anchors may still collide with others, whose words then differ)."""

    def __init__(self, least: int, batch_words: int = BATCH_WORDS):
        self.least, self.batch_words = least, batch_words
        self.held: list[tuple] = []  # (h, doc, tag, start, length, words, old)
        self.size = 0

    def _runs(self, t: tuple) -> tuple:
        """Rows of one anchor and document that overlap, as one run."""
        h, doc, tag, start, length, flat, old = t
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])
        # how far the rows before reach: several may begin at a text's first word, in any order
        group = np.cumsum(np.concatenate([[0], ~same])) << 40
        reach = np.maximum.accumulate(group + start + length) - group
        overlap = np.concatenate([[False], same & (start[1:] <= reach[:-1])])
        skip = np.zeros(len(h), np.int64)
        skip[1:] = np.where(overlap[1:], np.minimum(reach[:-1] - start[1:], length[1:]), 0)
        first = np.cumsum(length) - length
        flat = flat[ragged(first + skip, length - skip)]
        head = np.flatnonzero(~overlap)
        total = np.add.reduceat(length - skip, head)
        return h[head], doc[head], tag[head], start[head], total, flat, old[head]

    def solve(self, t: tuple, keep_last: bool) -> tuple[pa.RecordBatch, tuple | None]:
        h, doc, tag, start, length, flat, old = self._runs(t)
        n = len(h)
        bucket = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        run = np.repeat(np.arange(n), length)
        first = np.cumsum(length) - length
        within = np.arange(len(flat)) - first[run]
        left = length[run] - within
        factor = previous_factors(flat, left, bucket[run], self.least)
        hit = np.flatnonzero((factor >= self.least) & ~old[run])
        begin, end = within[hit], within[hit] + factor[hit]
        of = run[hit]
        # union of a run's intervals: begins ascend, so a new one starts beyond every end so far
        reach = np.maximum.accumulate(end + first[of]) if len(of) else end
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (begin[1:] + first[of[1:]] > reach[:-1])
        heads = np.flatnonzero(fresh)
        tails = np.concatenate([heads[1:], [len(of)]]) - 1 if len(of) else heads
        r = of[heads]
        s, e = start[r] + begin[heads], start[r] + reach[tails] - first[r]
        found = pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tag[r]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc_id", "tag", "s", "e"])
        if not keep_last:
            return found, None
        # of the bucket that goes on, runs with a first copy in them are all that later ones need
        new = np.bincount(run, (left >= self.least) & (factor < self.least), minlength=n) > 0
        keep = (bucket == bucket[-1]) & new
        words_kept = flat[np.repeat(keep, length)]
        return found, (h[keep], doc[keep], tag[keep], start[keep], length[keep], words_kept, np.ones(int(keep.sum()), bool))

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = batch.column("words").buffers()[2], np.frombuffer(batch.column("words").buffers()[1], np.int32)[batch.column("words").offset :][: batch.num_rows + 1]
        flat = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32) if raw is not None else np.zeros(0, np.uint32)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc_id", "tag")]
        self.held.append((*cols, batch.column("start").to_numpy().astype(np.int64), np.diff(offsets).astype(np.int64) // 4, flat, np.zeros(batch.num_rows, bool)))
        self.size += len(flat)
        if self.size >= self.batch_words:
            t = self._joined()
            h, doc, tag = t[:3]
            # the last bucket may go on, and so may its last document's runs
            of_last = (h == h[-1]) & (doc == doc[-1]) & (tag == tag[-1])
            cut = int(np.argmax(of_last))
            if not cut:
                return
            edge = int(t[4][:cut].sum())
            now, rest = tuple(x[:cut] if i != 5 else x[:edge] for i, x in enumerate(t)), tuple(x[cut:] if i != 5 else x[edge:] for i, x in enumerate(t))
            found, carry = self.solve(now, h[cut - 1] == h[cut])
            if found.num_rows:
                yield found
            self.held = [x for x in (carry, rest) if x is not None]
            self.size = sum(len(x[5]) for x in self.held)

    def _joined(self) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*self.held))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self.solve(self._joined(), False)[0]


def repeats(keyed: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, batch_words: int = BATCH_WORDS, hot: int = HOT) -> DataFrame:
    """(__id, __tag, cuts): the word spans of each document that repeat earlier text. keyed: __id, __tag, __row with text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), normalised=True)
                at = anchors(w, min_words, gram)
                h = gram_hashes(w.hash, gram)[at] if len(at) else np.zeros(0, np.uint64)
                row = pa.array(w.doc[at])
                pos = (at - w.first[w.doc[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), part.column("doc_id").take(row), part.column("tag").take(row), pa.array(pos)], ["h", "doc_id", "tag", "pos"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed_rows = pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__tag"), batch.column("__row").field("text"), batch.column("at")], ["doc_id", "tag", "text", "at"])
            for part in slices(listed_rows.filter(batch.column("at").is_valid()), limit=1 << 20):
                yield from _shipped(part, min_words, gram)

    kinds = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("h", pa.int64()), ("h2", pa.int64())])

    def found_rows(doc: pa.Array, tag: pa.Array, s: pa.Array, e: pa.Array, h: pa.Array | None = None, h2: pa.Array | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(s), pa.int64())
        return pa.RecordBatch.from_arrays([doc, tag, s, e, none if h is None else h, none if h2 is None else h2], schema=kinds)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = _Solver(min_words, batch_words)
        last: tuple | None = None
        for batch in batches:
            runs = pa.compute.is_null(batch.column("words"))
            some = batch.filter(pa.compute.invert(runs))
            if some.num_rows:
                for x in solver.feed(some):
                    yield found_rows(*x.columns)
            hot = batch.filter(runs)
            if hot.num_rows:
                # rows of a run side by side, in document order: all but the part's first are copies, the first may be
                h, h2, salt = (hot.column(c).to_numpy() for c in ("h", "h2", "salt"))
                again = np.concatenate([[last == (h[0], h2[0], salt[0])], (h[1:] == h[:-1]) & (h2[1:] == h2[:-1]) & (salt[1:] == salt[:-1])])
                last = (h[-1], h2[-1], salt[-1])
                start = hot.column("start")
                end = pa.compute.add(start, pa.scalar(min_words, pa.int32()))
                open_ = pa.array(~again)
                keep = lambda c: pa.compute.if_else(open_, hot.column(c), pa.scalar(None, pa.int64()))
                yield found_rows(hot.column("doc_id"), hot.column("tag"), start, end, keep("h"), keep("h2"))
        for x in solver.finish():
            yield found_rows(*x.columns)

    docs = keyed.select(F.col("__id").alias("doc_id"), F.col("__tag").alias("tag"), F.col("__row.text").alias("text")).where("doc_id is not null and text is not null")
    seen = stored(docs.mapInArrow(mark, "h long, doc_id long, tag long, pos int"), "anchors")
    # counts are combined before the shuffle and joined back: an anchor of a third of all rows isn't one task's
    often = seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    again = seen.join(often, "h").select("doc_id", "tag", "pos", F.when(F.col("n") <= hot, F.col("h")).alias("h"))
    listed = again.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "pos")).alias("at")).withColumnsRenamed({"doc_id": "__id", "tag": "__tag"})
    # the same join side as in _with_cuts, column for column and unfiltered, so that the texts are shuffled once for both
    reached = keyed.join(listed.hint("shuffle_hash"), ["__id", "__tag"], "left")
    sent = reached.mapInArrow(ship, "h long, h2 long, salt int, doc_id long, tag long, start int, words binary")
    spans = sent.repartition("h", "salt").sortWithinPartitions("h", "h2", "salt", "doc_id", "tag", "start").mapInArrow(solve, "doc_id long, tag long, s int, e int, h long, h2 long")
    # the firsts of a run's parts, at most SALTS: the first of them stays. Settled spans are spread by their document
    of = [F.coalesce("h", F.xxhash64("doc_id", "s")), F.coalesce("h2", "tag"), F.col("h").isNull()]
    nth = F.row_number().over(Window.partitionBy(*of).orderBy("doc_id", "tag", "s"))
    cut_ = spans.withColumn("nth", nth).where("h is null or nth > 1")
    return cut_.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts"))


def cut(col: pa.Array, cuts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the word spans in cuts, words cut, words before). A span goes from its first word to the next kept one."""
    w = words(col, normalised=True)
    raw, offsets = string_parts(col)
    n = len(col)
    counts = np.nan_to_num(cuts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    flat = cuts.flatten()
    s, e = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "e"))
    drop = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(drop, w.first[row] + s, 1)
    np.add.at(drop, w.first[row] + e, -1)
    gone = np.cumsum(drop)[:-1] > 0
    first = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (w.doc[1:] != w.doc[:-1])]))
    last = np.flatnonzero(gone & np.concatenate([~gone[1:] | (w.doc[1:] != w.doc[:-1]), [True]]))
    begin = w.start[first]
    after = last + 1
    inside = (after < len(w.hash)) & (w.doc[np.minimum(after, len(w.hash) - 1)] == w.doc[last]) if len(w.hash) else np.zeros(0, bool)
    end = np.where(inside, w.start[np.minimum(after, len(w.hash) - 1)], offsets[w.doc[last] + 1]) if len(last) else begin
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(kept[offsets].astype(np.int64).tobytes()), pa.py_buffer(raw[keep].tobytes())).cast(pa.string())
    if col.null_count:
        text = pa.compute.if_else(col.is_valid(), text, pa.scalar(None, pa.string()))
    return text, np.bincount(w.doc, gone, minlength=n).astype(np.int64), np.diff(w.first)


def _with_cuts(docs: DataFrame, min_words: int, batch_words: int = BATCH_WORDS, hot: int = HOT) -> DataFrame:
    """(__id, __tag, __row, cuts). The columns of docs are inside __row, so that their names can't clash with others."""
    fields = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]
    keyed = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__tag"), F.struct(*fields).alias("__row"))
    spans = repeats(keyed, min_words, batch_words=batch_words, hot=hot)
    return keyed.join(spans.hint("shuffle_hash"), ["__id", "__tag"], "left")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, batch_words: int = BATCH_WORDS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, text without later copies, n_words before, cut_words.

    Null texts stay null and rows without an id are left as they are (no order says which copy is
    first). Empty texts and texts of fewer than min_words words are never cut. Rows that share an id
    are ordered by a hash of their text; equal rows count as one document and are cut alike. Ids are
    whole numbers (others make the cast fail). Other columns of docs are ignored. A text that is one
    long copy ends up empty. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__row").field("text"), batch.column("cuts")], ["doc_id", "text", "cuts"])
            for part in slices(rows):
                text, gone, count = cut(part.column("text"), part.column("cuts"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, pa.array(count), pa.array(gone)], ["doc_id", "text", "n_words", "cut_words"])

    return _with_cuts(docs.select("doc_id", "text"), min_words, batch_words, hot).mapInArrow(run, "doc_id long, text string, n_words long, cut_words long")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies cut from text, all columns, whatever their names; n_chars, where there is one, follows the text.

    A document of which no word is left goes; one that had no words stays. Nulls, ties and repeated rows as in dedup().
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("__row")
            at = names.index("text")
            # by place, not by name: any name may be a column of docs
            flat = pa.RecordBatch.from_arrays([whole.field(at), batch.column("cuts"), pa.array(np.arange(batch.num_rows))], ["text", "cuts", "nth"])
            for part in slices(flat):
                text, gone, count = cut(part.column("text"), part.column("cuts"))
                first = part.column("nth")[0].as_py()
                cols = [text if i == at else whole.field(i).slice(first, part.num_rows) for i in range(len(names))]
                if "n_chars" in names:
                    n = names.index("n_chars")
                    touched = pa.array(gone > 0)
                    size = pa.compute.utf8_length(text).cast(cols[n].type)
                    cols[n] = pa.compute.if_else(touched, size, cols[n])
                out = pa.RecordBatch.from_arrays(cols, names)
                yield out.filter(pa.array((gone == 0) | (gone < count)))

    return _with_cuts(docs, min_words).mapInArrow(run, docs.schema)
