"""Toxicity by compression distance with two trained zstandard dictionaries.

One dictionary is trained on ordinary text. The toxic one is a keyword list: the words that
set toxic texts apart, in shuffled order, not passages of toxic text. Word forms that aren't
in the list save nothing, and hashes hide shared stems.
Every text is cut into windows of WINDOW words; a window's score is how many bytes shorter
it gets when the toxic dictionary's content is added. A text is toxic when the bytes saved
per word reach a threshold, or those saved in some run of SPAN windows reach another: the
first finds short texts, the second toxic passages inside long clean ones. Both are
calibrated on labelled rows that neither dictionary saw.

Words enter the compressor as fixed 8-byte hashes. Plain text doesn't work here: a match
costs zstandard about as many bits as the five to seven letters it replaces, so plain
windows found at most 24 in 100 toxic texts at 0.5 % false alarms; hashed words find 98.
"""

from __future__ import annotations

import dataclasses
import pickle
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import discard, slices, stored, words

#: Words in a window.
WINDOW = 16
#: Windows in a run that is judged by itself: 256 words.
SPAN = 16
#: Words of the clean texts that the threshold of runs is calibrated on, joined from shorter ones: the longer a text, the likelier chance hits in one of its runs.
LONG = 10_000
#: Labelled documents of each class that are sampled; half train, half calibrate.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1200, 6000
#: Longer texts don't take part in the sample; with the numbers above this bounds its size.
SAMPLE_BYTES = 1 << 16
#: A sample of at most so many bytes is fitted on the driver. A larger one stays in the shared folder and is read by tasks: the model is the same.
LOCAL_BYTES = 1 << 25
TOXIC_DICT, ORDINARY_DICT = 8192, 16384
#: Runs of words that a dictionary is trained on at most, spread evenly over the sample; bounds the trainer's memory.
DICTIONARY_RUNS = 40_000
#: A window counts from this many bytes saved.
LEAST_SAVED = 3
#: A word sets toxic texts apart if it is in at least so many of them, and in so many times the share of ordinary ones.
LEAST_TEXTS, LEAST_RATIO = 4, 20
_made: dict[int, tuple] = {}


@dataclasses.dataclass
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    threshold: float
    span_threshold: float = np.inf

    def compressors(self) -> tuple:
        key = hash((self.toxic, self.ordinary))
        if key not in _made:
            _made.clear()
            _made[key] = (_compressor(self.ordinary), _compressor(self.toxic + self.ordinary))
        return _made[key]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # both get the same table sizes: else the common part is matched differently and drowns the difference
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=6,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if content:
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p)


def _lengths(c: zstandard.ZstdCompressor, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.int64)
    segments = np.stack([begin, size], 1).astype(np.uint64).tobytes()
    return np.fromiter((len(x) for x in c.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, segments), threads=1)), np.int64, len(begin))


def _measured(model: ToxicModel, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scores(), and per text the most bytes saved in a run of SPAN windows (in all, if it has fewer)."""
    w = words(col, normalised=True)
    count = np.diff(w.first)
    per = -(-count // WINDOW)
    doc = np.repeat(np.arange(len(count)), per)
    upto = np.cumsum(per)
    begin = w.first[doc] + (np.arange(len(doc)) - np.repeat(upto - per, per)) * WINDOW
    size = np.minimum(begin + WINDOW, w.first[doc + 1]) - begin if len(doc) else begin
    raw = w.hash.tobytes()
    plain, toxic = model.compressors()
    saved = _lengths(plain, raw, begin * 8, size * 8) - _lengths(toxic, raw, begin * 8, size * 8)
    hit = saved >= LEAST_SAVED
    counted = np.where(hit, saved, 0)
    total = np.bincount(doc, counted, minlength=len(count))
    top, span = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    np.maximum.at(top, doc, counted)
    sums = np.concatenate([[0], np.cumsum(counted)])
    np.maximum.at(span, doc, sums[np.minimum(np.arange(len(doc)) + SPAN, upto[doc])] - sums[:-1])
    return total / np.maximum(count, 1), np.bincount(doc, hit, minlength=len(count)).astype(np.int64), per, top, span


def scores(model: ToxicModel, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: bytes saved per word in windows that count, such windows, windows, highest saving of one."""
    return _measured(model, col)[:4]


def _toxic(model: ToxicModel, rate: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (rate >= model.threshold) | (span >= model.span_threshold)


class Stored:
    """Texts that stay in a table (nth, text): those numbered at, in this order. A list of them, as far as fit() needs one."""

    def __init__(self, rows: DataFrame, at: np.ndarray):
        self.rows, self.at = rows, at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, some: slice | np.ndarray) -> Stored:
        return Stored(self.rows, self.at[some])

    def run(self, f: Callable[[np.ndarray, pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What f makes of runs of texts, given their places among those wanted."""
        wanted = self.at

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nth = batch.column("nth").to_numpy()
                place = np.minimum(np.searchsorted(wanted, nth), max(len(wanted) - 1, 0))
                on = wanted[place] == nth if len(wanted) else np.zeros(len(nth), bool)
                for run in slices(pa.RecordBatch.from_arrays([pa.array(place[on]), batch.column("text").filter(pa.array(on))], ["place", "text"]), limit=1 << 20):
                    yield from f(run.column("place").to_numpy(), run.column("text"))

        return self.rows.select("nth", "text").mapInArrow(part, schema)


Texts = list[str] | Stored


def _over(texts: Texts, f: Callable[[np.ndarray, pa.Array], tuple]) -> list[tuple]:
    """f(places, texts) of runs of texts, in the order of their first places, which f's results begin with.

    Runs are small enough for the word scanner's temporaries, which are many times the text."""
    if isinstance(texts, Stored):
        pickled = texts.run(lambda place, col: iter([pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(place, col))])], ["out"])]), "out binary").collect()
        return [pickle.loads(r.out) for r in pickled]
    out, first = [], 0
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), limit=1 << 20):
        out.append(f(np.arange(first, first + part.num_rows), part.column("text")))
        first += part.num_rows
    return out


def _each(texts: Texts, f: Callable[[pa.Array], tuple], like: tuple) -> tuple[np.ndarray, ...]:
    """f's arrays, an entry a text, of all texts in order. like: an empty array of each kind."""
    parts = _over(texts, lambda place, col: (place, *f(col)))
    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), kind="stable")
    return tuple(np.concatenate([x, *(p[k + 1] for p in parts)])[order] for k, x in enumerate(like))


def _once(col: pa.Array) -> np.ndarray:
    """Hashes of the words of each text, once per text."""
    w = words(col, normalised=True)
    return np.concatenate([np.zeros(0, np.uint64), *(np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:]))])


def _spread_runs(texts: Texts, per: int) -> np.ndarray:
    """Word hashes of the texts one after another, in whole runs of per; where there are more than DICTIONARY_RUNS, so many, spread evenly."""
    (count,) = _each(texts, lambda col: (np.diff(words(col, normalised=True).first),), (np.zeros(0, np.int64),))
    n = int(count.sum()) // per
    wanted = np.zeros(n + 1, bool)  # the last stands for the words that are left over
    wanted[np.arange(n) if n <= DICTIONARY_RUNS else np.linspace(0, n - 1, DICTIONARY_RUNS).astype(np.int64)] = True
    begin = np.cumsum(count) - count

    def picked(place: np.ndarray, col: pa.Array) -> tuple:
        w = words(col, normalised=True)
        on = wanted[(begin[place][w.doc] + np.arange(len(w.doc)) - w.first[w.doc]) // per]
        return place[w.doc[on]], w.hash[on]

    parts = _over(texts, picked)
    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), kind="stable")
    return np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])[order]


def _apart_from_copies(texts: Texts) -> Texts:
    (prints,) = _each(texts, lambda col: simhash.fingerprints(col)[:1], (np.zeros((0, simhash.BITS // 64), np.uint64),))
    if not len(prints):
        return texts
    first = np.flatnonzero(simhash.near_in_buckets(prints, np.array([0])) == np.arange(len(prints)))
    return texts[first] if isinstance(texts, Stored) else [texts[i] for i in first]


def _rates(model: ToxicModel, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes saved per word, windows, most saved in a run of SPAN windows) of each text."""
    return _each(texts, lambda col: tuple(_measured(model, col)[k] for k in (0, 2, 4)), (np.zeros(0),) * 3)


def _cut(bad: np.ndarray, good: np.ndarray) -> float:
    """The threshold that errs least. A false alarm drops a clean text, and clean texts are many: their rate weighs three times."""
    cuts = np.unique(np.concatenate([bad, good]))
    cuts = cuts[cuts > 0]
    if not len(bad) or not len(cuts):
        return np.inf
    missed = np.searchsorted(np.sort(bad), cuts) / len(bad)
    alarms = 1 - np.searchsorted(np.sort(good), cuts) / max(len(good), 1)
    return float(cuts[np.argmin(missed + 3 * alarms)])


def _dictionary(tokens: np.ndarray, per: int, size: int) -> bytes:
    """A trained dictionary, entropy tables and all, to be used as plain content: its tables hold for plain literals, not for hashes.

    Where there is too little to train on, zstandard refuses; the content is then the last size bytes of what there is.
    """
    n = len(tokens) // per
    cut = [tokens[i * per : i * per + per].tobytes() for i in (range(n) if n <= DICTIONARY_RUNS else np.linspace(0, n - 1, DICTIONARY_RUNS).astype(np.int64))]
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[-size:]


def _joined(texts: Texts) -> Texts:
    """The texts one after another, in texts of about LONG words."""
    (count,) = _each(texts, lambda col: (np.array([len(t.split()) for t in col.to_pylist()], np.int64),), (np.zeros(0, np.int64),))
    groups, group = np.unique(np.cumsum(count) // LONG, return_inverse=True)
    if isinstance(texts, Stored):
        cut = lambda place, col: iter([pa.RecordBatch.from_arrays([pa.array(group[place]), pa.array(place), col], ["nth", "place", "text"])])
        each = texts.run(cut, "nth long, place long, text string").groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
        return Stored(each.select("nth", F.array_join("all.text", " ").alias("text")), np.arange(len(groups)))
    ends = np.searchsorted(group, np.arange(len(groups) + 1))
    return [" ".join(texts[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def telling_words(toxic: Texts, ordinary: Texts) -> np.ndarray:
    """Hashes of the words in at least LEAST_TEXTS toxic texts and in LEAST_RATIO times the share of ordinary ones (half a text at least)."""
    kinds, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for (x,) in _over(toxic, lambda _, col: (_once(col),)))]), return_counts=True)
    kinds, n = kinds[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
    if not len(kinds):
        return kinds

    def held(_: np.ndarray, col: pa.Array) -> tuple:
        once = _once(col)
        i = np.minimum(np.searchsorted(kinds, once), len(kinds) - 1)
        found, m = np.unique(i[kinds[i] == once], return_counts=True)
        return found.astype(np.int32), m.astype(np.int32)

    there = np.zeros(len(kinds), np.int64)
    for found, m in _over(ordinary, held):
        there[found] += m
    rate, other = n / max(len(toxic), 1), (there + 0.5) / max(len(ordinary), 1)
    return kinds[rate >= LEAST_RATIO * other]


def fit(toxic: Texts, ordinary: Texts) -> ToxicModel:
    """Dictionaries from every other text, the threshold from the others. Copies and near copies count once:
    else the rare words of a toxic text that was copied would look like what sets toxic texts apart."""
    toxic, ordinary = _apart_from_copies(toxic), _apart_from_copies(ordinary)
    apart = telling_words(toxic[::2], ordinary[::2])
    plain = _spread_runs(ordinary[::2], 16)
    # every word that sets toxic texts apart stands as often in what the dictionary is trained on, so that rarer languages' words get in too.
    # Windows of toxic text around those words did worse: their ordinary words save bytes in clean texts as well
    shuffled = np.random.default_rng(8)
    passages = np.concatenate([shuffled.permutation(apart) for _ in range(8)]) if len(apart) else apart
    model = ToxicModel(_dictionary(passages, 8, TOXIC_DICT), _dictionary(plain, 16, ORDINARY_DICT), np.inf)
    bad, windows, bad_span = _rates(model, toxic[1::2])
    model.threshold = _cut(bad, _rates(model, ordinary[1::2])[0])
    # short texts are what the first threshold is for: the second comes from passages of half a run at least, if there are some
    long = windows >= SPAN // 2
    model.span_threshold = _cut(bad_span[long] if long.any() else bad_span, _rates(model, _joined(ordinary[1::2]))[2])
    return model


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    The sample holds the SAMPLE_TOXIC and SAMPLE_ORDINARY labelled ids whose hashes are lowest;
    rows without id, label or text and texts of more than SAMPLE_BYTES bytes don't take part, an id
    labelled both ways counts as toxic. Where rows share ids, equal ones count once, and of the others
    so many again stay, by their hashes. Without toxic labels there is a warning, and nothing is toxic.

    The sample is written to the shared folder and deleted at the end. Up to LOCAL_BYTES of it come to
    the driver; of a larger one only fingerprints, words of toxic texts, counts, scores and runs do.
    """
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    at_most = F.when(F.col("toxic") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_ORDINARY)
    picked = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("nth", F.row_number().over(w)).where((F.col("nth") <= SAMPLE_ORDINARY) & (F.col("nth") <= at_most))
    )
    picked = picked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("bad"))
    usable = docs.where("doc_id is not null and text is not null").where(F.octet_length("text") <= SAMPLE_BYTES)
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    w = Window.partitionBy("bad").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h")
    keys = usable.select("doc_id", "h").join(F.broadcast(picked), "doc_id").distinct().withColumn("nth", F.row_number().over(w))
    keys = keys.where((F.col("nth") <= SAMPLE_ORDINARY) & (F.col("nth") <= F.when(F.col("bad"), SAMPLE_TOXIC).otherwise(SAMPLE_ORDINARY)))
    # SAMPLE_TOXIC + SAMPLE_ORDINARY rows by construction
    keys = stored(keys.withColumn("nth", F.row_number().over(Window.partitionBy("bad").orderBy("doc_id", "h")).cast("long") - 1), "keys")
    sample = stored(usable.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("bad", "nth").agg(F.min("text").alias("text")), "sample")
    held = {r.bad: r for r in sample.groupBy("bad").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if sum(r["size"] for r in held.values()) <= LOCAL_BYTES:
        rows = sorted(tuple(r) for r in sample.select("nth", "text", "bad").collect())
        toxic, ordinary = ([t for _, t, bad in rows if bad == wanted] for wanted in (True, False))
    else:
        toxic, ordinary = (Stored(sample.where(F.col("bad") == wanted), np.arange(held[wanted].n if wanted in held else 0)) for wanted in (True, False))
    if not len(toxic):
        warnings.warn("no row is labelled toxic: the model calls nothing toxic", stacklevel=2)
    model = fit(toxic, ordinary)
    discard(keys)
    discard(sample)
    return model


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.BooleanType()), T.StructField("saved_per_word", T.DoubleType()),
    T.StructField("toxic_windows", T.LongType()), T.StructField("windows", T.LongType()), T.StructField("most_saved", T.LongType()),
    T.StructField("span_saved", T.LongType()),
])


def classify(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per row of docs: doc_id, toxic, saved_per_word, toxic_windows, windows, most_saved, span_saved
    (the most bytes saved in a run of SPAN windows).

    Nothing is shuffled. Null and empty texts have no windows and aren't toxic. Other columns
    are ignored, repeated rows are judged alike, long texts are scored whole and by every run of
    SPAN windows. A score equal to its threshold is toxic.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rate, hits, n, top, span = _measured(held.value, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(_toxic(held.value, rate, span)), pa.array(np.round(rate, 6)), pa.array(hits), pa.array(n), pa.array(top), pa.array(span)],
                    ["doc_id", "toxic", "saved_per_word", "toxic_windows", "windows", "most_saved", "span_saved"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs that classify() doesn't call toxic, with all their columns, whatever their names.

    Null and empty texts stay, and so do rows without an id, as ids aren't looked at; repeated rows are judged alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rate, _, _, _, span = _measured(held.value, part.column("text"))
                yield part.filter(pa.array(~_toxic(held.value, rate, span)))

    return docs.mapInArrow(run, docs.schema)
