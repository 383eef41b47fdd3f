"""Language identification by prediction by partial matching.

One variable-order byte context tree per language is counted from a bounded labelled
sample, then frozen. A text's score under a language is its exact code length in bits:
each byte costs what the longest context known to that language assigns to it, escapes
(method C, no exclusion) included, down to a uniform order -1. The trees of all languages
share one suffix automaton, so a text is walked once and every step adds one row of costs.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import slices, string_parts

#: Longest context in bytes.
ORDER = 3
#: Labelled documents taken per language for training; the bound of the sample.
SAMPLE_DOCS = 120
#: Longer texts don't take part in the sample; with the number above this bounds what comes to the driver.
SAMPLE_BYTES = 1 << 16
#: A text whose best code length is above this many bits a byte is in none of the languages
#: (bytes that no tree foresees cost 8 bits and their escapes; labelled texts, keys and mixed ones too, stay below 6.2).
MAX_BITS = 7.0
_SEGMENT = 160
_tables: dict[str, tuple] = {}


@dataclasses.dataclass
class PpmModel:
    """Frozen counts: context key (a leading 1 bit, then its bytes), symbol, language, count."""

    key: str
    langs: list[str]
    order: int
    context: np.ndarray
    symbol: np.ndarray
    lang: np.ndarray
    count: np.ndarray


def fit(samples: dict[str, list[str]], order: int = ORDER) -> PpmModel:
    """Count every context of up to order bytes in the sample texts of each language."""
    langs = sorted(samples)
    parts: list[tuple] = []
    for l, name in enumerate(langs):
        raw, offsets = string_parts(pa.array(samples[name], pa.string()))
        if not len(raw):
            continue
        at = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
        wide = raw.astype(np.int64)
        ctx = np.ones(len(raw), np.int64)
        for k in range(order + 1):
            if k:
                ctx = ctx + 0
                ctx[k:] = ctx[k:] + (wide[:-k] << (8 * (k - 1))) + (1 << (8 * k)) - (1 << (8 * (k - 1)))
            ok = at >= k
            pair, n = np.unique((ctx[ok] << 8) | wide[ok], return_counts=True)
            parts.append((pair >> 8, pair & 255, np.full(len(pair), l), n))
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
    order_by = np.lexsort((cols[1], cols[0], cols[2]))
    cols = [c[order_by] for c in cols]
    key = f"{order}:{','.join(langs)}:{hash(tuple(c.tobytes() for c in cols))}"
    return PpmModel(key, langs, order, *cols)


def tables(model: PpmModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state, costs) of the automaton; kept for the worker's life."""
    if model.key in _tables:
        return _tables[model.key]
    nl = len(model.langs)
    seen = np.unique(model.symbol)
    cls = np.full(256, len(seen), np.int32)
    cls[seen] = np.arange(len(seen))
    width = len(seen) + 1
    states = np.unique(np.concatenate([[1], model.context]))
    length = np.zeros(len(states), np.int64)
    for k in range(1, model.order + 1):
        length[states >= 1 << (8 * k)] = k
    # the suffix link drops the oldest byte, which is the highest one of the key
    low = states - (1 << (8 * length)) & ((1 << np.maximum(8 * (length - 1), 0)) - 1)
    parent = np.searchsorted(states, np.where(length > 0, low + (1 << np.maximum(8 * (length - 1), 0)), 1))
    step = np.zeros((len(states), width), np.int32)
    cost = np.full((len(states), width, nl), 8.0, np.float64)
    state = np.searchsorted(states, model.context)
    total, kinds = np.zeros((len(states), nl)), np.zeros((len(states), nl))
    np.add.at(total, (state, model.lang), model.count)
    np.add.at(kinds, (state, model.lang), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
        bits = np.log2((total + kinds)[state, model.lang]) - np.log2(model.count)
    for k in range(model.order + 1):
        own = np.flatnonzero(length == k)
        if k:
            step[own], cost[own] = step[parent[own]], cost[parent[own]]
        cost[own] += escape[own][:, None, :]
        of = length[state] == k
        cost[state[of], cls[model.symbol[of]], model.lang[of]] = bits[of]
        # a context of k + 1 bytes is reached from its first k bytes by its last one
        kids = np.flatnonzero(length == k + 1)
        last = states[kids] & 255
        before = np.searchsorted(states, states[kids] >> 8)
        step[before, cls[last]] = kids
    out = (cls, step.reshape(-1), cost.reshape(len(states) * width, nl).astype(np.float32), width)
    _tables.clear()
    _tables[model.key] = out
    return out


def code_lengths(model: PpmModel, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language. Long texts are cut into segments that warm up on the bytes before."""
    cls, step, cost, width = tables(model)
    n = np.diff(offsets)
    per = -(-n // _SEGMENT)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[doc] + nth * _SEGMENT
    end = np.minimum(begin + _SEGMENT, offsets[doc + 1]) if len(doc) else begin
    by = np.argsort(begin - end, kind="stable")
    begin, end = begin[by], end[by]
    warm = np.where(nth[by] > 0, model.order, 0)
    symbols = cls.astype(np.int16)[raw]
    state = np.zeros(len(by), np.int64)
    for k in range(model.order, 0, -1):
        on = warm > 0
        state[on] = step[state[on] * width + symbols[begin[on] - k]]
    size = end - begin
    bits = np.zeros((len(by), len(model.langs)), np.float64)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = state[:live] * width + symbols[begin[:live] + t]
        bits[:live] += np.take(cost, at, axis=0)
        state[:live] = step[at]
    out = np.zeros((len(n), len(model.langs)))
    np.add.at(out, doc[by], bits)
    return out


def decide(model: PpmModel, bits: np.ndarray, n_bytes: np.ndarray, max_bits: float) -> tuple:
    """(index of the best language or -1, bits a byte, lead over the second in bits a byte, accepted)."""
    size = np.maximum(n_bytes, 1)[:, None]
    rate = bits / size
    if rate.shape[1] == 0:
        none = np.full(len(n_bytes), -1)
        return none, np.zeros(len(none)), np.zeros(len(none)), np.zeros(len(none), bool)
    best = np.argmin(rate, axis=1)
    low = rate[np.arange(len(rate)), best]
    rest = rate.copy()
    rest[np.arange(len(rate)), best] = np.inf
    lead = rest.min(axis=1) - low if rate.shape[1] > 1 else np.zeros(len(rate))
    ok = (n_bytes > 0) & (low <= max_bits)
    return np.where(n_bytes > 0, best, -1), low, lead, ok


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> PpmModel:
    """A model from the labelled rows of docs (doc_id, text, lang).

    The sample is the sample_docs rows of each language whose doc_id hashes lowest: the same
    rows however the table is split, chosen from two narrow columns before any text is read.
    Rows without id, text or language and texts of more than SAMPLE_BYTES bytes don't take part;
    where rows share ids, so many of a language again stay, by their hashes.
    """
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [
        r.doc_id
        for r in docs.where("doc_id is not null and lang is not null").select("doc_id", "lang")
        .withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample_docs).select("doc_id").collect()
    ]
    samples: dict[str, list[str]] = {}
    usable = docs.where(F.col("doc_id").isin(ids)).where("text is not null and lang is not null").where(F.octet_length("text") <= SAMPLE_BYTES)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    rows = usable.select("doc_id", "lang", "text").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample_docs).collect() if ids else []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return fit(samples, order)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("bits_per_byte", T.DoubleType()), T.StructField("lead", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
])


def identify(docs: DataFrame, model: PpmModel, max_bits: float = MAX_BITS) -> DataFrame:
    """Language of each document: doc_id, lang, bits_per_byte, lead, accepted.

    One row per input row, nothing shuffled. Null and empty texts: lang 'und', 0 bits, not
    accepted. Ties go to the language that sorts first. Other columns of docs are ignored;
    repeated rows are judged alike; whole texts are scored, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part in slices(batch):
                raw, offsets = string_parts(part.column("text"))
                best, low, lead, ok = decide(m, code_lengths(m, raw, offsets), np.diff(offsets), max_bits)
                none = best < 0
                low, lead = np.where(none, 0.0, low), np.where(none, 0.0, lead)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.round(low, 4)), pa.array(np.round(lead, 4)), pa.array(ok)],
                    ["doc_id", "lang", "bits_per_byte", "lead", "accepted"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def keep_known(docs: DataFrame, model: PpmModel, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns. Null and empty texts go."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch):
                raw, offsets = string_parts(part.column("text"))
                ok = decide(m, code_lengths(m, raw, offsets), np.diff(offsets), max_bits)[3]
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
