"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a model file reads a text once; at every
position the output links give the pieces that end there, longest first, and each relaxes
the best score of its end from that of its start (Viterbi). No piece of such a model has a
word mark behind another character, so the best split of a text is the best splits of its
words side by side: each distinct word of a batch is solved once, all of them in step, one
numpy operation a byte position.

The model file on this machine was trained for merges, not for Viterbi. Its pieces and
scores are used as they stand, as a unigram model: results equal those of the public
library with the same file whose model type is set to unigram, not those of its merges.
"""

from __future__ import annotations

import struct
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices, span_hashes, string_parts

#: Where the model lies; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words whose splits a worker keeps between batches before it starts anew.
KEPT_WORDS = 1 << 18
#: Longer words are first cut where no piece can stand across; bytes solved in step at once; parts beyond that are solved one by one.
LONG_WORD, SPLIT_BYTES, ALONE = 512, 1 << 20, 4096
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_MARK = "▁".encode()
_SPACE = 0x20
_STOPS = np.frombuffer(b".!?\n", np.uint8)
_loaded: dict[str, "Pieces"] = {}


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, b[i : i + size]
        i += size


class Pieces:
    """The automaton of a model. Word marks are the space byte here, which no piece has otherwise."""

    def __init__(self, entries: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        self.lists: list[list] | None = None
        self._forget()
        self.kinds = np.array([k for *_, k in entries], np.int8)
        self.byte_id = np.zeros(256, np.int32)
        text: list[bytes] = []
        unknown = 0
        for i, (piece, _, kind) in enumerate(entries):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                text.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                unknown = i
                text.append(" ⁇ ".encode())
            else:
                text.append(b"" if kind == CONTROL else piece.encode().replace(_MARK, b" "))
        if not (self.kinds == BYTE).any():
            self.byte_id[:] = unknown
        self.size = np.array([len(t) for t in text], np.int64)
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        usable = [(t, s, i) for i, (t, (_, s, k)) in enumerate(zip(text, entries)) if k in (NORMAL, USER) and t]
        if any(b" " in t.lstrip(b" ") for t, *_ in usable):
            raise ValueError("a piece has a word mark behind another character; its texts don't split into words")
        self.unknown_score = min((s for _, s, _ in usable), default=0.0) - 10
        self._build(usable)

    def _build(self, usable: list[tuple[bytes, float, int]]) -> None:
        kids: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        for t, _, i in usable:
            at = 0
            for c in t:
                nxt = kids[at].get(c)
                if nxt is None:
                    nxt = kids[at][c] = len(kids)
                    kids.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = nxt
            piece[at] = i
        n = len(kids)
        used = sorted({c for d in kids for c in d})
        self.classes = np.full(256, len(used), np.int32)
        self.classes[used] = np.arange(len(used))
        self.width = len(used) + 1
        goto = np.zeros((n, self.width), np.int32)
        fail = np.zeros(n, np.int32)
        # the output link of a node: the longest proper suffix that is a piece
        out = np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                goto[at] = goto[fail[at]]
            for c, k in kids[at].items():
                fail[k] = goto[at, self.classes[c]] if at else 0
                out[k] = fail[k] if piece[fail[k]] >= 0 else out[fail[k]]
                queue.append(k)
            for c, k in kids[at].items():
                goto[at, self.classes[c]] = k
        piece_of = np.array(piece, np.int32)
        score = np.zeros(len(self.size))
        for _, s, i in usable:
            score[i] = s
        self.goto = goto.reshape(-1)
        self.first = np.where(piece_of >= 0, np.arange(n), out).astype(np.int32)
        self.link, self.piece, self.depth = out, piece_of, np.array(depth, np.int32)
        self.score = np.where(piece_of >= 0, score[np.maximum(piece_of, 0)], 0.0)

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _loaded:
            entries, dummy = [], True
            with open(path, "rb") as f:
                for field, value in _fields(f.read()):
                    if field == 1:
                        d = dict(_fields(value))
                        entries.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
                    elif field == 3:
                        spec = dict(_fields(value))
                        dummy = bool(spec.get(3, 1))
                        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                            raise ValueError("the model normalises text in ways that aren't supported")
            _loaded.clear()
            _loaded[path] = cls(entries, dummy)
        return _loaded[path]

    def split_words(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words raw[begin : begin + size], best split each.

        A word without spaces can be a whole text. Long ones are cut where no piece stands across, which
        leaves their best split the same, so that time follows the bytes and not the longest word.
        """
        word = np.arange(len(begin))
        if (size > LONG_WORD).any():
            cut = [self._safe_cuts(raw, int(b), int(b + k)) if k > LONG_WORD else np.zeros(0, np.int64) for b, k in zip(begin, size)]
            many = np.array([len(c) + 1 for c in cut])
            word = np.repeat(word, many)
            begin, end = np.concatenate([np.concatenate([[b], c]) for b, c in zip(begin, cut)]), begin + size
            size = np.where(np.concatenate([word[1:] != word[:-1], [True]]), end[word], np.append(begin[1:], 0)) - begin
        ids, counts, upto, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.cumsum(size), 0
        while a < len(begin):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SPLIT_BYTES, side="right")))
            alone = np.flatnonzero(size[a:z] > ALONE)
            if len(alone):  # a part without any place to cut: by itself, before or after the others
                z = a + max(1, int(alone[0]))
            found = self._split_one(raw[begin[a] : begin[a] + size[a]].tobytes()) if size[a] > ALONE else self._split(raw, begin[a:z], size[a:z])
            ids.append(found[0])
            counts.append(found[1])
            a = z
        return np.concatenate(ids), np.bincount(word, np.concatenate(counts), minlength=int(word[-1]) + 1 if len(word) else 0).astype(np.int64)

    def _safe_cuts(self, raw: np.ndarray, lo: int, hi: int, segment: int = 1024) -> np.ndarray:
        """Positions in (lo, hi) that no piece stands across, at most one in 64 bytes. The automaton reads all segments
        in step: behind as many bytes as the longest piece has, its state doesn't depend on where it began."""
        at = np.arange(lo, hi, segment)
        state, longest = np.zeros(len(at), np.int64), np.zeros(hi - lo, np.int32)
        for t in range(-int(self.depth.max()), segment):
            on = slice(int(np.searchsorted(at, lo - t)), int(np.searchsorted(at, hi - t)))
            pos = at[on] + t
            state[on] = self.goto[state[on] * self.width + self.classes[raw[pos]]]
            if t >= 0:
                longest[pos - lo] = self.depth[self.first[state[on]]]
        end = np.arange(lo + 1, hi + 1)
        reach = np.minimum.accumulate((end - longest)[::-1])[::-1]
        safe = np.flatnonzero((reach >= end - 1) & ((raw[lo:hi] & 0xC0) != 0x80)) + lo
        safe = safe[safe > lo]
        return safe[np.concatenate([[True], safe[1:] // 64 != safe[:-1] // 64])] if len(safe) else safe

    def _split_one(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """_split of one long word, a byte at a time."""
        n, width, goto, classes = len(text), self.width, memoryview(self.goto), self.classes.tolist()
        if self.lists is None:
            self.lists = [x.tolist() for x in (self.first, self.link, self.depth, self.score, self.piece)]
        first, link, depth, score, piece = self.lists
        best, back, back_size = array("d", [0.0]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        state = char = 0
        for t, c in enumerate(text):
            char = char + 1 if c & 0xC0 == 0x80 else 1
            state = goto[state * width + classes[c]]
            node, top, who, how, single = first[state], -np.inf, 0, 0, False
            while node > 0:
                length = depth[node]
                s = best[t + 1 - length] + score[node]
                single = single or length == char
                if s > top:
                    top, who, how = s, piece[node], length
                node = link[node]
            if not single and (t + 1 == n or text[t + 1] & 0xC0 != 0x80):
                s = best[t + 1 - char] + self.unknown_score
                if s > top:
                    top, who, how = s, -1, char
            best[t + 1], back[t + 1], back_size[t + 1] = top, who, how
        out, at = [], n
        while at:
            at -= back_size[at]
            out.append(at)
        start = np.array(out[::-1])
        length = np.diff(np.append(start, n))
        kind = np.frombuffer(back, np.int32)[start + length]
        ids = np.repeat(kind, np.where(kind < 0, length, 1))
        lost = kind < 0
        ids[ids < 0] = self.byte_id[np.frombuffer(text, np.uint8)[ragged(start[lost], length[lost])]]
        return ids, np.array([len(ids)])

    def _split(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(begin)
        by = np.argsort(-size, kind="stable")
        begin, size = begin[by], size[by]
        longest = int(size.max(initial=0))
        alive = np.searchsorted(-size, -np.arange(longest + 1), side="right")
        base = np.concatenate([[0], np.cumsum(alive)])
        best = np.full(int(base[-1]), -np.inf)
        back = np.zeros(int(base[-1]), np.int32)
        back_size = np.zeros(int(base[-1]), np.int32)
        best[:n] = 0
        state = np.zeros(n, np.int64)
        char = np.zeros(n, np.int32)
        for t in range(longest):
            live = int(alive[t + 1])
            byte = raw[begin[:live] + t]
            inner = (byte & 0xC0) == 0x80
            char[:live] = np.where(inner, char[:live] + 1, 1)
            state[:live] = self.goto[state[:live] * self.width + self.classes[byte]]
            at = np.full(live, -np.inf)
            who, how = np.zeros(live, np.int32), np.zeros(live, np.int32)
            single = np.zeros(live, bool)
            row, node = np.arange(live), self.first[state[:live]]
            while True:
                on = node > 0
                if not on.all():
                    row, node = row[on], node[on]
                if not len(row):
                    break
                length = self.depth[node]
                score = best[base[t + 1 - length] + row] + self.score[node]
                single[row] |= length == char[row]
                better = score > at[row]
                r, k = row[better], node[better]
                at[r], who[r], how[r] = score[better], self.piece[k], length[better]
                node = self.link[node]
            # a character that is no piece: unknown, where it ends
            left = size[:live] - t - 1
            follows = raw[np.minimum(begin[:live] + t + 1, len(raw) - 1)]
            ends = (left == 0) | ((follows & 0xC0) != 0x80)
            odd = np.flatnonzero(ends & ~single)
            if len(odd):
                score = best[base[t + 1 - char[odd]] + odd] + self.unknown_score
                better = score > at[odd]
                r = odd[better]
                at[r], who[r], how[r] = score[better], -1, char[r]
            here = slice(int(base[t + 1]), int(base[t + 1]) + live)
            best[here], back[here], back_size[here] = at, who, how
        # back from the ends
        row, pos = np.arange(n), size.copy()
        rows, stops, ids, sizes = [], [], [], []
        while len(row):
            on = pos > 0
            row, pos = row[on], pos[on]
            where = base[pos] + row
            rows.append(row)
            stops.append(pos)
            ids.append(back[where])
            sizes.append(back_size[where])
            pos = pos - back_size[where]
        row, stop = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *stops])
        piece, length = np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int32), *sizes])
        row = by[row]
        order = np.argsort((row << 32) | stop, kind="stable")
        row, stop, piece, length = row[order], stop[order], piece[order], length[order]
        # unknown characters become their bytes
        many = np.where(piece < 0, length, 1)
        out = np.repeat(piece, many)
        lost = piece < 0
        if lost.any():
            original = np.empty(n, np.int64)
            original[by] = begin
            src = ragged(original[row[lost]] + stop[lost] - length[lost], length[lost])
            out[np.repeat(lost, many)] = self.byte_id[raw[src]]
        return out, np.bincount(row, many, minlength=n).astype(np.int64)

    def _words(self, col: pa.Array) -> tuple[np.ndarray, ...]:
        """(bytes, begin and size of each word, its hash, end of each text): a word goes from a run of marks to the next."""
        raw, offsets = string_parts(col)
        if len(raw) and (raw[:-2] == _MARK[0]).any() and _MARK in raw.tobytes():
            raw, offsets = string_parts(pa.array([None if t is None else t.replace("▁", " ") for t in col.to_pylist()], pa.string()))
        size = np.diff(offsets)
        # the mark before each text's first word
        lead = (size > 0).astype(np.int64) * self.dummy_prefix
        start = offsets[:-1] + np.cumsum(lead) - lead
        full = np.full(len(raw) + int(lead.sum()), _SPACE, np.uint8)
        full[ragged(start + lead, size)] = raw
        ends = start + lead + size
        if not len(full):
            return full, ends[:0], ends[:0], np.zeros(0, np.uint64), ends
        space = full == _SPACE
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[start[size > 0]] = True
        begin = np.flatnonzero(head)
        length = np.diff(np.concatenate([begin, [len(full)]]))
        return full, begin, length, span_hashes(full, begin, begin + length), ends

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts side by side, offsets). Null and empty texts have none."""
        full, begin, length, key, ends = self._words(col)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64)
        first, every = self._solved(full, key, begin, length)
        total = np.concatenate([[0], np.cumsum(every)])
        return self.kept_ids[ragged(first, every)], np.concatenate([[0], total[np.searchsorted(begin, ends)]])

    def encoded_sentences(self, col: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """encode(), tokens of each sentence, number of sentences of each text. A sentence begins at a text's first
        word and at every word behind one that ends in . ! ? or a line break; one of more than longest
        tokens is cut before the word that goes beyond."""
        full, begin, length, key, ends = self._words(col)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64), np.zeros(0, np.int64), np.zeros(len(col), np.int64)
        first, every = self._solved(full, key, begin, length)
        total = np.concatenate([[0], np.cumsum(every)])
        ids, offsets = self.kept_ids[ragged(first, every)], np.concatenate([[0], total[np.searchsorted(begin, ends)]])
        row = np.searchsorted(ends, begin, side="right")
        head = np.ones(len(begin), bool)
        head[1:] = (row[1:] != row[:-1]) | np.isin(full[begin[1:] - 1], _STOPS)
        at = np.flatnonzero(head)
        tokens = np.add.reduceat(every, at)
        long = np.flatnonzero(tokens > longest)
        if len(long):
            reach = np.append(at, len(begin))
            upto = np.cumsum(every)
            for k in long:
                word = int(at[k])
                while True:
                    # the first word with which more than longest tokens would stand since word
                    word = max(word + 1, int(np.searchsorted(upto, (upto[word - 1] if word else 0) + longest, side="right")))
                    if word >= reach[k + 1]:
                        break
                    head[word] = True
            at = np.flatnonzero(head)
            tokens = np.add.reduceat(every, at)
        return ids, offsets, tokens, np.bincount(row[at], minlength=len(col))

    def _solved(self, full: np.ndarray, key: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, count) of each word's ids in kept_ids. Words solved before are looked up by their hashes."""
        words, one, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.kept) > KEPT_WORDS or len(self.kept_ids) > 8 * KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.kept, words)
        new = np.ones(len(words), bool)
        there = at < len(self.kept)
        new[there] = self.kept[at[there]] != words[there]
        ids, count = self.split_words(full, begin[one[new]], length[one[new]])
        first = len(self.kept_ids) + np.cumsum(count) - count
        self.kept_ids = np.concatenate([self.kept_ids, ids])
        self.kept = np.insert(self.kept, at[new], words[new])
        self.kept_first = np.insert(self.kept_first, at[new], first)
        self.kept_count = np.insert(self.kept_count, at[new], count)
        here = np.searchsorted(self.kept, words)[which]
        return self.kept_first[here], self.kept_count[here]

    def _forget(self) -> None:
        self.kept, self.kept_ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.kept_first, self.kept_count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts side by side, offsets). Ids outside the model are unknown pieces."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, int(np.argmax(self.kinds == UNKNOWN)))
        size = self.size[ids]
        raw = self.bytes[ragged(self.begin[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        if not self.dummy_prefix or not len(raw):
            return raw, at
        some = np.flatnonzero(np.diff(at) > 0)
        drop = at[some][raw[at[some]] == _SPACE]
        keep = np.ones(len(raw), bool)
        keep[drop] = False
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _list(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids, n_tokens, and with check also round_trip.

    round_trip: decoding gives the text's bytes again (not so for texts that hold the word mark
    character itself, which decodes to a space). Null and empty texts: no ids, round_trip true.
    Nothing is shuffled; whole texts are encoded, whatever their length; other columns of docs are
    ignored and repeated rows encoded alike. Of equally good splits the one with the longer last
    piece wins, as in the public library. model: path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = pieces.encode(part.column("text"))
                cols, names = [part.column("doc_id"), _list(ids, offsets), pa.array(np.diff(offsets))], ["doc_id", "ids", "n_tokens"]
                if check:
                    raw, at = pieces.decode(ids, offsets)
                    was, were = string_parts(part.column("text"))
                    same = np.diff(at) == np.diff(were)
                    if np.array_equal(at, were):
                        off = np.bincount(np.searchsorted(at, np.flatnonzero(raw != was), side="right") - 1, minlength=len(same))
                        same &= off[: len(same)] == 0
                    else:
                        same &= np.array([np.array_equal(raw[a:b], was[c:d]) for a, b, c, d in zip(at[:-1], at[1:], were[:-1], were[1:])], bool)
                    cols.append(pa.array(same))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids give null; byte pieces that aren't UTF-8 give replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            col = batch.column("ids")
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = col.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            raw, at = pieces.decode(ids, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            data = raw.tobytes()
            text = [data[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], col.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
