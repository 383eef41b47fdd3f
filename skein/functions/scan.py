"""Words of texts by a byte scanner: T.words_of with numpy, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes scanned at once; bounds the memory of the temporaries, which are about twenty times as much.
RUN_BYTES = 1 << 20
_OTHER, _BREAK, _LETTER, _DIGIT = 0, 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b""" \t\n\r\x0b\x0c,.:;!?()"[]{}-+""")] = _BREAK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(batch: pa.RecordBatch, col: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit text bytes; a longer text is a run by itself."""
    ends = np.cumsum(_sizes(batch.column(col)))
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        end = max(int(np.searchsorted(ends, before + limit, side="right")), row + 1)
        yield batch.slice(row, end - row)
        row = end


def _sizes(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def scan(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and how many each text has. Null texts have none."""
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    n = len(col)
    size = _sizes(col)
    total = int(size.sum())
    if not total:
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    _, off, data = col.buffers()
    first = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]]
    first = first - first[0]
    kind = _KIND[raw]
    begins = np.zeros(total + 1, bool)  # where a text begins, and the end of all
    begins[first] = True
    # a no-break space is a break
    wide = np.flatnonzero(raw == 0xC2)
    wide = wide[wide + 1 < total]
    wide = wide[raw[wide + 1] == 0xA0]
    kind[wide] = kind[wide + 1] = _BREAK
    # commas and points between digits join them: they are in the word, but aren't written
    joint = np.flatnonzero((raw == 0x2C) | (raw == 0x2E))
    joint = joint[(joint > 0) & (joint + 1 < total)]
    joint = joint[(kind[joint - 1] == _DIGIT) & (kind[joint + 1] == _DIGIT) & ~begins[joint] & ~begins[joint + 1]]
    written = kind >= _LETTER
    inside = written.copy()
    inside[joint] = True
    # runs of characters of words, cut where texts begin
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | begins[1:-1]
    right[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    if not len(start):
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    doc = np.searchsorted(first, start, side="right") - 1
    # what is neither alphanumeric nor a break is dropped with the breaks behind it: the run before it goes on
    on = np.zeros(len(start), bool)
    on[1:] = (doc[1:] == doc[:-1]) & (kind[np.minimum(end[:-1], total - 1)] == _OTHER)
    before = np.cumsum(written) - written
    heads = start[~on]
    bounds = np.append(before[heads], int(before[-1]) + int(written[-1])).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(bounds), pa.py_buffer(_LOWER[raw[written]]))
    return words.cast(pa.string()), np.bincount(doc[~on], minlength=n).astype(np.int64)
