"""Vectorised word hashing over Arrow string columns, shared by the token- and shingle-based operators.

A word is a maximal run of bytes other than ASCII white space. Hashes are 64-bit and depend on the word's bytes
only, so that they agree between executors, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes hashed at once; the tables of powers have this many entries unless one word is longer.
SEGMENT = 1 << 18
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_R, _R_INV)):
            x = np.full(max(n, SEGMENT), base, np.uint64)
            x[0] = 1
            _tables[k] = np.multiply.accumulate(x)
    return _tables


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null rows are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        _, off = string_buffers(arr)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (with one more at the end)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = off[:-1][off[:-1] < n]
    first[rows] |= inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] |= inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        lo, hi = starts[at], ends[to - 1]
        power, inverse = _powers(int(hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix64(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def hashed_words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, and each row's first index into them (with one more at the end)."""
    raw, off = string_buffers(arr)
    starts, ends, rows = word_bounds(raw, off)
    return hash_spans(raw, starts, ends), rows


def gram_hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """At each i, a hash of h[i + o] for o in offsets; as many as there are whole windows."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        total += h[o : o + n] * np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64) | 1)
    return mix64(total)
