"""Whole Arrow batches of text as NumPy arrays.

Python tasks see a batch of texts as one byte buffer with offsets and work on
all of its words at once. ``slices`` cuts a batch so that the arrays derived
from the text, several times its size, stay small.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Space and the controls 9 to 13, as a table by byte.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII lower case, as a table by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and, for row i, where it starts and ends in them: offsets[i], offsets[i + 1]. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return d, o - (o[0] if len(o) else 0)


def give_back() -> None:
    """Returns freed memory to the machine: Python workers wait idle between stages, and beside them other work goes on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column has at most so many bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, o = text_bytes(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a maximal run of bytes that are not separators (a table by byte)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def take_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The stretches of the bytes as an Arrow array; they must be in order and apart."""
    n = end - start
    o = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=o[1:])
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    body = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(body)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose sums are taken at once; the powers that a worker keeps are of so many.
AT_ONCE = 1 << 18


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of the bytes, by content alone; the stretches must be in order."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        lo = int(start[k])
        to = max(k + 1, int(np.searchsorted(end, lo + AT_ONCE, "right")))
        body, s, e = data[lo : int(end[to - 1])], start[k:to] - lo, end[k:to] - lo
        up, down = powers(len(body))
        total = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], dtype=np.uint64, out=total[1:])
        out[k:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = to
    return out
