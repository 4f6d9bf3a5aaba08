"""Corpus-wide counts of n-grams: chunks of text ask, ranges of hashes answer.

A chunk is a few MB of text, kept as word ids of its own. It sends the hashes
and counts of its distinct n-grams, one packed cell for each range of hashes.
A range merges the cells of all chunks. A word that is everywhere has one entry
a chunk, so that no range is hot, and no table of all n-grams is ever needed
in one place. The ranges are as many as keep one at ``RANGE`` entries or so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cadenza.llm.arrowtext import give_back, mix, text_bytes

#: Bytes of text of a chunk, and n-grams that a range has of all chunks together. Cells are chunks times ranges: raise both with the square root of the corpus.
CHUNK, RANGE = 4 << 20, 1_000_000
#: Bits of the hash of one word, and of more than one.
WORD_BITS, GRAM_BITS = 64, 53
#: Values whose bits are packed at once, a multiple of eight.
BLOCK = 1 << 14
_FACTORS = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)

CELL = "range long, chunk long, hashes binary, n binary"


def squeeze(values: np.ndarray) -> bytes:
    """Integers from 0 as compressed byte planes, as many as the largest needs."""
    v = np.ascontiguousarray(values).astype("<u8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    out = np.zeros((len(body) // blob[0], 8), np.uint8)
    out[:, : blob[0]] = body.reshape(blob[0], -1).T
    return out.view("<u8").ravel().astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Distinct sorted 64-bit values, at least one: the first, then differences in as few bits as the largest needs."""
    d = np.diff(values.astype("<u8"))
    width = max(1, int(d.max(initial=0)).bit_length())
    body = [np.packbits(np.unpackbits(d[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width], bitorder="little") for k in range(0, len(d), BLOCK)]
    return bytes([width]) + len(d).to_bytes(4, "little") + values[:1].astype("<u8").tobytes() + b"".join(x.tobytes() for x in body)


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    body, out = np.frombuffer(blob, np.uint8, offset=13), np.empty(n + 1, "<u8")
    out[0] = int.from_bytes(blob[5:13], "little")
    for k in range(0, n, BLOCK):
        rows = min(BLOCK, n - k)
        bits = np.zeros((rows, 64), np.uint8)
        bits[:, :width] = np.unpackbits(body[k * width // 8 :], count=rows * width, bitorder="little").reshape(rows, width)
        out[k + 1 : k + 1 + rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64)


def gram_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that end at these places; words: their hashes, one after the other."""
    if k == 1:
        return words[ends]
    total = np.full(len(ends), _FACTORS[-k], np.uint64)
    for j in range(k):
        total += words[ends - j] * _FACTORS[j]
    return mix(total) >> np.uint64(64 - GRAM_BITS)


def parts(column: pa.Array, separator: np.ndarray, bounds: Callable, most: int, carry: int) -> Iterator[tuple]:
    """The column's rows by groups of at most so many bytes: first row, end row, bytes, start, end, row of each word, words carried, whether the last row ends here.

    A longer row comes in several parts, cut behind separators (a table by
    byte); from the second on, a part starts with the ``carry`` words before it.
    ``bounds`` finds words in bytes and offsets.
    """
    data, o = text_bytes(column)
    at, rows = 0, len(o) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
        if to > at + 1 or o[to] - o[at] <= most:
            body = data[o[at] : o[to]]
            yield at, to, body, *bounds(body, o[at : to + 1] - o[at]), 0, True
            at = to
            continue
        lo, done, hi, carried = int(o[at]), int(o[at]), int(o[to]), 0
        while True:
            cut = min(hi, max(lo, done) + most)
            if cut < hi:
                own = np.flatnonzero(separator[data[done:cut]])
                if len(own):
                    cut = done + int(own[-1]) + 1
                else:
                    step = next((c for c in range(cut, hi, most) if separator[data[c : c + most]].any()), None)
                    cut = hi if step is None else step + int(np.argmax(separator[data[step : step + most]])) + 1
            body = data[lo:cut]
            start, end, row = bounds(body, np.array([0, len(body)]))
            yield at, to, body, start, end, row, carried, cut == hi
            if cut == hi:
                break
            carried = min(carry, len(start))
            lo, done = lo + int(start[-carried]) if carried else cut, cut
        at = to


def ask(chunk: int, grams: list[tuple[int, np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """The cells of a chunk; grams: order, sorted distinct hashes, counts."""
    keys, hashes, counts = [], [], []
    for order, h, n in grams:
        if not len(h):
            continue
        top = h >> np.uint64((WORD_BITS if order == 1 else GRAM_BITS) - 32)
        of = (top * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
            keys.append((order << 32) + int(of[lo]))
            hashes.append(pack(h[lo:hi]))
            counts.append(squeeze(n[lo:hi]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([chunk] * len(keys), pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["range", "chunk", "hashes", "n"])


def answer(cells: DataFrame, reply: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """What ``reply`` says to each cell, given the order, the cell's counts, the corpus's counts and whether the cell is the first with that n-gram. It gives a dict of the schema's columns but range and chunk."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        own = [unpack(b) for b in table.column("hashes").to_pylist()]
        counts = [unsqueeze(b) for b in table.column("n").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        h, n = np.concatenate(own), np.concatenate(counts)
        del own
        by = np.argsort(h, kind="stable")
        new = np.concatenate([[True], np.diff(h[by]) != 0])
        starts = np.flatnonzero(new)
        total, first = np.empty(len(h), np.int64), np.zeros(len(h), bool)
        total[by] = np.add.reduceat(n[by], starts)[np.cumsum(new) - 1]
        first[by[starts]] = True
        key = table.column("range")[0].as_py()
        out = [
            {"range": key, "chunk": c} | reply(key >> 32, n[lo:hi], total[lo:hi], first[lo:hi])
            for c, lo, hi in zip(table.column("chunk").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
        ]
        del h, n, by, new, total, first
        give_back()
        return pa.Table.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = "range long, chunk long, " + schema
    arrow = to_arrow_schema(StructType.fromDDL(full))
    return cells.groupBy("range").applyInArrow(merge, full)
