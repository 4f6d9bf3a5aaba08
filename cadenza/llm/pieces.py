"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch are laid end to end and their suffixes
sorted by as many characters as the longest piece has. A binary search of
every piece finds the range of suffixes that begin with it; these are the
edges of all segments' lattices. Sorted by where they end, the edges are
relaxed: each place keeps the last piece of the best encoding up to it. A
segment is cut where no piece crosses a place, so that text without spaces has
many short stretches, which are relaxed side by side.

The model is of the merging kind, where the best encoding is the one its
merges end in. An encoding is that one if and only if each two neighbours in
it are what their own concatenation is merged to, and every place has exactly
one last piece with that property; so an edge is taken if its piece and the
last piece at its start are such neighbours.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import slices, text_bytes

SPACE = "▁"
#: Segments that a Python worker remembers, and the bytes they may have, about; of pairs of neighbours four times as many.
REMEMBER, REMEMBER_BYTES = 400_000, 32 << 20
#: Characters of segments in one suffix array, about; a longer segment has one of its own.
AT_ONCE = 1 << 18
_MADE: dict[int, Codec] = {}


def load(path: str) -> dict:
    """What encoding needs of a model file: pieces, scores, which pieces are bytes, which are never text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return {
        "pieces": [sp.id_to_piece(i) for i in range(n)],
        "scores": [sp.get_score(i) for i in range(n)],
        "bytes": [i for i in range(n) if sp.is_byte(i)],
        "never": [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)],
    }


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        pieces, apart = model["pieces"], {*model["bytes"], *model["never"]}
        self.score = model["scores"]
        self.text = pieces
        self.id = {p: i for i, p in enumerate(pieces) if i not in apart}
        self.byte = {int(pieces[i][3:5], 16): i for i in model["bytes"]}
        ids = sorted(self.id.values())
        letters = sorted({c for p in self.id for c in p})
        self.longest = max(map(len, self.id))
        #: Symbols from 1 by code point; 0 is any character that no piece has, and the end of a segment.
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # A piece as big-endian symbols, so that byte order is symbol order; its last possible extension besides.
        rows = [self.symbol[[ord(c) for c in pieces[i]]].astype(">u2").tobytes() for i in ids]
        width = 2 * self.longest
        self.width = width
        order = np.argsort(np.array(rows, f"S{width}"), kind="stable")
        self.piece_id = np.array(ids)[order]
        self.piece_len = np.array([len(pieces[i]) for i in ids])[order]
        self.piece_low = np.array(rows, f"S{width}")[order]
        self.piece_high = np.array([r + b"\xff" * (width - len(r)) for r in rows], f"S{width}")[order]
        self.forget()
        # Pairs of neighbours that have been tried, sorted, and whether they fit.
        self.tried, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.whole = {i: self.merge(pieces[i]) == [i] for i in ids}
        out = [SPACE.join(p.split(SPACE)).replace(SPACE, " ").encode() for p in pieces]
        for b, i in self.byte.items():
            out[i] = bytes([b])
        for i in model["never"]:
            out[i] = b""
        self.out_len = np.array([len(x) for x in out])
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def merge(self, text: str) -> list[int]:
        """The model's merges carried out on a short text of known characters: the best-scored pair first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(self.score[self.id[p]], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.id]
            if not pairs:
                break
            k = -max(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.id[p] for p in parts]

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces stay as they are when their concatenation is merged; left -1 fits all whole pieces."""
        key, inverse = np.unique(left.astype(np.int64) * (1 << 20) + right, return_inverse=True)
        if len(self.tried) > 4 * REMEMBER:
            self.tried, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.searchsorted(self.tried, key)
        new = np.flatnonzero(~np.isin(key, self.tried, assume_unique=True) if len(self.tried) else np.ones(len(key), bool))
        if len(new):
            ok = []
            for x in key[new].tolist():
                a, b = divmod(x, 1 << 20)
                ok.append(self.whole[b] if a < 0 else self.whole[b] and self.merge(self.text[a] + self.text[b]) == [a, b])
            self.tried, self.fits = np.insert(self.tried, at[new], key[new]), np.insert(self.fits, at[new], ok)
            at = np.searchsorted(self.tried, key)
        return self.fits[at[inverse]]

    def forget(self) -> None:
        """Known segments in the order of their numbers; the ids of all of them end to end, and where each one's end."""
        self.known = pa.array([], pa.string())
        self.ids, self.ends = array("H"), array("i", [0])

    def segments(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each segment."""
        joined = "".join(w + "\0" for w in words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        sym = self.symbol[code]
        sym[begin + size] = 0
        padded = np.zeros(len(sym) + self.longest, ">u2")
        padded[: len(sym)] = sym
        inside = np.flatnonzero(sym)
        if len(inside):
            # Suffixes, cut to the longest piece, as four words of four symbols and more; sorting the words sorts the suffixes.
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[inside])
            suffix = windows.view(f"S{self.width}").ravel()
            by = np.argsort(suffix, kind="stable")
            ordered, place = suffix[by], inside[by]
            lo = np.searchsorted(ordered, self.piece_low, "left")
            hi = np.searchsorted(ordered, self.piece_high, "right")
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            at = place[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(which))]
            edge_id, edge_end = self.piece_id[which], at + self.piece_len[which]
        else:
            at = edge_id = edge_end = np.zeros(0, np.int64)
        # Characters of no piece are edges of their own, with which everything fits.
        odd = np.ones(len(code), bool)
        odd[inside] = False
        odd[begin + size] = False
        odd = np.flatnonzero(odd)
        at, edge_end = np.concatenate([at, odd]), np.concatenate([edge_end, odd + 1])
        edge_id = np.concatenate([edge_id, np.full(len(odd), -1)])

        # Merges never cross a place inside of no piece, so the stretches between such places are encoded by themselves.
        crossed = np.cumsum(np.bincount(at + 1, minlength=len(code) + 2) - np.bincount(edge_end, minlength=len(code) + 2))[: len(code)] > 0
        crossed[begin] = False
        of = np.maximum.accumulate(np.where(crossed, 0, np.arange(len(code))))
        far = edge_end - of[at]
        by = np.lexsort((at, far))
        at, edge_end, edge_id, far = at[by], edge_end[by], edge_id[by], far[by]
        last = np.full(len(code) + 1, -2)  # -2: not reached; -1: the start, or a character of no piece
        start = np.full(len(code) + 1, -1, np.int64)
        last[:-1][~crossed] = -1  # for the edges from there; the stretch before puts its last piece in its place
        cut = np.searchsorted(far, np.arange(1, (int(far[-1]) if len(far) else 0) + 2))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s, e, i = at[lo:hi], edge_end[lo:hi], edge_id[lo:hi]
            # A place whose last piece is -1 and that is a segment's end can't occur here: ends are reached, not left.
            reached = last[s] != -2
            s, e, i = s[reached], e[reached], i[reached]
            ok = i == -1
            ok[~ok] = self.neighbours(last[s[~ok]], i[~ok])
            last[e[ok]] = i[ok]
            start[e[ok]] = s[ok]
        # Back along the last pieces, all segments at once.
        now = begin + size
        live = np.flatnonzero(size > 0)
        rows, ends, ids = [], [], []
        while len(live):
            p = now[live]
            if (start[p] < 0).any():
                raise ValueError("a segment has no encoding")
            rows.append(live)
            ends.append(p)
            ids.append(last[p])
            now[live] = start[p]
            live = live[now[live] > begin[live]]
        if not rows:
            return [np.zeros(0, np.uint16) for _ in words]
        row, end, ids = np.concatenate(rows), np.concatenate(ends), np.concatenate(ids)
        by = np.argsort(end, kind="stable")
        row, end, ids = row[by], end[by], ids[by]
        if (ids == -1).any():
            fall = [[self.byte[b] for b in chr(c).encode()] for c in code[end[ids == -1] - 1].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[ids == -1] = [len(x) for x in fall]
            first = np.cumsum(wide) - wide
            out = np.empty(int(wide.sum()), np.int64)
            out[first[ids != -1]] = ids[ids != -1]
            put = first[ids == -1]
            for p, x in zip(put.tolist(), fall, strict=True):
                out[p : p + len(x)] = x
            row, ids = np.repeat(row, wide), out
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        ids = ids.astype(np.uint16)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has. A text gets one space before it, as the model's normaliser adds."""
        data, offsets = text_bytes(texts)
        rows = len(texts)
        full = np.diff(offsets) > 0
        lead = np.cumsum(full)
        spaced = np.full(len(data) + int(full.sum()), 32, np.uint8)
        own = np.arange(len(data)) + np.repeat(lead, np.diff(offsets))
        spaced[own] = data
        offsets = offsets + np.concatenate([[0], lead])
        data = spaced
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64)
        # No piece has a space, or the character that stands for one, after another character, or a line break: a text is cut there.
        space, line = data == 32, data == 10
        spacing = space.copy()
        spacing[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
        cut = np.ones(len(data), bool)
        cut[1:] = (space[1:] & ~spacing[:-1]) | line[1:] | line[:-1]
        cut[offsets[:-1][full]] = True
        begin = np.flatnonzero(cut)
        mark = np.searchsorted(offsets, begin, "right") - 1
        o = np.append(begin, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(o), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > REMEMBER or self.known.nbytes > REMEMBER_BYTES:
            self.forget()
        number = np.asarray(pc.index_in(words.dictionary, value_set=self.known).fill_null(-1)).copy()
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            names = words.dictionary.take(pa.array(new)).to_pylist()
            part = np.cumsum([len(w) for w in names]) // AT_ONCE
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(names)]):
                for ids in self.segments([w.replace(" ", SPACE) for w in names[lo:hi]]):
                    self.ids.frombytes(ids.tobytes())
                    self.ends.append(len(self.ids))
            self.known = pa.concat_arrays([self.known, pa.array(names, pa.string())])
        of = number[np.asarray(words.indices)]
        ends = np.array(self.ends, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(self.ids, np.uint16))).take(pa.array(of))
        return np.asarray(lists.values), np.bincount(mark, weights=np.diff(ends)[of], minlength=rows).astype(np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts of the ids, n to each: the pieces' bytes in a row, without the space before the first."""
        each = self.out_len[ids]
        data = self.out[np.repeat(self.out_at[ids] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        total = np.concatenate([[0], np.cumsum(each)])
        offsets = total[np.concatenate([[0], np.cumsum(n)])]
        has = (np.diff(offsets) > 0) & (data[np.minimum(offsets[:-1], max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(n), bool)
        keep = np.ones(len(data), bool)
        keep[offsets[:-1][has]] = False
        offsets = offsets - np.concatenate([[0], np.cumsum(has)])
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep])))


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast model."""
    key = shared._path if shared._path else id(shared)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Codec(shared.value)
    return _MADE[key]


def encode(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs but text, and ids array<int>. Null and empty texts have no ids; every text is encoded whole. A column ids gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in slices(batches):
            ids, n = codec.encode(batch.column(len(kept)))
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], [*kept, "ids"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, ", ".join([*kinds, "ids array<int>"]))


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """All columns but ids, and text: the inverse of encode, with null and empty texts as empty ones. Null ids have a null text. A column text gives way."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in encoded.columns if c not in ("text", "ids")]
    kinds = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column(len(kept))
                n = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                text = codec.decode(np.asarray(column.flatten()).astype(np.int64), n)
                if column.null_count:
                    text = pa.array([t if x else None for x, t in zip(column.is_valid().to_pylist(), text.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], text], [*kept, "text"])

    return encoded.select(*[F.col(f"`{c}`") for c in kept], "ids").mapInArrow(run, ", ".join([*kinds, "text string"]))


def crc_of_ids(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32: the checksum of the ids as little-endian unsigned 32-bit integers, and the other columns."""
    kept = [c for c in encoded.columns if c != "ids"]
    kinds = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            n = np.asarray(column.value_lengths()).astype(np.int64)
            flat, at = np.asarray(column.flatten()).astype("<u4"), np.concatenate([[0], np.cumsum(n)])
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n), pa.array(crc, pa.int64())], [*kept, "n_pieces", "ids_crc32"])

    return encoded.select(*kept, "ids").mapInArrow(run, ", ".join([*kinds, "n_pieces long, ids_crc32 long"]))


def piece_model() -> dict:
    """The public piece model of this environment; its path is the only thing fixed here."""
    import public_tokenizers

    return load(public_tokenizers.path("piece_bpe_32k.model"))


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, checksum of ids, and whether decoding gives the text back."""
    model = piece_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))), model)
    back = decode(encoded.withColumn("kept_ids", F.col("ids")), model)
    back = back.withColumn("round_trip", F.xxhash64("text") == F.col("text_hash")).drop("text", "text_hash").withColumnRenamed("kept_ids", "ids")
    return crc_of_ids(back).select("doc_id", "n_pieces", "ids_crc32", "round_trip")
