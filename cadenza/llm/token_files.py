"""Token ids in a bit-plane shuffled binary format.

A shard holds the ids of a range of documents in order. Its ids are cut into
blocks of a fixed number; a block's 32-bit ids are transposed into four byte
planes, and each plane is compressed by itself, so that the high bytes, which
are nearly all zero, take next to no room. The chunk index beside the planes
says for each block where its ids stand in the shard, which documents they
belong to, and whether its last document goes on in the next block. Blocks are rows of Parquet files, so Spark writes and reads them
on any store.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import LOWER, slices, take_strings, text_bytes, word_bounds
from cadenza.plans.scratch import Scratch

BLOCK = 1 << 16
END = 2
#: Words whose ids a Python worker remembers, and the bytes they may have, about.
REMEMBER, REMEMBER_BYTES = 400_000, 32 << 20
#: Bytes of text that are encoded at once.
AT_ONCE = 8 << 20
#: Words of these letters alone are one unit of the pre-tokenizer and are not changed by the normalizer, once in lower case.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+\Z")
_MADE: dict[int, tuple] = {}


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, word by word.

    Such a tokenizer never joins what white space parts, so a text's ids are
    those of its words in order. A batch's distinct words are encoded once.
    A sentence mark after an ASCII letter is a unit of its own for the
    pre-tokenizer, so it is parted too, which leaves fewer distinct words.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.symbols = dict(enumerate(_byte_symbols()))
        self.forget()

    def forget(self) -> None:
        """Known words in the order of their numbers; the ids of all of them end to end, and where each one's end. The end of a text is the word 0."""
        self.known = pa.array([""], pa.string())
        self.ids, self.ends = array("I", [END]), array("i", [0, 1])

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet and numbers them in order."""
        lower = [w.lower() for w in words]
        plain = [PLAIN.match(x) is not None for x in lower]
        odd = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        tokenize, add, end = self.tokenizer.model.tokenize, self.ids.extend, self.ends.append
        for low, p in zip(lower, plain, strict=True):
            if p:
                add([t.id for t in tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.symbols))])
            else:
                add(next(odd).ids)
            end(len(self.ids))
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        data, offsets = text_bytes(texts)
        start, end, row = word_bounds(data, offsets)
        if len(data):
            letter = (LOWER[data] >= 97) & (LOWER[data] <= 122)
            mark = (data == 46) | (data == 44)
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = letter[:-1] & mark[1:]
            cut[start] = False
            cut[end] = False
            cut[offsets] = False
            extra = np.flatnonzero(cut)
            start, end = np.sort(np.concatenate([start, extra])), np.sort(np.concatenate([end, extra]))
            row = np.searchsorted(offsets, start, "right") - 1
        words = take_strings(data, start, end).dictionary_encode()
        if len(self.known) > REMEMBER or self.known.nbytes > REMEMBER_BYTES:
            self.forget()
        number = np.asarray(pc.index_in(words.dictionary, value_set=self.known).fill_null(-1)).copy()
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self.learn(words.dictionary.take(pa.array(new)).to_pylist())
        # Every text's words and the end after them, as lists of ids.
        last = np.searchsorted(row, np.arange(len(texts)), "right")
        said = np.insert(number[np.asarray(words.indices)], last, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.array(self.ends, np.int32)), pa.array(np.array(self.ids, np.uint32))).take(pa.array(said))
        ends = np.asarray(lists.offsets).astype(np.int64)[1:][last + np.arange(len(texts))]
        return np.asarray(lists.values), np.diff(ends, prepend=0)


def planes(ids: np.ndarray) -> list[bytes]:
    """A block's ids as four compressed byte planes, the lowest first."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in parts]


def ids_of(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of n from its planes."""
    unpack = zstandard.ZstdDecompressor()
    return np.stack([np.frombuffer(unpack.decompress(p, max_output_size=n), np.uint8) for p in parts], 1).copy().view("<u4").ravel() if n else np.zeros(0, np.uint32)


_CHUNK = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("goes_on", pa.bool_()), ("planes", pa.list_(pa.binary()))])
CHUNK_TYPE = "shard long, chunk long, first long, n_ids long, docs array<long>, lengths array<long>, goes_on boolean, planes array<binary>"


def write(docs: DataFrame, spec: str, path: str, block: int = BLOCK, shards: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the shards under path, documents in ascending doc_id over the shards.

    spec is the tokenizers library's JSON. Null and empty texts have the end
    id alone; a null doc_id comes first; rows with the same doc_id stand in
    order of their text. The documents are range-sorted once, as texts;
    encoding streams over the sorted rows and keeps one block in memory.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(spec)
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(shared.value)
        if key not in _MADE:
            _MADE[key] = WordEncoder(shared.value)
        encoder, shard = _MADE[key], TaskContext.get().partitionId()
        chunk = first = 0
        waiting: list[np.ndarray] = []
        doc, length = [], []
        held = 0

        def out(ids: np.ndarray, d: list, n: list, goes_on: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "docs": d, "lengths": n, "goes_on": goes_on, "planes": planes(ids)}], _CHUNK)

        for batch in slices(batches, most=AT_ONCE):
            ids, n = encoder.encode(batch.column(1))
            waiting.append(ids)
            doc += batch.column(0).to_pylist()
            length += n.tolist()
            held += len(ids)
            if held < block:
                continue
            flat, at = np.concatenate(waiting), 0
            k = used = 0
            while held - at >= block:
                d, m, room = [], [], block
                while room:
                    part = min(room, length[k] - used)
                    d.append(doc[k])
                    m.append(part)
                    room -= part
                    used += part
                    if used == length[k]:
                        k, used = k + 1, 0
                yield out(flat[at : at + block], d, m, used > 0)
                chunk, first, at = chunk + 1, first + block, at + block
            doc, length = doc[k:], length[k:]
            if used:
                length[0] -= used
            waiting, held = [flat[at:]], held - at
        if held:
            yield out(np.concatenate(waiting), doc, length, False)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, CHUNK_TYPE).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32 of every document, start counted over all shards.

    A shard's chunks are sorted and streamed; a document that goes on over
    chunks is carried as a length and a running checksum. A document that
    occurs in several rows is several rows here.
    """
    chunks = spark.read.schema(CHUNK_TYPE).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        n = crc = start = 0
        for batch in batches:
            rows: list[tuple] = []
            for c in batch.to_pylist():
                ids = ids_of(c["planes"], c["n_ids"])
                if c["shard"] != shard:
                    shard, n, crc, start = c["shard"], 0, 0, 0
                at = 0
                for k, (doc, m) in enumerate(zip(c["docs"], c["lengths"], strict=True)):
                    part = ids[at : at + m]
                    at += m
                    n, crc = n + m, zlib.crc32(part.astype("<u4").tobytes(), crc)
                    if k + 1 < len(c["docs"]) or not c["goes_on"]:
                        rows.append((shard, doc, start, n, crc))
                        start, n, crc = start + n, 0, 0
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = chunks.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, read back from them."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = Scratch(spark, "token-files").path
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec, path)
    return read(spark, path)
