"""Importance resampling towards a target text distribution.

Features are runs of words, hashed to buckets. A bucket's gain is the log
ratio of its smoothed frequency in the target and in the corpus; a document's
weight is its mean gain. Gumbel noise turns the k highest scores into a draw
without replacement. The k-th key is found digit by digit from histograms, so
that only rows that are drawn are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import LOWER, give_back, word_bounds
from cadenza.llm.ngram_counts import parts
from cadenza.plans.scratch import Scratch

BUCKETS = 10_000
#: Bytes of text that are hashed at once.
AT_ONCE = 4 << 20
#: Everything in ASCII but digits and letters, as a table by byte.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of a feature that are hashed together with others; longer ones are hashed alone.
TOGETHER = 64
DIGIT = 16
LOWEST = -(1 << 63)

_bounds = partial(word_bounds, separator=SEPARATOR)


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> 1), x >> 1)
    return x.astype(np.uint32)


_TABLE = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch of the bytes."""
    n = end - start
    by = np.argsort(-n, kind="stable")
    at, n = start[by], n[by]
    c = np.full(len(n), 0xFFFFFFFF, np.uint32)
    together = int(np.searchsorted(-n, -TOGETHER))
    for j in range(int(n[together]) if together < len(n) else 0):
        m = slice(together, int(np.searchsorted(-n, -j)))
        c[m] = _TABLE[(c[m] ^ data[at[m] + j]) & 255] ^ (c[m] >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for k in range(together):
        c[k] = zlib.crc32(data[at[k] : at[k] + n[k]].tobytes())
    out = np.empty(len(n), np.uint32)
    out[by] = c
    return out


def _features(column: pa.Array, most: int, buckets: int) -> Iterator[tuple]:
    """First row, end row, whether the last row ends here, words by row, and bucket and row of each feature."""
    for lo, hi, data, start, end, row, carried, last in parts(column, SEPARATOR, _bounds, AT_ONCE, most - 1):
        data = LOWER[data]
        if most > 1:
            n = end - start
            to = np.cumsum(n + 1)
            inside = np.ones(int(to[-1]) if len(to) else 0, bool)
            inside[to - 1] = False
            joined = np.full(len(inside), 32, np.uint8)
            joined[inside] = data[~SEPARATOR[data]]
            data, start, end = joined, to - n - 1, to - 1
        found, of = [], []
        own = np.arange(len(start))
        own = own[own >= carried]
        for k in range(most):
            at = own[(own >= k) & (row[own] == row[np.maximum(own - k, 0)])]
            found.append(crc32(data, start[at - k], end[at]) % np.uint32(buckets))
            of.append(row[at])
        words = np.bincount(row[own], minlength=hi - lo) if len(own) else np.zeros(hi - lo, np.int64)
        yield lo, hi, last, words, np.concatenate(found).astype(np.int64), np.concatenate(of)


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features fall into each bucket; buckets without one have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found, _ in _features(batch.column(0), most, buckets):
                total += np.bincount(found, minlength=buckets)
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's frequency in the target to that in the corpus, rounded down; both are tables of ``bucket_counts``, so of as many rows as buckets at most."""
    s, t = ([0] * buckets for _ in range(2))
    for into, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    every_s, every_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * every_s / (float(a + 1) * every_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a row's features, rounded down; 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for lo, hi, _, words, found, of in _features(batch.column(1), most, len(shared.value)):
                sums[0, lo:hi] += words
                np.add.at(sums[1], lo + of, 1)
                np.add.at(sums[2], lo + of, shared.value[found])
            weight = sums[2] // np.maximum(sums[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def up_to_kth(rows: DataFrame, key: list[str], k: int) -> Column:
    """The condition that holds for the k rows with the smallest keys, k from 1 to the number of rows; the long columns of the key come by importance and tell all rows apart.

    Radix selection: of each column the bits that differ between rows are cut
    into digits of 16 bits. A histogram of the next digit among the rows that
    still may be the k-th, 65,536 rows at most, fixes that digit; it ends as
    soon as all of them are wanted.
    """
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in key for f in (F.min, F.max)]).first()
    same, below = F.lit(True), F.lit(False)
    for c in key:
        lo, hi = ends[f"min_{c}"], ends[f"max_{c}"]
        bits = (lo ^ hi).bit_length() if (lo < 0) == (hi < 0) else 64
        flat = F.col(c).bitwiseXOR(F.lit(LOWEST))
        prefix = ((lo ^ LOWEST) & ((1 << 64) - 1)) >> bits
        while bits:
            step = min(DIGIT, bits)
            known, bits = F.shiftrightunsigned(flat, bits) == _signed(prefix) if bits < 64 else F.lit(True), bits - step
            digit = F.shiftrightunsigned(flat, bits).bitwiseAND(F.lit((1 << step) - 1))
            counts = sorted((r["digit"], r["n"]) for r in rows.where(same & known).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            at = 0
            while counts[at][1] < k:
                k -= counts[at][1]
                at += 1
            prefix = (prefix << step) | counts[at][0]
            if counts[at][1] == k:  # all of them are wanted
                last = _signed((((prefix + 1) << bits) - 1) ^ (1 << 63))
                return below | (same & (F.col(c) <= last))
        value = _signed(prefix ^ (1 << 63))
        below = below | (same & (F.col(c) < value))
        same = same & (F.col(c) == value)
    return below | same


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, id: str = "doc_id", text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for rows that are not drawn.

    ``id`` is of an integer type. ``most``: words of a feature. Null and empty
    texts have no words and weight 0. A row without id has no score and isn't
    drawn nor counted. Repeated rows count each; those with equal score, id and
    n_features cannot be told apart in the result. Empty tables: no rows, or a
    target without features. Only id and text are read; other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, text, most, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    key = ["score_down", "id_key", "n_features", "place"]
    scored = scratch.save(
        weigh(docs, gain, id, text, most)
        .withColumn("score", (F.col("weight") + noise).cast("long"))
        .withColumns({"score_down": F.bitwise_not("score"), "id_key": F.col("doc_id").cast("long"), "place": F.monotonically_increasing_id()})
    )
    may = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    k = may.count() * percent // 100
    every = scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not k:
        return every
    drawn = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & up_to_kth(may, key, k)
    drawn = F.coalesce(drawn, F.lit(False))
    order = scored.where(drawn).repartitionByRange(*key).sortWithinPartitions(*key)
    placed = scratch.save(order.select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")))
    block = F.shiftright("at", 33)
    sizes = sorted((r["block"], r["n"]) for r in placed.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = docs.sparkSession.createDataFrame([(b, s) for (b, _), s in zip(sizes, before, strict=False)], "block long, before long")
    ranked = placed.withColumn("block", block).join(F.broadcast(starts), "block")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(every.columns[:4]).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of documents drawn towards benchmark, all rows weighted; nulls, ties, repeats: see ``resample``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH steps AS (SELECT i, list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS x FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(x ORDER BY i) AS t FROM steps),
cut AS (SELECT doc_id, TRUE AS corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, FALSE, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT doc_id, corpus, w, count(*) AS n FROM (SELECT doc_id, corpus, unnest(w) AS w FROM cut) GROUP BY doc_id, corpus, w),
crc AS (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda k: CAST('0x' || substr(hex(encode(w)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), tab),
counts AS (SELECT bucket, sum(n) FILTER (corpus) AS s, sum(n) FILTER (NOT corpus) AS t FROM words JOIN crc USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counts) + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM counts) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM counts),
own AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM words JOIN crc USING (w) JOIN gain USING (bucket) WHERE corpus GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN own USING (doc_id)),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM placed
"""
