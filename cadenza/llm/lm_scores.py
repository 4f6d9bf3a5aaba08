"""Scores of a language model with deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of
falling order, P(w|u v) = a f(w|u v) + (1-a) (b f(w|v) + (1-b) f(w)), whose
weights a and b depend on the bucket of how often the context was seen, by
powers of two. f(w) is the base estimate, which knows unseen words.

Expectation maximisation learns the weights on held-out counts: every training
document is scored with the counts that all others leave. Its data are the
numbers of tokens by bucket and by the ratios of the estimates, in half octaves:
a grid of fixed size whatever the corpus, so that the rounds need no pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import LOWER, SEPARATOR, give_back, mix, stretch_hashes, word_bounds
from cadenza.llm.ngram_counts import CELL, CHUNK, RANGE, answer, ask, gram_hashes, parts, squeeze, unsqueeze
from cadenza.plans.scratch import Scratch

START, END = mix(np.array([1, 2], np.uint64))
ADDED = 0.1
BUCKETS = 16
#: Half octaves of a ratio of two estimates; 0 is a ratio of 0, NONE one of 1.
LEVELS, NONE = 128, 41
CELLS = BUCKETS * BUCKETS * LEVELS * LEVELS


def _chunks(docs: DataFrame, most: int) -> DataFrame:
    """Chunks of ``docs`` (id, held, text): local word ids in the order of their frequency, and their hashes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, rows = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, start, end, row, carried, last in parts(batch.column(2), SEPARATOR, word_bounds, most, 2):
                h = stretch_hashes(LOWER[data], start, end)
                words, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
                by = np.argsort(-count, kind="stable")
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by))
                of = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([base + n], pa.int64()), "row": pa.array([base + rows], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                    "held": [np.packbits(held[lo:hi].astype(bool)).tobytes()], "n": [squeeze(of)], "carried": pa.array([carried], pa.int32()), "ends": [last],
                    "words": [words[by].tobytes()], "tokens": [squeeze(rank[inverse])], "trained": pa.array([int(of[~held[lo:hi].astype(bool)].sum()) + int(last) * int((~held[lo:hi].astype(bool)).sum()) - (carried if not held[lo] else 0)], pa.int64()),
                    "documents": pa.array([int(last) * int((~held[lo:hi].astype(bool)).sum())], pa.int64()),
                })
                n, rows = n + 1, rows + (hi - lo) * int(last)
            give_back()

    return docs.mapInArrow(run, f"chunk long, row long, ids array<{kind}>, held binary, n binary, carried int, ends boolean, words binary, tokens binary, trained long, documents long")


class _Chunk:
    """The tokens of a chunk with two starts before and an end behind each text, and the distinct n-grams of each order."""

    def __init__(self, c: dict, order: int):
        self.c, self.order = c, order
        n, words, tokens = unsqueeze(c["n"]), np.frombuffer(c["words"], np.uint64), unsqueeze(c["tokens"])
        self.rows = len(n)
        self.held = np.unpackbits(np.frombuffer(c["held"], np.uint8), count=len(n)).astype(bool)
        size = n + 2 + int(c["ends"])
        first = np.cumsum(size) - size
        self.hash = np.full(int(size.sum()), END, np.uint64)
        own = np.ones(len(self.hash), bool)
        own[first] = own[first + 1] = False
        if c["ends"]:
            own[first + size - 1] = False
        self.hash[own] = words[tokens]
        self.hash[first] = self.hash[first + 1] = START
        real = np.ones(len(self.hash), bool)
        real[first] = real[first + 1] = False
        #: Places of tokens; those from ``carried`` on are the chunk's own.
        self.at = np.flatnonzero(real)
        self.row = np.repeat(np.arange(self.rows), size)[self.at]
        self.own = np.arange(len(self.at)) >= c["carried"]
        self.train = self.own & ~self.held[self.row]
        #: Whether one or two places before a token there is a word.
        self.back = [self.at - first[self.row] - 2 >= j for j in range(order)]
        self.grams, self.index = [], []
        for k in range(1, order + 1):
            h, index = np.unique(gram_hashes(self.hash, self.at, k), return_inverse=True)
            self.index.append(index)
            self.grams.append((k, h, np.bincount(index, self.train, len(h)).astype(np.int64)))

    def by_token(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """Counts of the distinct n-grams as counts at each token."""
        return [v[at] for v, at in zip(counts, self.index, strict=True)]

    def contexts(self, counts: list[np.ndarray], starts: np.ndarray | int) -> list[np.ndarray]:
        """How often the context of order 2, 3, ... was seen at each token; counts: at each token, of the n-gram of order 1, 2, ... that ends there."""
        return [np.where(self.back[1], np.concatenate([[0], counts[k - 1][:-1]]), starts) for k in range(1, self.order)]

    def estimates(self, counts: list[np.ndarray], contexts: list[np.ndarray], all_tokens, distinct: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The base estimate of each token and the others as ratios to it."""
        base = (counts[0] + ADDED) / (all_tokens + ADDED * (distinct + 1))
        return base, [np.divide(counts[k], contexts[k - 1], out=np.zeros(len(base)), where=contexts[k - 1] > 0) / base for k in range(1, self.order)]

    def left(self, counts: list[np.ndarray], starts: int, all_tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of training tokens by the counts that other documents leave, and how many are in each."""
        rest = []
        for k in range(self.order):
            _, index, n = np.unique(self.row * len(self.grams[k][1]) + self.index[k], return_inverse=True, return_counts=True)
            own = np.bincount(index, self.train, len(n)).astype(np.int64)
            rest.append(counts[k] - own[index])
        size = np.bincount(self.row, self.train, self.rows)[self.row]
        seen = self.contexts(rest, starts - 1)
        _, ratios = self.estimates(rest, seen, all_tokens - size, distinct)
        cell = np.zeros(len(self.at), np.int64)
        for ratio, context in zip(ratios, seen, strict=True):
            cell = (cell * BUCKETS + bucket(context)) * LEVELS + level(ratio)
        return np.unique(cell[self.train], return_counts=True)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one and the binary logarithm of its count; the last one is open."""
    return np.minimum(np.frexp(np.maximum(context, 0))[1], BUCKETS - 1)


def level(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.clip(np.rint(2 * np.log2(ratio)) + NONE, 1, LEVELS - 1)
    return np.where(ratio > 0, x, 0).astype(np.int64)


def weights(cells: np.ndarray, n: np.ndarray, order: int, rounds: int = 200) -> np.ndarray:
    """Mixture weights by order (from the second) and bucket, by expectation maximisation. Each bucket starts with one observation that says half; an unseen context has weight 0."""
    out = np.full((order - 1, BUCKETS), 0.5)
    out[:, 0] = 0
    ratio, of = [], []
    for _ in range(order - 1):
        q, cells = cells % LEVELS, cells // LEVELS
        ratio.insert(0, np.where(q > 0, 2.0 ** ((q - NONE) / 2), 0))
        of.insert(0, cells % BUCKETS)
        cells = cells // BUCKETS
    for _ in range(rounds):
        below, inner = np.ones(len(n)), []
        for k in range(order - 1):  # order 2 first
            inner.append(below)
            w = out[k][of[k]]
            below = w * ratio[k] + (1 - w) * below
        new, reach = out.copy(), np.ones(len(n))
        for k in reversed(range(order - 1)):
            w = out[k][of[k]]
            whole = w * ratio[k] + (1 - w) * inner[k]
            used = np.divide(w * ratio[k], whole, out=np.zeros(len(n)), where=whole > 0)
            new[k] = (np.bincount(of[k], n * reach * used, BUCKETS) + 0.5) / (np.bincount(of[k], n * reach, BUCKETS) + 1)
            reach = reach * (1 - used)
        new[:, 0] = 0
        moved, out = np.abs(new - out).max(initial=0), new
        if moved < 1e-6:
            break
    return out


def score(docs: DataFrame, held_out, order: int = 3, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, per_range: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out``: a condition; rows for which it is not true are trained on.
    Null and empty texts are an end alone. Repeated rows are so many documents.
    An empty table gives no rows; without training rows every token has
    probability 1 / 1 at the base, as there is nothing but the unseen token.
    Only the id and the text are read, so other columns may have any name.
    A text longer than ``chunk`` bytes is scored in parts that know their context; for the
    weights, a part is held out by itself.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3: the grid of the weights has a size for each")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(held_out, F.lit(False))
    asked = scratch.save(_chunks(docs.select(F.col(id).alias("id"), held.alias("held"), F.col(text).alias("text")), chunk))
    got = asked.agg(F.sum("trained"), F.sum("documents"), F.sum(F.lit(1))).first()
    all_tokens, starts = int(got[0] or 0), int(got[1] or 0)
    ranges = max(1, -(-all_tokens // per_range))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = batch.slice(k, 1).to_pylist()[0]
                yield ask(c["chunk"], _Chunk(c, order).grams, ranges)
            give_back()

    def reply(k: int, n: np.ndarray, total: np.ndarray, first: np.ndarray) -> dict:
        return {"total": squeeze(total), "known": int((first & (total > 0)).sum())}

    answers = scratch.save(answer(asked.select("chunk", "n", "words", "tokens", "held", "carried", "ends").mapInArrow(cells, CELL), reply, "total binary, known long"))
    distinct = int(answers.where(F.shiftright("range", 32) == 1).agg(F.sum("known")).first()[0] or 0)

    def know(left: pa.Table, right: pa.Table) -> pa.Table:
        c = left.to_pylist()[0]
        x = _Chunk(c, order)
        right = right.sort_by("range").to_pylist()
        counts = [np.concatenate([np.zeros(0, np.int64), *[unsqueeze(r["total"]) for r in right if r["range"] >> 32 == k]]) for k in range(1, order + 1)]
        cell, n = x.left(x.by_token(counts), starts, all_tokens, distinct)
        out = left.append_column("counts", pa.array([[squeeze(v) for v in counts]], pa.list_(pa.binary()))).append_column("cell", pa.array([cell], pa.list_(pa.int64()))).append_column("cell_n", pa.array([n], pa.list_(pa.int64())))
        del x, counts
        give_back()
        return out.drop_columns(["trained", "documents"])

    kind = docs.schema[id].dataType.simpleString()
    known = scratch.save(
        asked.groupBy("chunk").cogroup(answers.select("range", "chunk", "total").groupBy("chunk")).applyInArrow(
            know, f"chunk long, row long, ids array<{kind}>, held binary, n binary, carried int, ends boolean, words binary, tokens binary, counts array<binary>, cell array<long>, cell_n array<long>"
        )
    )
    scratch.drop(asked)
    scratch.drop(answers)
    grid = known.select(F.explode(F.arrays_zip("cell", "cell_n")).alias("x")).groupBy("x.cell").agg(F.sum("x.cell_n").alias("n"))
    found = grid.toPandas()  # of at most CELLS rows
    mixture = weights(found.cell.to_numpy(np.int64), found.n.to_numpy(np.float64), order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = batch.slice(k, 1).to_pylist()[0]
                x = _Chunk(c, order)
                counts = x.by_token([unsqueeze(b) for b in c["counts"]])
                seen = x.contexts(counts, starts)
                base, ratios = x.estimates(counts, seen, all_tokens, distinct)
                p = np.ones(len(base))
                for w, ratio, context in zip(mixture, ratios, seen, strict=True):
                    own = w[bucket(context)]
                    p = own * ratio + (1 - own) * p
                low, of = np.log10(base), x.row[x.own]
                sums = [np.bincount(of, v[x.own], x.rows) for v in (np.ones(len(base)), counts[0] > 0, low, low + np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c["row"] + np.arange(x.rows)), batch.column("ids").slice(k, 1).flatten(), pa.array(x.held), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                    ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
            give_back()

    read = known.select("row", "ids", "n", "words", "tokens", "held", "carried", "ends", "counts")
    scored = read.mapInArrow(judge, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("row").agg(F.first("id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 10, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of every whole text of documents, learned from those that are not held out; nulls, empty texts, repeats: see ``score``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out())
