"""Language identification by mixture inference.

A document is seen as draws of byte trigrams from a mixture of languages.
Training counts hashed trigrams per language; prediction runs expectation
maximisation on the document's own trigrams for the language proportions, and
keeps the set of languages with the best penalised likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import LOWER, SEPARATOR, slices, text_bytes

BUCKETS = 1 << 15
#: Training rows, at most, for each language. Rows are taken by a hash of their text, so the sample is the same for every run.
SAMPLE = 4000
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of text that are judged at once: every trigram of them has a row of likelihoods.
AT_ONCE = 1 << 19
PENALTY = 2.0
ROUNDS = 12


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each trigram of lower-cased bytes; digits are one symbol, separators another, none crosses a row."""
    b = LOWER[data]
    b = np.where((b >= 48) & (b <= 57), np.uint8(48), np.where(SEPARATOR[b], np.uint8(32), b)).astype(np.uint32)
    n = len(b) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:n] << np.uint32(16)) | (b[1 : n + 1] << np.uint32(8)) | b[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(b)]
    whole = row[:n] == row[2:]
    return bucket[whole].astype(np.int64), row[:n][whole]


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Trigram counts by language: label, bucket, n.

    ``docs`` has text and the label column; rows without either are not used.
    At most ``sample`` rows for each label are read, the first by a hash of
    the text: a documented bound of the classifier, not of any statistic. An
    empty table gives an empty model, with which every text is ``und``.
    """
    order = F.xxhash64("text")
    least = (
        docs.where(F.col("text").isNotNull() & F.col(label).isNotNull())
        .select(F.col(label).cast("string").alias("label"), order.alias("h"), "text")
    )
    # The sample is the rows whose hash is under a threshold of each label, found from counts of 4096 hash ranges.
    ranges = least.groupBy("label", F.shiftright(F.col("h"), 52).alias("r")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("label").orderBy("r"))
    bounds = (
        ranges.withColumn("upto", total)
        .where((F.col("upto") <= sample) | (F.col("upto") - F.col("n") <= 0))
        .groupBy("label").agg(F.max("r").alias("last"))
    )
    chosen = least.join(F.broadcast(bounds), "label").where(F.shiftright(F.col("h"), 52) <= F.col("last"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            bucket, row = _grams(*text_bytes(batch.column(1)))
            names, inverse = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(names):
                own = bucket[inverse[row] == k]
                sums.setdefault(str(name), np.zeros(BUCKETS, np.int64))
                sums[str(name)] += np.bincount(own, minlength=BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["label", "bucket", "n"])

    counted = chosen.select("label", "text").mapInArrow(count, "label string, bucket int, n long")
    return counted.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


#: What every task holds is a table of so many labels at most, some 130 MB; the world's written languages are fewer.
MOST_LABELS = 512


def _tables(model: DataFrame, most_labels: int) -> tuple[list[str], np.ndarray]:
    """The labels in order and log likelihoods, bucket by label. Their size is bounded by the buckets and the number of labels."""
    rows = model.limit(BUCKETS * most_labels + 1).toPandas()
    labels = sorted(rows.label.unique())
    if len(labels) > most_labels or len(rows) > BUCKETS * most_labels:
        raise ValueError(f"more than {most_labels} labels")
    c = np.zeros((BUCKETS, max(1, len(labels))))
    for k, name in enumerate(labels):
        own = rows[rows.label == name]
        c[own.bucket.to_numpy(), k] = own.n.to_numpy()
    c += 0.05
    c /= c.sum(0)
    return labels, np.log(c, out=c)


def _mixture(like: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions by expectation maximisation; like: likelihoods gram by language, n: times each gram occurs."""
    pi = np.full(like.shape[1], 1 / like.shape[1])
    weight = n / n.sum()
    for _ in range(ROUNDS):
        joint = like * pi
        new = (joint * (weight / joint.sum(1))[:, None]).sum(0)
        if np.abs(new - pi).max() < 1e-3:
            return new
        pi = new
    return pi


def infer(like: np.ndarray, log_like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over all languages and the chosen set (as a mask).

    Languages enter in order of their proportion while each added one raises
    the log likelihood by more than the penalty times the log of the sample size.
    """
    every = _mixture(like, n)
    order = np.argsort(-every, kind="stable")
    chosen, pi = order[:1], np.zeros(len(every))
    pi[order[0]] = 1.0
    best = float(n @ log_like[:, order[0]])
    cost = PENALTY * np.log(n.sum() + 1)
    for k in range(2, len(order) + 1):
        if every[order[k - 1]] < 0.02:
            break
        own = order[:k]
        some = _mixture(like[:, own], n)
        value = float(n @ np.log(like[:, own] @ some + 1e-300))
        if value - best <= cost:
            break
        best, chosen = value, own
        pi[:] = 0
        pi[own] = some
    mask = np.zeros(len(every), bool)
    mask[chosen] = True
    return pi, mask


def judge(texts: pa.Array, labels: list[str], logs: np.ndarray) -> tuple[list[str], list[float], list[str]]:
    """Language, score and language set of each text.

    The language is the one with the largest proportion in the chosen set,
    score that proportion. A text that is null, empty or without a letter,
    and any text under an empty model, is ``und`` with score 0 and no
    languages. Ties go to the first label by code point. A text with letters
    but under three bytes has no trigram: it gets the first label and 0.
    """
    bucket, row = _grams(*text_bytes(texts))
    code, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    of, bucket = code // BUCKETS, code % BUCKETS
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    log_like = logs[bucket]
    if len(log_like):
        log_like = log_like - log_like.max(1, keepdims=True)
    like = np.exp(log_like)
    names, scores, sets = [], [], []
    for k, text in enumerate(texts.to_pylist()):
        lo, hi = at[k], at[k + 1]
        name, score, chosen = "und", 0.0, ""
        if text is not None and labels and LETTER.search(text):
            name = labels[0]
            if lo < hi:
                pi, mask = infer(like[lo:hi], log_like[lo:hi], n[lo:hi])
                name, score = labels[int(np.argmax(pi))], float(min(1.0, pi.max()))
                chosen = ",".join(x for x, m in zip(labels, mask, strict=True) if m)
        names.append(name)
        scores.append(score)
        sets.append(chosen)
    return names, scores, sets


def predict(docs: DataFrame, model: DataFrame, most_labels: int = MOST_LABELS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred, score, languages for every row; what they mean, ``judge`` says."""
    labels, logs = _tables(model, most_labels)
    keep = [c for c in keep if c not in ("lang_pred", "score", "languages")]
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    out_type = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double", "languages string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            names, scores, sets = judge(batch.column(len(keep)), labels, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())], [*keep, "lang_pred", "score", "languages"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, out_type)


def keep_known(docs: DataFrame, model: DataFrame, least: float = 0.5, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows, with all their columns, whose language is known: not ``und``, and with at least this score."""
    labels, logs = _tables(model, most_labels)
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            names, scores, _ = judge(batch.column(at), labels, shared.value)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "languages")
