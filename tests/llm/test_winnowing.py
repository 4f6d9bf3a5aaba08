"""Fingerprints against windows taken one by one, and the guarantee that shared stretches share a hash."""

import random
import re
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import winnowing as w

SF = "/root/testdata/sf0.001"


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def brute(text):
    """(place, hash) of the kept grams, window by window."""
    text = text or ""
    if len(text) < w.K:
        return [(0, h64(text.encode()))] if text else []
    grams = [h64(text[k : k + w.K].encode()) for k in range(len(text) - w.K + 1)]
    rank = lambda k: ((grams[k] & ((1 << 63) - 1)) >> 31, -k)  # noqa: E731  of equal hashes the rightmost
    kept = []
    for at in range(max(1, len(grams) - w.WINDOW + 1)):
        k = min(range(at, min(len(grams), at + w.WINDOW)), key=rank)
        if (k, grams[k]) not in kept[-1:]:
            kept.append((k, grams[k]))
    return kept


def form(text):
    return ",".join(f"{h:X}:{k}" for k, h in brute(text))


def like(a, b):
    a, b = {h for _, h in brute(a)}, {h for _, h in brute(b)}
    return 1.0 if not a | b else len(a & b) / len(a | b)


TEXTS = [None, "", "  \n", "a", "ab cd", "a b c", "a b c d", "one two three four five six seven", "same " * 50, "é日本 \U0001f600" * 20, "x" * 1000, "word " * 7, "我们今天去公园散步" * 12, "aB3+/xyzQUE" * 300, "".join(chr(97 + k * k % 23) for k in range(9000))]


def test_texts_one_by_one(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "k int, text string, kept string")
    got = df.withColumn("kept", w.kept_grams("text")).select("k", w.text_form("kept").alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == [form(t) for t in TEXTS]


def test_segments_are_seamless(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cdé") for _ in range(n)) for n in (30, 90, 91, 400, 2000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for size in (20, 64, 300):
        monkeypatch.setattr(w, "SEGMENT", size)
        got = df.select("k", w.text_form(w.kept_grams("text")).alias("f")).orderBy("k").collect()
        assert [r.f for r in got] == [form(t) for t in texts]


def test_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    texts = [r.text or "" for r in docs]
    got = {r.doc_id: r for r in w.op8_winnowing(spark, SF).collect()}
    assert sorted(got) == [r.doc_id for r in docs]
    for k, d in enumerate(docs):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha256(edited.encode()).hexdigest(), form(t), form(edited))
        assert r.near_edited == pytest.approx(like(t, edited)) and r.near_next == pytest.approx(like(t, nxt))


@pytest.mark.parametrize("alphabet", ["abcdef ", "我们今天去公园散步的是一不了人在有", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"])
def test_shared_passages_share_a_hash_wherever_they_stand(spark, alphabet):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = []
    for k in range(40):
        shared = text(w.REACH)
        rows.append((k, text(rng.randrange(60)) + shared + text(rng.randrange(60)), text(k % 4) + shared + text(k % 5)))
    df = spark.createDataFrame(rows, "k int, a string, b string").select(w.hashes(w.kept_grams("a")).alias("a"), w.hashes(w.kept_grams("b")).alias("b"))
    assert df.where(F.size(F.array_intersect("a", "b")) == 0).count() == 0


def test_hot_ids_are_dealt_over_ranges(spark):
    rows = [(5 if k % 3 else None if k % 2 else k, f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = w.with_next(df.repartition(3), ["text"], buckets=30).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    assert sorted(r.next.text for r in got) == sorted(t for _, t in rows)  # one round through all
    number = w._ranges([1, 5, 5, 5, 9])
    made = spark.range(1).select(*[number(F.lit(k).cast("long"), F.lit(h).cast("long")) for k, h in ((0, 7), (1, -1), (4, 0), (5, -1 << 62), (5, 0), (5, 1 << 62), (6, 0), (9, 3), (99, 0))]).first()
    assert list(made) == [0, 1, 1, 2, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("buckets", [1, 2, 50])
def test_next_rows(spark, buckets):
    ids = [7, None, -5, 3, 3, 100, 99, 98, 1 << 40]
    rows = [(i, f"t{k:02}") for k, i in enumerate(ids)]
    signed = lambda t: (h64(t.encode()) + (1 << 63)) % (1 << 64)
    got = w.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], buckets=buckets).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r.text: r.next.text for r in got} == want


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert [r.next.text for r in w.with_next(df, ["text"]).collect()] == ["alone"]
    assert w.with_next(df.where("false"), ["text"]).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "alone")], "doc_id long, text string").select(w.kept_grams("text"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("LogicalRDD")[0])
