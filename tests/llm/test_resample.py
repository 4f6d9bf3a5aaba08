import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import resample as r

FIELDS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, most=1, percent=10, least=20):
    s, t = (Counter(b for x in texts for b in features(x, most)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, (doc, text) in enumerate(rows):
        w, f = features(text, most)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, len(w) >= least and doc is not None])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0], x[1]))
    for k, x in enumerate(may[: len(may) * percent // 100]):
        x[4] = k + 1
    return sorted([tuple(x[:5]) for x in out], key=str)


def found(spark, rows, target, **more):
    df = r.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), **more)
    assert df.columns == FIELDS
    return sorted([tuple(x) for x in df.collect()], key=str)


def some(rng, n):
    return "".join(rng.choice(list("abAZé1_. -\n"), n))


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 37), (3, 100)])
def test_brute(spark, most, percent):
    rng = np.random.default_rng(most)
    rows = [(int(k) - 50, some(rng, int(rng.integers(0, 400)))) for k in range(200)]
    rows += rows[:40] + [(None, some(rng, 300)), (None, None), (7, None), (8, ""), (9, "x" * 5000 + " é" * 30), (-(1 << 63), "a " * 25), ((1 << 63) - 1, "a " * 25)]
    target = [some(rng, 100), None, "", "abAZ a b"]
    assert found(spark, rows, target, most=most, percent=percent) == brute(rows, target, most, percent)


def test_rows_that_are_all_alike(spark):
    rows = [(5, "a b " * 20)] * 300
    got = found(spark, rows, ["a"])
    assert got == brute(rows, ["a"])
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 31))


def test_long_text_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, target = [(1, some(rng, 5000)), (2, "y" * 700 + " z " * 60), (3, "a b " * 30)], ["a b"]
    monkeypatch.setattr(r, "AT_ONCE", 64)
    import pyarrow as pa

    for _, text in rows:
        for most in (1, 3):
            got = [b for *_, found, _ in r._features(pa.array([text]), most, 10000) for b in found.tolist()]
            assert Counter(got) == Counter(features(text, most)[1])


def test_empty(spark):
    assert found(spark, [], ["a"]) == []
    assert found(spark, [(1, "a " * 30)], []) == brute([(1, "a " * 30)], [])


def test_selection_by_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.integers(-(1 << 62), 1 << 62, 300) // (1 << 40) * (1 << 40), rng.integers(-3, 3, 300), strict=True))] * 1
    rows += [(a, b, k + 1000) for a, b, k in rows]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 255, 599, 600):
        got = [tuple(x) for x in df.where(r.up_to_kth(df, ["a", "b", "c"], k)).collect()]
        assert sorted(got) == sorted(rows)[:k]
