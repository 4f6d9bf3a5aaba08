import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import lm_scores as m


def tokens(text):
    text = re.sub("[A-Z]+", lambda x: x[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), 1]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def model(rows, order, wanted=None):
    """Base and full score of every row by plain counting; the mixture weights by plain expectation maximisation over single tokens."""
    pad = lambda t: [0] * (order - 1) + t
    docs = [tokens(t) for _, t in rows]
    own = []
    for d in docs:
        c, p = Counter(), pad(d)
        for i in range(order - 1, len(p)):
            for k in range(1, order + 1):
                c[tuple(p[i - k + 1 : i + 1])] += 1
                if k > 1:
                    c["context", tuple(p[i - k + 1 : i])] += 1
        own.append(c)
    total = Counter()
    for (doc, _), c in zip(rows, own, strict=True):
        if not is_held(doc):
            total.update(c)
    n = sum(v for k, v in total.items() if len(k) == 1)
    distinct = sum(1 for k, v in total.items() if len(k) == 1 and v)

    def parts(p, i, c, n):
        base = (c[(p[i],)] + 0.1) / (n + 0.1 * (distinct + 1))
        out = []
        for k in range(2, order + 1):
            seen = c["context", tuple(p[i - k + 1 : i])]
            out.append((c[tuple(p[i - k + 1 : i + 1])] / seen if seen else 0.0, min(seen.bit_length(), 15)))
        return base, out

    def mixed(base, out, w):
        p = base
        for k, (f, b) in enumerate(out):
            p = w[k][b] * f + (1 - w[k][b]) * p
        return p

    w = wanted if wanted is not None else np.zeros((order - 1, 16))
    scored = []
    for (doc, _), d in zip(rows, docs, strict=True):
        p = pad(d)
        x = [parts(p, i, total, n) for i in range(order - 1, len(p))]
        scored.append((doc, is_held(doc), len(d), sum(total[(t,)] > 0 for t in d), n, sum(math.log10(b) for b, _ in x), sum(math.log10(mixed(b, o, w)) for b, o in x)))
    left = []
    for (doc, _), d, c in zip(rows, docs, own, strict=True):
        if not is_held(doc):
            rest, p = Counter(total), pad(d)
            rest.subtract(c)
            left += [parts(p, i, rest, n - len(d)) for i in range(order - 1, len(p))]
    return scored, left


def found(spark, rows, order=3, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, chunk string").withColumn("score", F.lit("x"))
    out = m.score(df, m.held_out(), order, **more)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return [tuple(r) for r in out.collect()]


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = [(int(k), " ".join(rng.choice(["The", "a", "É", "\tx", "y\n"], int(rng.integers(0, 40)), p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for k in range(n)]
    return rows + [(None, "the the"), (None, None), (3, None), (4, ""), (5, "the a the a"), (5, "the a the a")]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


@pytest.mark.parametrize(("order", "chunk", "per_range"), [(1, 300, 10), (2, 1 << 20, 2_000_000), (3, 500, 40)])
def test_brute(spark, monkeypatch, order, chunk, per_range):
    rows, kept = texts(order), {}
    original = m.weights
    monkeypatch.setattr(m, "weights", lambda *a: kept.setdefault("w", original(*a)))
    got = found(spark, [(*r, 1, "c") for r in rows], order, chunk=chunk, per_range=per_range)
    want, left = model(rows, order, kept["w"])
    same(got, want)
    # The learned weights are about as likely as the best of plain expectation maximisation on the tokens themselves.
    if order == 2:
        like = lambda w: sum(math.log(w[b] * f + (1 - w[b]) * base) for base, [(f, b)] in left)
        w = np.where(np.arange(16) > 0, 0.5, 0.0)
        for _ in range(200):
            new, reach = np.full(16, 0.5), np.ones(16)
            for base, [(f, b)] in left:
                new[b] += w[b] * f / (w[b] * f + (1 - w[b]) * base)
                reach[b] += 1
            w = new / reach
            w[0] = 0
        assert abs(like(w) - like(kept["w"][0])) < 0.01 * abs(like(w))


def test_long_text_in_parts(spark, monkeypatch):
    """Parts know the words before them; only the mixture weights, here given, may differ, as a part alone is left out for them."""
    w = np.full((2, 16), 0.4)
    w[:, 0] = 0
    monkeypatch.setattr(m, "weights", lambda *a: w)
    rows = texts(7, 12) + [(100, "a b c d " * 300 + "w" * 500 + " the"), (101, "v" * 600)]
    same(found(spark, [(*r, 1, "c") for r in rows], chunk=128), model(rows, 3, w)[0])


def test_empty_and_no_training(spark):
    assert found(spark, []) == []
    held = next(k for k in range(1000) if is_held(k))
    assert found(spark, [(held, "a b", 1, "c")]) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_better_than_the_base_on_held_out(spark):
    rng = np.random.default_rng(5)
    phrases = ["once upon a time there was", "in the end it was so", "he said that she"]
    rows = [(k, " ".join(rng.choice(phrases, 8)), 1, "c") for k in range(200)]
    held = [x for x in found(spark, rows) if x[1]]
    assert held and all(x[6] > x[5] for x in held)
