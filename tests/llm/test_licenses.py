"""License notices: alignment against brute force, planted notices, odd texts."""

import random
from itertools import combinations

import pytest

from cadenza.llm import licenses

SF = "/root/testdata/sf0.001"
NAMES = sorted(licenses.NOTICES)


@pytest.fixture(scope="module")
def templates():
    return licenses.Templates(licenses.NOTICES)


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randrange(9))]
        got = [v[k] for k in licenses.increasing(v)]
        assert all(a < b for a, b in zip(got, got[1:]))
        best = max((n for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best


def test_alignment_is_of_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
        b = [w for w in a if rng.random() > 0.2] + [rng.choice("xyz")]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    words = "the quick brown fox jumps over a lazy dog".split()
    assert licenses.align(words, words) == [(k, k) for k in range(9)]
    assert licenses.align(words, words[:3] + ["red"] + words[3:]) == [(k, k + (k >= 3)) for k in range(9)]


@pytest.mark.parametrize("name", NAMES)
def test_planted_notices(templates, name):
    notice = licenses.NOTICES[name]
    text = f"Some words before it. {notice} And words after it, é."
    (found, start, end, coverage), = templates.find(text)
    assert (found, coverage) == (name, 1.0) and text[start:end] == notice.rstrip(".")
    twice = templates.find(f"{notice}\n{notice.upper()}\nfiller {notice}")
    assert [x[0] for x in twice] == [name] * 3


def test_texts_without_a_notice(templates):
    for text in ("", "a driving license", "the license the license " * 1000, "license", "MIT is in Cambridge", "version 2.0 " * 5000 + "license"):
        assert templates.find(text) == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = licenses.op10_licenses(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        whole = {n for n, notice in licenses.NOTICES.items() if notice.rstrip(".") in (texts[r.doc_id] or "")}
        assert whole <= set(r.licenses.split(",")) or any("CC-BY" in n for n in whole)


def test_rows_and_columns(spark):
    notice = licenses.NOTICES["MIT"]
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, notice, "y"), (3, notice, "y"), (None, notice, None)], "doc_id long, text string, licenses string")
    got = licenses.scan(docs).collect()
    assert sorted((r.doc_id or 0, [x.license for x in r.licenses]) for r in got) == [(0, ["MIT"]), (1, []), (2, []), (3, ["MIT"]), (3, ["MIT"])]
    assert licenses.scan(docs.where("false")).count() == 0
