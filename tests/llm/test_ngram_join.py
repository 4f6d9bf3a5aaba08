"""The n-gram join against all pairs of small tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import ngram_join
from cadenza.llm.arrowtext import text_bytes
from cadenza.llm.graph import components
from cadenza.llm.shingles import shingle_sets
from cadenza.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id to (set size, component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            lo, hi = sorted((find(i), find(j)))
            root[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in ngram_join.link(df).collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words)) if words else 0
        words[k : k + 1] = rng.choice([[], [f"new{rng.randrange(10**6)}"], [*words[k : k + 1], f"add{rng.randrange(10**6)}"]])
    return words


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies around the threshold, of many sizes, with passages that many share and hot groups of copies."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 20, 31, 33, 40, 64, 90, 130, 200, 400):
        for _ in range(2):
            words = [rng.choice(vocabulary) for _ in range(size)]
            texts += [words, list(words)]
            for n in (1, 1, 2, 3, max(1, size // 30), max(1, size // 25), max(1, size // 20)):
                texts.append(changed(rng, words, n))
            texts.append(changed(rng, texts[-1], max(1, size // 40)))
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))] for _ in range(80)]
    texts += [passage[:] for _ in range(60)]
    out = [" ".join(w) for w in texts]
    out = [t.upper() if k % 17 == 0 else t for k, t in enumerate(out)] + [None, "", " \t\n", "A\x0bb", "a b", "é É", "é é", "É É"]
    ids = rng.sample(range(-500, 5000), len(out))
    return list(zip(ids, out, strict=True))


def test_planted(spark, planted):
    assert run(spark, planted) == brute(planted)


def test_shared_shingles_lose_no_link(spark, planted, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARED_LEAST", 4)
    assert run(spark, planted) == brute(planted)


def test_small_cells_lose_no_link(spark, planted, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARED_LEAST", 4)
    monkeypatch.setattr(ngram_join, "CELL_WEIGHT", 5000)
    assert run(spark, planted) == brute(planted)


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    """Copies of one text that differ so much that many of their pairs are no links."""
    monkeypatch.setattr(ngram_join, "CELL_WEIGHT", 20_000)
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(80)]
    rows = [(k, " ".join(changed(rng, words, rng.randrange(6)))) for k in range(400)]
    assert run(spark, rows) == brute(rows)


def test_groups_go_on_over_batches():
    rng = random.Random(2)
    rows = sorted((rng.randrange(8), rng.choice([-1, -1, 0, 1]), rng.randrange(12)) for _ in range(60))
    for size in (1, 2, 3, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + size]), (pa.int64(), pa.int8(), pa.int64()))], ["key", "salt", "node"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in ngram_join._groups(iter(batches)) for r in b.to_pylist()]
        groups = {g: sorted({x for *k, x in rows if tuple(k) == g}) for g in {r[:2] for r in rows}}
        assert sorted(got) == sorted((*g, xs[0], x) for g, xs in groups.items() if len(xs) > 1 or g[1] >= 0 for x in xs)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in ngram_join.op2_ngram_jaccard(spark, SF).collect()) == brute(rows)


def test_repeated_and_null_ids(spark):
    t = "one two three four five six seven"
    u = "other words stand here and are many"
    df = spark.createDataFrame([(5, t), (5, t), (3, u), (9, t), (9, u), (None, t), (7, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.link(df).collect()), key=lambda x: x[0])
    assert got == [(-1, 3, None), (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 1, 7), (9, 3, 3), (9, 3, 3)]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(2, None), (1, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_sets_of_hashes_have_the_sizes_of_sets_of_words(planted):
    h, at = shingle_sets(*text_bytes(pa.array([t for _, t in planted], pa.string())))
    assert np.diff(at).tolist() == [len(shingles(t)) for _, t in planted]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    best = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    assert got == best
