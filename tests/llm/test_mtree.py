"""Exact search against a full sort of all products."""

import numpy as np
import pytest

from cadenza.llm import mtree

SF = "/root/testdata/sf0.001"


def brute(x, ids, k, query_rows):
    """query_id, rank, vec_id, score."""
    out = []
    for q in query_rows:
        s = x @ x[q]
        order = [c for c in np.lexsort((ids, -s)) if ids[c] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[c]), int(s[c])) for r, c in enumerate(order)]
    return sorted(out)


def run(spark, rows, k=20, cells=1, blocks=1):
    v = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    pages = mtree.index(v, cells)
    return sorted(tuple(r) for r in mtree.top_k(pages, v.where("vec_id % 20 = 0"), k, cells, blocks).select("query_id", "rank", "vec_id", "score").collect())


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.array([[int(np.floor(64 * np.float64(c))) for c in r.embedding] for r in rows])
    ids = np.array([r.vec_id for r in rows])
    got = mtree.op7_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(x, ids, 20, [k for k, i in enumerate(ids) if i % 20 == 0])


@pytest.mark.parametrize(("cells", "blocks"), [(1, 1), (3, 2), (200, 1)])
def test_ties_and_copies(spark, cells, blocks):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (400, 4))
    x[100:180] = x[100]
    x[200:210] = 0
    rows = [(k, (v / 64).tolist()) for k, v in enumerate(x)]
    assert run(spark, rows, 20, cells, blocks) == brute(x, np.arange(400), 20, range(0, 400, 20))


def test_rows_without_part(spark):
    good = [0.5, 0.25]
    rows = [(0, good), (1, good), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (20, [1.0, -1.0, 2.0]), (40, [])]
    # A vector of another length, or with no component, has no other to be compared with.
    assert run(spark, rows) == [(0, 1, 1, 32 * 32 + 16 * 16)]
    assert run(spark, []) == []
    assert run(spark, rows[:1]) == []


def test_repeated_rows_are_results_once_for_each(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])]
    assert run(spark, rows) == [(0, 1, 1, 2048), (0, 2, 1, 2048)]


@pytest.mark.parametrize("size", [4, 16, 256])
def test_trees_hold_all_rows_within_their_radii(size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)) * 64 // 1
    x[:200] = x[0]
    pages = mtree.build(np.arange(600), x, size)

    def below(at, centre, radius):
        p = pages[at]
        d = mtree.distances(p["vectors"], centre[None])[:, 0] if centre is not None else None
        if d is not None:
            assert np.allclose(d, p["parents"], atol=1e-5) and (not p["leaf"] or (d <= radius + 1e-5).all())
        if p["leaf"]:
            return list(p["ids"])
        return [i for c, v, r in zip(p["ids"], p["vectors"], p["radii"], strict=True) for i in below(c, v, r)]

    assert sorted(below(0, None, None)) == list(range(600))


@pytest.mark.parametrize("scale", [1, 1e4, 1e6, 3e6])
def test_large_components_are_exact(scale):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(1500, 16)) * 64 * scale)
    whole = x.astype(np.int64)
    score, ids = mtree.search(mtree.build(np.arange(1500), x), x[:20], np.arange(20), 10)
    for q in range(20):
        s = (whole * whole[q]).sum(1)
        order = [c for c in np.lexsort((np.arange(1500), -s)) if c != q][:10]
        assert ids[q].tolist() == order and score[q].tolist() == s[order].tolist()


def test_products_beyond_a_long_are_an_error():
    x = np.full((3, 4), 2.0**31)
    with pytest.raises(OverflowError):
        mtree.search(mtree.build(np.arange(3), x), x[:1], np.arange(1), 2)


def test_stored_distances_spare_computations():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.rint(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 4)
    counts = {}
    score, ids = mtree.search(mtree.build(np.arange(8000), x), x[:5], np.arange(5), 10, counts)
    for q in range(5):
        s = (x @ x[q]).astype(int)
        order = [c for c in np.lexsort((np.arange(8000), -s)) if c != q][:10]
        assert ids[q].tolist() == order and score[q].tolist() == s[order].tolist()
    assert counts["avoided"] > 0 and counts["computed"] < 5 * 8000
