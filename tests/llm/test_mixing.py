"""Targets against repeated resharing; the mix against its targets."""

from collections import Counter, defaultdict

import pytest

from cadenza.llm import mixing

SF = "/root/testdata/sf0.001"


def shares(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by resharing what capped sources can't take until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > epochs * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: epochs * sizes[s] for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len([w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w])


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 70},
    {"a": 0, "b": 0},
    {"a": 1},
    {"a": 0, "b": 100, "c": 1},
    {"Z": 100, "a": 100, "é": 100, "": 100, None: 100},
    {"a": 1, "b": 1, "c": 100000},
    {f"s{k}": (k * 37) % 11 * 10 for k in range(30)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def check(docs, rows):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r.doc_id: r.source for r in docs}
    text = {r.doc_id: r.text for r in docs}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs)
    for r in rows:
        assert r["size"] == words(text[r.doc_id])
        assert 0 <= r.taken <= 3 * r["size"]
        size[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target == pytest.approx(shares(size))
    for r in rows:
        assert r.source_size == size[source[r.doc_id]]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = mixing.op3_mixing(spark, SF).collect()
    check(docs, rows)
    again = mixing.op3_mixing(spark, SF).repartition(3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_hard_rows(spark):
    rows = [(k, "w " * (k % 7), ["b", None, "", "é", "b"][k % 5], 1.0) for k in range(60)] + [(60, None, "b", 0.0), (61, "x" * 300_000, "null only", 0.0), (62, "y\x0bz\tq\rr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    check(docs.collect(), mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    assert mixing.mix(docs.where("false")).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(2, "a", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 13  # all 13 words, by 5:2, but t takes at most 3


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(k, "w w w w w", "abc"[k % 3]) for k in range(3000)], "doc_id long, text string, source string")
    rows = mixing.sequence(mixing.mix(docs, weights=(1.0, 1.0, 1.0))).collect()
    place = [r.position for r in rows]
    assert place == sorted(place) and 0 <= min(place) and max(place) <= 15000
    early = Counter("abc"[r.doc_id % 3] for r in rows[:300])
    late = Counter("abc"[r.doc_id % 3] for r in rows[-300:])
    assert early["a"] > 2 * early["c"] and late["c"] > 2 * late["a"]


def test_positions_are_cumulative_demand(spark):
    """By a position, as many words as it says have been given out, and each source's by its own integral at that time."""
    sizes = {"a": 4000, "b": 1000, "c": 700}
    docs = spark.createDataFrame([(k, "w " * 5, s) for s, n in sizes.items() for k in range(n)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    rows = sorted((u["position"], r.source, u["words"]) for r in mixed.select("source", "uses").collect() for u in r.uses)
    target = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    total, schedule = sum(target.values()), dict(zip("abc", ((3, 1), (1, 1), (1, 3)), strict=True))
    part = lambda s, t: target[s] * (schedule[s][0] * t + (schedule[s][1] - schedule[s][0]) * t * t / 2) / (sum(schedule[s]) / 2)
    for stop in (0.1, 0.35, 0.7, 0.99):
        at = sum(part(s, stop) for s in target)
        before = Counter()
        for position, s, words_ in rows:
            if position < at:
                before[s] += words_
        assert sum(before.values()) == pytest.approx(at, abs=0.01 * total)
        for s in target:
            assert before[s] == pytest.approx(part(s, stop), abs=0.01 * total)


def test_query_is_range_sorted(spark):
    out = mixing.op3_mixing(spark, SF)
    assert "rangepartitioning(first_position" in out._jdf.queryExecution().toString()
    rows = [(r.first_position is not None, r.first_position or 0.0, r.doc_id) for r in out.collect()]
    assert rows == sorted(rows)


def test_in_order_keeps_columns(spark):
    docs = spark.createDataFrame([(k, f"w{k} x", "ab"[k % 2], "en") for k in range(40)], "doc_id long, text string, source string, target string")
    out = mixing.in_order(docs)
    assert out.columns == docs.columns and 0 < out.count() <= 120
