"""The layers of identities against a replay by hand, stale freezes, and the cache of what is derived."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import authority
from cadenza.sources.cache import StampedCache, cached_scan, file_stamps

PERSONS = "run long, frame long, det long, person long, size long"


def tidy(rows):
    """rows: {(frame, det): [person, size]}, renumbered, one detection a person and frame."""
    ids = {p: k for k, p in enumerate(sorted({p for p, _ in rows.values() if p is not None}))}
    rows = {k: [ids.get(p), s] for k, (p, s) in rows.items()}
    best = {}
    for (f, d), (p, s) in sorted(rows.items()):
        if p is not None and ((f, p) not in best or s > best[f, p][1]):
            best[f, p] = (d, s)
    return {(f, d): [p if p is not None and best[f, p][0] == d else None, s] for (f, d), (p, s) in rows.items()}


def apply(rows, e):
    n = 1 + max((p for p, _ in rows.values() if p is not None), default=-1)
    out = {}
    for (f, d), (p, s) in rows.items():
        if e["op"] == "merge":
            p = next((min(g) for g in e["groups"] if p in g), p)
        elif e["op"] == "split" and p == e["person"] and f >= e["frame"]:
            p = n
        elif e["op"] == "swap" and p in e["people"] and e["frames"][0] <= f <= e["frames"][1]:
            p = e["people"][1 - e["people"].index(p)]
        elif e["op"] == "remove" and p == e["person"] and e["frames"][0] <= f <= e["frames"][1]:
            p = None
        out[f, d] = [p, s]
    return tidy(out)


def some_edit(rng, n):
    a, b = (int(x) for x in rng.choice(n, 2, replace=False))
    lo = int(rng.integers(0, 6))
    return [
        {"op": "merge", "groups": [[a, b]]}, {"op": "split", "person": a, "frame": lo},
        {"op": "swap", "people": [a, b], "frames": [lo, lo + 3]}, {"op": "remove", "person": a, "frames": [lo, lo + 1]},
    ][int(rng.integers(0, 4))]


def edit_rows(spark, logs):
    rows = [(run, k, e["op"], e.get("groups"), e.get("person"), e.get("people"), e.get("frame"), e.get("frames")) for run, log in logs.items() for k, e in enumerate(log)]
    return spark.createDataFrame(rows, authority.EDITS)


def runs(rng, n_runs=6):
    out = {}
    for run in range(n_runs):
        out[run] = {(f, d): [int(rng.integers(0, 5)) if rng.random() > 0.1 else None, int(rng.integers(1, 4))] for f in range(10) for d in range(int(rng.integers(1, 5)))}
    return out


def table(spark, data):
    return spark.createDataFrame([(run, f, d, p, s) for run, rows in data.items() for (f, d), (p, s) in rows.items()], PERSONS)


@pytest.mark.parametrize("seed", range(2))
def test_layers_are_applied_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    data, logs, joins = runs(rng), {}, {0: [[0, 1]], 1: [[2, 1], [0, 3, 3]], 2: [[4]], 3: [[0, 2]]}
    want = {}
    for run, rows in data.items():
        base = tidy(rows)
        if run in (0, 1):  # 2 has no group of two, 3 is stale
            base = apply(base, {"op": "merge", "groups": [sorted(set(g)) for g in joins[run]]})
        state, log = base, []
        for _ in range(int(rng.integers(0, 5)) if run != 5 else 0):
            n = 1 + max(p for p, _ in state.values() if p is not None)
            if n < 2:
                break
            log.append(some_edit(rng, n))
            state = apply(state, log[-1])
        logs[run] = log
        want |= {(run, f, d): (base[f, d][0], state[f, d][0]) for f, d in rows}
    stamps = spark.createDataFrame([(run, f"s{run}") for run in data], "run long, stamp string")
    frozen = authority.freeze(spark.createDataFrame(list(joins.items()), "run long, groups array<array<long>>"), stamps)
    frozen = frozen.withColumn("stamp", F.when(F.col("run") == 3, "older").otherwise(F.col("stamp")))
    got = authority.stable_tracks(table(spark, data), stamps, frozen, edit_rows(spark, logs))
    assert {(r["run"], r["frame"], r["det"]): (r["base"], r["person"]) for r in got.collect()} == want
    states = {r["run"]: r["learned"] for r in authority.layers(stamps, frozen, edit_rows(spark, logs)).collect()}
    assert states == {0: "applied", 1: "applied", 2: "applied", 3: "stale", 4: "none", 5: "none"}


def test_a_freeze_of_another_version_is_stale(spark):
    stamps = spark.createDataFrame([(0, "s")], "run long, stamp string")
    frozen = authority.freeze(spark.createDataFrame([(0, [[0, 1]])], "run long, groups array<array<long>>"), stamps, version=2)
    assert authority.layers(stamps, frozen, edit_rows(spark, {})).first()["learned"] == "stale"


@pytest.mark.parametrize(
    ("edit", "said"),
    [({"op": "merge", "groups": [[0, 9]]}, "not shown"), ({"op": "merge", "groups": [[0, 1], [1, 2]]}, "one merge group"), ({"op": "swap", "people": [1, 1], "frames": [0, 1]}, "two different"), ({"op": "erase", "person": 0}, "no such edit")],
)
def test_edits_that_cannot_be(spark, edit, said):
    data = {7: {(0, 0): [0, 1], (0, 1): [1, 1], (1, 0): [2, 1]}}
    with pytest.raises(Exception, match=said):
        authority.replay_runs(table(spark, data), edit_rows(spark, {7: [edit]})).collect()


def test_only_changed_runs_are_derived_again(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = runs(rng, 4)
    stamps = spark.createDataFrame([(run, f"s{run}") for run in data], "run long, stamp string")
    frozen = authority.freeze(spark.createDataFrame([(0, [[0, 1]])], "run long, groups array<array<long>>"), stamps)
    cache = StampedCache(spark, f"file://{tmp_path}/tracks")
    logs = {1: [{"op": "split", "person": 0, "frame": 4}]}
    first = authority.stable_tracks(table(spark, data), stamps, frozen, edit_rows(spark, logs), cache=cache).collect()
    assert cache.index().count() == 4
    plain = authority.stable_tracks(table(spark, data), stamps, frozen, edit_rows(spark, logs)).collect()
    assert sorted(first, key=str) == sorted([type(first[0])(**{k: r[k] for k in first[0].asDict()}) for r in plain], key=str)
    authority.stable_tracks(table(spark, data), stamps, frozen, edit_rows(spark, logs), cache=cache)
    assert cache.index().count() == 4
    logs[2] = [{"op": "remove", "person": 1, "frames": [0, 3]}]
    authority.stable_tracks(table(spark, data), stamps, frozen, edit_rows(spark, logs), cache=cache)
    assert [r["key"] for r in cache.index().groupBy("key").count().where("count = 2").collect()] == ["2"]


def test_fragments(spark):
    t = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, None)], "run long, base long, person long")
    n = spark.createDataFrame([(0, 0, 3), (0, 1, 2)], "run long, base long, n long")
    assert {(r["person"], r["fragments"]) for r in authority.fragments_of(t, n).collect()} == {(0, 3), (1, 5)}


def test_only_touched_files_are_parsed_again(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/cache"
    src.mkdir()
    for k in range(4):
        (src / f"{k}.json").write_text("".join(f'{{"v": {k * 10 + i}}}\n' for i in range(k + 1)))
    parsed = []

    def read(files):
        parsed.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return spark.read.schema("v long").json(files)

    def scan(version="1"):
        return sorted(r["v"] for r in cached_scan(spark, str(src), root, read, version).collect())

    every = [k * 10 + i for k in range(4) for i in range(k + 1)]
    assert scan() == every and scan() == every and parsed == [["0.json", "1.json", "2.json", "3.json"]]
    (src / "2.json").write_text('{"v": 99}\n')
    (src / "0.json").unlink()
    assert scan() == [10, 11, 30, 31, 32, 33, 99] and parsed[1:] == [["2.json"]]
    StampedCache(spark, root).compact()
    assert scan() == [10, 11, 30, 31, 32, 33, 99] and len(parsed) == 2
    assert scan("2") == [10, 11, 30, 31, 32, 33, 99] and parsed[2:] == [["1.json", "2.json", "3.json"]]
    assert file_stamps(spark, str(src)).count() == 3


def test_a_file_without_rows_is_not_parsed_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("")
    (tmp_path / "in" / "b.json").write_text('{"v": 1}\n')
    calls = []

    def read(files):
        calls.append(files)
        return spark.read.schema("v long").json(files)

    for _ in range(2):
        assert cached_scan(spark, str(tmp_path / "in"), f"file://{tmp_path}/c", read).count() == 1
    assert len(calls) == 1
