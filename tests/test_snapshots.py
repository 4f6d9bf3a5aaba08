"""Commits are whole, seen together, taken once, and two writers never have one number."""

import threading

import pytest
from pyspark.sql import functions as F

from cadenza.operators.snapshots import Store, content_digest

LABELS = "run string, signature string, track_id long, label int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), LABELS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_import_is_whole_or_not_at_all(spark, store):
    store.import_reviews(labels(spark, ("a", "s", 1, 1), ("b", "s", 2, 0)), {"a:s": "d1"})
    with pytest.raises(ValueError):
        store.import_reviews(labels(spark, ("a", "s", 1, 0), ("b", "s", 2, 7)))
    with pytest.raises(ValueError):
        store.import_reviews(labels(spark, ("a", "s", 1, 0), ("a", "s", 1, 1)))
    assert store.versions() == [1] and rows(store.reviews()) == [("a", "s", 1, 1), ("b", "s", 2, 0)]
    assert store.view().meta["label_file:a:s"] == "d1"
    store.import_reviews(labels(spark, ("a", "s", 3, 1)))
    assert rows(store.reviews()) == [("a", "s", 3, 1), ("b", "s", 2, 0)]
    assert rows(store.reviews(store.view(1))) == [("a", "s", 1, 1), ("b", "s", 2, 0)]


def test_a_failed_write_leaves_nothing(spark, store):
    store.import_reviews(labels(spark, ("a", "s", 1, 1)))
    broken = spark.range(3).select(F.raise_error(F.lit("disk")).alias("x"))
    with pytest.raises(Exception, match="disk"):
        store.commit(lambda now: ({"labels": labels(spark, ("a", "s", 9, 0)), "more": broken}, {"k": 1}))
    assert store.versions() == [1] and rows(store.reviews()) == [("a", "s", 1, 1)] and not store.view().has("more")


def test_a_file_counts_once(spark, store):
    kind = "run string, signature string, digest string, labels array<struct<track_id: long, label: int>>"
    f = lambda *r: spark.createDataFrame(list(r), kind)
    store.ingest(f(("a", "s", "d1", [(1, 1), (2, 0)]), ("b", "s", "e1", [(1, 0)])))
    assert store.ingest(f(("a", "s", "d1", [(1, 1), (2, 0)]))).version == 1
    store.ingest(f(("a", "s", "d2", [(1, 0)]), ("b", "s", "e1", [(1, 0)])))
    assert rows(store.reviews()) == [("a", "s", 1, 0), ("b", "s", 1, 0)] and store.view().table("labels").count() == 4
    store.ingest(f(("a", "s", "d1", [(1, 1), (2, 0)])))  # an older text again is a change again
    assert rows(store.reviews())[:2] == [("a", "s", 1, 1), ("a", "s", 2, 0)]
    store.ingest(f(("a", "s", "d3", [])))
    assert rows(store.reviews()) == [("b", "s", 1, 0)]


def test_two_writers_never_have_one_number(spark, store):
    won, errors = [], []

    def write(k):
        try:
            won.append(store.commit(lambda now: ({"t": spark.createDataFrame([(k,)], "k long")}, {f"w{k}": now.version})).version)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(won) == [1, 2, 3, 4, 5] == store.versions()
    now = store.view()
    assert sorted(r["k"] for r in now.table("t").collect()) == [0, 1, 2, 3, 4] and now.table("t").select("commit").distinct().count() == 5
    assert sorted(now.meta[f"w{k}"] for k in range(5)) == [0, 1, 2, 3, 4]


def test_the_same_snapshot_is_written_once(spark, store):
    tracks = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], "run string, track_id long, score double")
    model = spark.createDataFrame([("f", "{}", None)], "fingerprint string, model string, checkpoint string")
    one = store.save_snapshot({"runs": ["a"], "updated_at": 1}, {"tracks": tracks}, "f", model)
    again = store.save_snapshot({"runs": ["a"], "updated_at": 2, "excel_sync": "x"}, {"tracks": tracks.orderBy(F.desc("track_id"))}, "f", spark.createDataFrame([("f", None, "c")], model.schema))
    assert one == again == 1 and store.view().table("tracks").count() == 2
    assert rows(store.models().select("fingerprint", "model", "checkpoint")) == [("f", "{}", "c")]
    two = store.save_snapshot({"runs": ["a"]}, {"tracks": tracks.where("track_id = 1")}, "f")
    got = store.snapshot(["tracks"])
    assert two == 2 and got["number"] == 2 and rows(got["tables"]["tracks"]) == [("a", 1, 0.5)]
    store.commit(lambda now: ({}, {"state": {"runs": ["a", "b"]}}))
    with pytest.raises(ValueError):
        store.snapshot(["tracks"])
    assert content_digest(tracks) == content_digest(tracks.select("score", "run", "track_id").repartition(3)) != content_digest(tracks.union(tracks))


def test_no_snapshot_and_sync(spark, store, tmp_path):
    with pytest.raises(ValueError):
        store.snapshot([])
    store.save_snapshot({"runs": []}, {"t": spark.range(2).toDF("k")})
    assert store.sync_status()["status"] == "pending"
    assert store.sync_status("no disk")["error"] == "no disk" and store.sync_status("")["status"] == "synced"
    store.backup(f"file://{tmp_path}/copy")
    copy = Store(spark, f"file://{tmp_path}/copy")
    assert rows(copy.snapshot(["t"])["tables"]["t"]) == [(0,), (1,)]
    with pytest.raises(ValueError):
        store.backup(f"file://{tmp_path}/copy")
