"""The streamed tracker gives what the batch one gives, however the rows come; late ones are marked."""

import random

from pyspark.sql import functions as F

from cadenza.operators.tracking import bodies, track
from cadenza.streaming.tracker import track_stream
from tests.test_motion import placed, pose

SCHEMA = "run string, frame long, det long, joints array<double>"


def streamed(spark, tmp_path, batches, name, **more):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = track_stream(files, **more).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240), q.lastProgress
    finally:
        q.stop()
    return {(r["run"], r["frame"], r["det"]): r["tracklet"] for r in spark.table(name).collect()}


def scene(spark):
    frames = {(d, f): placed(100 + 300 * d + 4 * f, 200, 40) for f in range(24) for d in range(2) if not (d == 1 and 5 <= f <= 9)}
    b = bodies(pose(spark, frames))
    want = {("0", r["frame"], r["det"]): r["tracklet"] for r in track(b).collect()}
    return want, [(str(r["run"]), r["frame"], r["det"], list(r["joints"])) for r in b.collect()]


def test_shuffled_rows_give_the_batch_result(spark, tmp_path):
    want, rows = scene(spark)
    rng = random.Random(3)
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 6))
    batches = [rows[k : k + 14] for k in range(0, len(rows), 14)]
    batches.append([("0", 40, None, None)])  # an empty frame far ahead takes all that waits
    assert streamed(spark, tmp_path, batches, "shuffled", delay=7) == want


def test_late_rows_have_no_tracklet_and_change_nothing(spark, tmp_path):
    want, rows = scene(spark)
    late = [r for r in rows if r[1] == 3]
    on_time = sorted((r for r in rows if r[1] != 3), key=lambda r: r[1])
    cut = next(k for k, r in enumerate(on_time) if r[1] > 12)
    got = streamed(spark, tmp_path, [on_time[:cut], [*late, *on_time[cut:]], [("0", 60, None, None), ("1", 0, 0, late[0][3])], [("1", 1, None, None)]], "late")
    assert {k: v for k, v in got.items() if k[1] == 3} == {(r[0], 3, r[2]): None for r in late}
    assert got["1", 0, 0] == 0
    assert {k: v for k, v in got.items() if k[0] == "0" and k[1] != 3} == {k: v for k, v in want.items() if k[1] != 3}
