import json

import numpy as np
import pytest

from cadenza.operators import features, identity, learning, registry
from cadenza.sources import records
from cadenza.streaming.tracker import track_stream


def persons(spark, rows):
    return spark.createDataFrame([(0, f, d, p, 1) for f, d, p in rows], "run long, frame long, det long, person long, size long")


def at(df):
    return {(r["frame"], r["det"]): r["person"] for r in df.collect()}


def test_edit_log(spark):
    p = persons(spark, [(f, d, d) for f in range(4) for d in range(3)])
    log = [{"op": "merge", "groups": [[1, 2]]}, {"op": "split", "person": 0, "frame": 2}, {"op": "swap", "people": [0, 1], "frames": [0, 0]}, {"op": "remove", "person": 1, "frames": [3, 3]}]
    got = at(identity.replay(p, log))
    assert got[0, 0] == 1 and got[0, 1] == 0 and got[1, 0] == 0 and got[2, 0] == 2 and got[3, 1] is None
    assert got[1, 2] is None  # of two rows of one person in a frame the first stays


def test_long_edit_log_is_cut(spark):
    p = persons(spark, [(f, d, d) for f in range(3) for d in range(2)])
    got = at(identity.replay(p, [{"op": "swap", "people": [0, 1], "frames": [0, 9]}] * 12, every=5))
    assert got[0, 0] == 0 and got[2, 1] == 1


def test_merge_groups_must_be_disjoint(spark):
    with pytest.raises(ValueError):
        identity.merge(persons(spark, [(0, 0, 0)]), [[0, 1], [1, 2]])


def test_linkage_needs_every_pair(spark):
    pairs = spark.createDataFrame([(0, 0, 1, 0.99), (0, 1, 2, 0.95), (0, 3, 4, 0.9)], "run long, a long, b long, p double")
    got = {r["tracklet"]: r["person"] for r in identity.complete_linkage(pairs, ["run"]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_logistic_fit_reaches_a_stationary_point(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=200) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "u double, v double, same int")
    m = identity.fit(df, ["u", "v"], "same")
    z = (x - x.mean(0)) / x.std(0)
    w = np.array([m["weights"]["u"], m["weights"]["v"]])
    p = 1 / (1 + np.exp(-(z @ w + m["bias"])))
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    assert np.abs((weight * (p - y)) @ z + w).max() < 1e-6
    assert identity.fit(df.where("same = 1"), ["u", "v"], "same")["status"] == "collecting"


def test_lasso_meets_its_conditions():
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 4))
    y = x @ [1.0, 0, 0.3, 0] + 0.1 * r.normal(size=60)
    g, b = x.T @ x / 60, x.T @ y / 60
    w = learning.lasso(g, b, 0.08)
    slack = b - g @ w
    assert all(abs(s - 0.08 * np.sign(a)) < 1e-5 if a else abs(s) <= 0.08 + 1e-5 for s, a in zip(slack, w, strict=True))


def test_sparse_fit_finds_the_features(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(100):
        x = r.normal(size=8)
        rows.append((f"run{k % 10}", int(x[0] + 0.8 * x[1] - x[2] + 0.6 * x[3] + 0.5 * x[4] > 0), *map(float, x)))
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame(rows, "run string, label int, " + ", ".join(f"{n} double" for n in names))
    m = learning.fit_sparse(df, names, "label", "run")
    assert m["status"] == "trained" and m["features"] == names[:5]
    scored = df.withColumns(learning.linear_score(m)).selectExpr("avg(CAST(predicted = label AS INT)) AS a").first()["a"]
    assert scored > 0.9


def test_folds_are_balanced(spark):
    c = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1), ("d", 1), ("e", 1), ("f", 1)], "run string, n long")
    assert {r["run"]: r["fold"] for r in learning.folds(c, "run", "n", 2).collect()} == {"b": 0, "a": 1, "c": 1, "d": 1, "e": 1, "f": 1}


def test_recurrent_gradients_and_training():
    r = np.random.default_rng(4)
    x, y = r.normal(size=(6, 4, 2)), np.array([0, 1, 0, 1, 1, 0])
    net = learning.Recurrent(2, 3)
    _, g = net.gradients(x, y, 1.5)
    for name in ("w", "u", "b", "o", "c"):
        flat, k = net.p[name].reshape(-1), 0
        old = flat[k]
        flat[k] = old + 1e-6
        up = net.gradients(x, y, 1.5)[0]
        flat[k] = old - 1e-6
        down = net.gradients(x, y, 1.5)[0]
        flat[k] = old
        assert abs((up - down) / 2e-6 - g[name].reshape(-1)[k]) < 1e-6
    x = r.normal(size=(64, 5, 1))
    y = (x.mean((1, 2)) > 0).astype(int)
    losses = learning.Recurrent(1, 8).train(x, y, epochs=40, rate=1e-2)
    assert losses[-1] < 0.6 * losses[0]


def test_spectral_features_of_a_sine(spark):
    rows = [(1, i, float(np.sin(2 * np.pi * 3 * i / 30))) for i in range(90)] + [(2, i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "track long, i long, value double")
    got = {r["track"]: r for r in features.spectral_features(df, ["track"], "i", "value", 30.0).collect()}
    assert abs(got[1]["dominant_hz"] - 3) < 0.01 and got[1]["spectral_flux"] < 0.1 and got[2]["dominant_hz"] is None


def test_registry_versions(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert reg.write("t", a) == 1
    assert reg.upsert("t", spark.createDataFrame([(2, "z")], "k long, v string"), ["k"]) == 2
    assert {r["k"]: r["v"] for r in reg.read("t").collect()} == {1: "x", 2: "z"}
    assert {r["k"]: r["v"] for r in reg.read("t", 1).collect()} == {1: "x", 2: "y"}
    reg.backup(str(tmp_path / "copy"))
    with pytest.raises(ValueError):
        reg.backup(str(tmp_path / "copy"))


def test_violations(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "id long, parent long")
    p = spark.createDataFrame([(1,), (2,)], "pid long")
    got = {r["rule"]: r["n"] for r in registry.violations(t, ["id"], p, "parent", "pid", "parent < 5").collect()}
    assert got == {"primary key": 1, "check": 1, "foreign key": 1}


def write_lines(path, rows):
    path.mkdir(parents=True)
    (path / "tracking.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")


def test_records_of_both_layouts(spark, tmp_path):
    write_lines(tmp_path / "r1", [{"frame": 0, "t": 0.0, "id_type": "track", "people": [{"id": 7, "keypoints": {"nose": [1.0, 2.0, 0.9]}, "extra": 1}]}, {"frame": 1, "t": 0.1, "people": []}])
    write_lines(tmp_path / "r2", [{"frame": 0, "t": 0.0, "poses": [{"landmarks": {"nose": [1.0, 2.0, 0.0, 0.8], "chin": [0, 0, 0, 1], "left_hip": [3.0, 4.0, 0.0, 0.1]}}]}])
    d = {r["run"]: r for r in records.detections(records.read(spark, str(tmp_path / "*"))).collect()}
    assert d["r1"]["id"] == 7 and d["r1"]["conf"] == 0.0 and d["r1"]["persistent"] and d["r1"]["joints"][0]["c"] == 0.9
    assert d["r2"]["id"] == 0 and d["r2"]["bbox"] == [1.0, 2.0, 1.0, 2.0] and not d["r2"]["persistent"] and d["r2"]["joints"][11]["c"] == 0.1
    write_lines(tmp_path / "bad" / "r3", [{"frame": 0, "t": 0.0}])
    with pytest.raises(Exception, match="neither people nor poses"):
        records.detections(records.read(spark, str(tmp_path / "bad" / "r3"))).collect()


def test_records_round_trip(spark, tmp_path):
    write_lines(tmp_path / "r1", [{"frame": f, "t": f / 30, "people": [{"id": k, "conf": 0.5, "bbox": [0.0, 0.0, 1.0, 1.0], "keypoints": {"nose": [1.0 * k, 2.0, 0.9]}} for k in range(2)]} for f in range(3)])
    d = records.detections(records.read(spark, str(tmp_path / "r1")))
    records.write_records(d, str(tmp_path / "out"))
    again = spark.read.schema("frame long, people array<struct<id: long, keypoints: map<string, array<double>>>>").json(str(tmp_path / "out"))
    assert sorted((r["frame"], [(p["id"], p["keypoints"]["nose"]) for p in r["people"]]) for r in again.collect()) == [(f, [(0, [0.0, 2.0, 0.9]), (1, [1.0, 2.0, 0.9])]) for f in range(3)]


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("track_id,label\n1,Dancer\n2, bystander\n1,no\n")
    assert {r["track_id"]: r["label"] for r in records.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {1: 0, 2: 0}
    (tmp_path / "m.csv").write_text("track_id,label\n1,perhaps\n")
    with pytest.raises(Exception, match="unknown label"):
        records.read_labels(spark, str(tmp_path / "m.csv")).collect()


def test_streamed_tracker_is_the_batch_tracker(spark, tmp_path):
    from tests.test_motion import placed, pose

    from cadenza.operators.tracking import bodies, track

    frames = {(d, f): placed(100 + 300 * d + 4 * f, 200, 40) for f in range(30) for d in range(2)}
    b = bodies(pose(spark, frames))
    want = {(r["frame"], r["det"]): r["tracklet"] for r in track(b).collect()}
    for k in range(3):
        b.selectExpr("CAST(run AS STRING) AS run", "frame", "det", "joints").where(f"frame BETWEEN {10 * k} AND {10 * k + 9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, frame long, det long, joints array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = track_stream(stream).writeStream.outputMode("append").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120), q.lastProgress
    finally:
        q.stop()
    got = {(r["frame"], r["det"]): r["tracklet"] for r in spark.table("tracked").collect()}
    assert got == want
