"""Tracks scored by several versions at once, against scores one by one; training that doesn't depend on how rows are dealt."""

import math

import numpy as np
import pytest

from cadenza.operators import prediction as p
from cadenza.operators.learning import CUT, Recurrent

VALUES = "run string, track long, values map<string,double>"
MODEL = [("v1", 0.5, 1, "a", 0.3, 1.0, 2.0, 4.0), ("v1", 0.5, 2, "b", -0.2, 0.0, 0.0, 0.0), ("v2", 0.1, 1, "b", 0.7, 5.0, 4.0, 2.0)]


def tables(spark):
    values = spark.createDataFrame([("r1", 1, {"a": 3.0, "b": 1.0}), ("r1", 2, {"b": math.nan}), ("r2", 1, {"a": 9.0, "b": 6.0}), ("r3", 1, {"a": 1.0}), ("r9", 1, {"a": 1.0})], VALUES)
    versions = spark.createDataFrame([("r1", "v1"), ("r2", "v2"), ("r3", "v1"), ("r9", "gone")], "run string, fingerprint string")
    return values, versions, spark.createDataFrame(MODEL, p.MODELS)


def test_linear_scores_by_version(spark):
    got = {(r["run"], r["track"]): r for r in p.predict(*tables(spark)).collect()}
    want = {("r1", 1): 0.5 + 0.3 * 0.25 - 0.2 * 1.0, ("r1", 2): 0.5 + 0.3 * -0.25, ("r2", 1): 0.1 + 0.7 * 1.0, ("r3", 1): 0.5 + 0.3 * -0.25}
    assert set(got) == set(want)
    for k, s in want.items():
        assert math.isclose(got[k]["score"], s) and got[k]["predicted"] == int(s >= CUT) and got[k]["method"] == "linear" and got[k]["probability"] is None
    first = got["r1", 1]["predictors"]
    assert [(x["rank"], x["feature"], x["raw"], x["direction"]) for x in first] == [(1, "a", 3.0, "more"), (2, "b", 1.0, "less")]
    assert got["r1", 2]["predictors"][1]["raw"] is None and got["r1", 2]["predictors"][1]["standardized"] == 0.0


def test_sequences_take_precedence(spark):
    nets = {"v1": Recurrent(2, 3, 1), "v2": Recurrent(1, 4, 2)}
    models = p.temporal_model(spark, "v1", p.packed(nets["v1"].p), 2, 3).union(p.temporal_model(spark, "v2", p.packed(nets["v2"].p), 1, 4))
    xs = {("r1", 1): [[1.0, 2.0], [0.5, None]], ("r2", 1): [[3.0], [1.0], [2.0]], ("r3", 1): [[1.0]]}  # the last has too few inputs
    seqs = spark.createDataFrame([(r, t, x) for (r, t), x in xs.items()], "run string, track long, xs array<array<double>>")
    got = {(r["run"], r["track"]): r for r in p.predict(*tables(spark), seqs, models).collect()}
    for k, name in ((("r1", 1), "v1"), (("r2", 1), "v2")):
        x = np.nan_to_num(np.array([[np.nan if v is None else v for v in s] for s in xs[k]], float))
        q = nets[name].forward(x[None])[0][0]
        assert math.isclose(got[k]["probability"], q) and got[k]["method"] == "sequence" and got[k]["predicted"] == int(q >= CUT)
    assert got["r3", 1]["method"] == got["r1", 2]["method"] == "linear"


def test_training_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(80):
        label = k % 3 == 0
        rows.append(([[float(v) for v in rng.normal(1.0 if label else -1.0, 1.0, 2)] for _ in range(4)], int(label)))
    rows.append(([[1.0]], 1))
    df = spark.createDataFrame(rows, "xs array<array<double>>, label int")
    one, losses = p.train_temporal(df.coalesce(1), 2, 4, epochs=12, rate=0.05)
    two, _ = p.train_temporal(df.repartition(5), 2, 4, epochs=12, rate=0.05)
    assert np.abs(one - two).max() < 1e-9 and losses[-1] < 0.7 * losses[0]
    net = Recurrent(2, 4)
    net.p = p.unpacked(one, net.p)
    right = [(net.forward(np.array(x)[None])[0][0] >= 0.5) == bool(y) for x, y in rows[:-1]]
    assert np.mean(right) > 0.9
    with pytest.raises(ValueError):
        p.train_temporal(df.where("label = 1"), 2)
