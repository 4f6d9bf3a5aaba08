"""References against the recurrence value by value; distances and gates."""

import math

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import appearance

ROWS = "run long, track long, frame long, d array<array<double>>"


def step(now, new):
    if new is None:
        return now
    if now is None:
        return [list(r) if r is not None else None for r in new]
    out = []
    for a, b in zip(now, new, strict=True):
        if a is None or b is None:
            out.append(a if b is None else b)
        else:
            out.append([x if y is None else y if x is None else (9 * x + y) / 10 for x, y in zip(a, b, strict=True)])
    return out


def close(a, b):
    if a is None or b is None:
        return a is b
    return all((x is None and y is None) or (x is not None and y is not None and np.allclose(np.array(x, float), np.array(y, float), equal_nan=True)) for x, y in zip(a, b, strict=True))


def test_references_follow_the_frames(spark):
    rng = np.random.default_rng(1)
    rows = []
    for track in range(3):
        for frame in rng.permutation(20):
            regions = [None if rng.random() < 0.3 else [float(v) for v in rng.dirichlet(np.ones(4))] for _ in range(2)]
            rows.append((0, track, int(frame), None if rng.random() < 0.2 else regions))
    rows.append((0, 9, 0, None))
    got = {(r["track"], r["frame"]): r for r in appearance.references(spark.createDataFrame(rows, ROWS), ["run", "track"], "frame", "d").collect()}
    for track in {r[1] for r in rows}:
        now = None
        for _, _, frame, d in sorted((r for r in rows if r[1] == track), key=lambda r: r[2]):
            assert close(got[track, frame]["before"], now)
            now = step(now, d)
            assert close(got[track, frame]["reference"], now)


def test_distances_and_gates(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    rows = [(0, [p, None], [p, p]), (1, [p, q], [q, q]), (2, [None, p], [p, None]), (3, None, [p, p])]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {r["k"]: (r["d"], r["ok"]) for r in df.select("k", appearance.distance(F.col("a"), F.col("b")).alias("d"), appearance.passes(F.col("a"), F.col("b"), 0.3).alias("ok")).collect()}
    half = math.sqrt(1 - 0.5) / 2
    assert math.isclose(got[0][0], 0.0, abs_tol=1e-9) and got[0][1] and math.isclose(got[1][0], half) and not got[1][1]
    assert got[2] == (None, True) and got[3] == (None, True)
