"""Tracking and stitching of long runs: the same as pair by pair, and no slower than the run is long."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from cadenza.operators import tracking
from cadenza.operators.tracking import NEIGHBOURS, STITCH_COST, STITCH_GAP, Tracker

BODIES = "run long, frame long, det long, joints array<double>"


def link(a, b, fps):
    """The cost of two groups over all their bodies."""
    if max(a["frame"][0], b["frame"][0]) <= min(a["frame"][-1], b["frame"][-1]):
        return math.inf
    first, second = (a, b) if a["frame"][0] < b["frame"][0] else (b, a)
    gap = np.abs(second["frame"][:, None] - first["frame"][None])
    i, j = np.unravel_index(np.argsort(gap, axis=None, kind="stable")[:NEIGHBOURS], gap.shape)
    gaps = gap[i, j]
    if gaps.min() > STITCH_GAP:
        return math.inf
    size = np.minimum(second["size"][i], first["size"][j])
    d = np.hypot(*(second["centre"][i] - first["centre"][j]).T) / size
    excess = np.nanmedian(np.maximum(0, d - (0.5 + gaps / fps))) if np.isfinite(d).any() else math.inf
    return float(excess + abs(math.log(np.median(second["size"][i] / first["size"][j]))) + 0.1 * np.median(gaps) / fps)


def all_pairs(tracklet, frame, centre, size, fps, least):
    def group(members):
        at = np.flatnonzero(np.isin(tracklet, members))
        return {"members": sorted(members), "rows": at, "frame": frame[at], "centre": centre[at], "size": size[at]}

    live = {int(k): group([int(k)]) for k in np.unique(tracklet)}
    costs = {(a, b): c for a in live for b in live if a < b and (c := link(live[a], live[b], fps)) <= STITCH_COST}
    while costs:
        (a, b), _ = min(costs.items(), key=lambda x: (x[1], x[0]))
        live[a] = group(live[a]["members"] + live.pop(b)["members"])
        costs = {k: v for k, v in costs.items() if not {a, b} & set(k)}
        costs |= {(min(a, o), max(a, o)): c for o in live if o != a and (c := link(live[a], live[o], fps)) <= STITCH_COST}
    ids = np.full(len(tracklet), -1)
    for n, g in enumerate(sorted((g for g in live.values() if len(g["rows"]) >= least), key=lambda g: (g["frame"][0], g["members"][0]))):
        ids[g["rows"]] = n
    return ids


def body(rng, x, y, s):
    p = rng.normal(0, s, (17, 3)) + [x, y, 0]
    p[:, 2] = rng.uniform(0.2, 1, 17)
    return p


def bodies(seed, frames, places, whole=0.8):
    """Bodies that shake about their places, some frames without some of them, some bodies without joints."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        for d in range(places):
            if rng.random() < whole:
                p = body(rng, d * 60 + rng.normal(0, 6), rng.normal(0, 6), rng.uniform(6, 18))
                rows.append((seed, f * (1 if f % 50 else 4), d, (p * np.nan if rng.random() < 0.02 else p).ravel().tolist()))
    return sorted({r[:3]: r for r in rows}.values(), key=lambda r: r[:3])


def test_batches_of_any_size_track_as_one_tracker(spark):
    rows = bodies(1, 60, 3) + bodies(2, 40, 2)
    want = []
    for run in (1, 2):
        t = Tracker()
        for f in sorted({r[1] for r in rows if r[0] == run}):
            now = [r for r in rows if r[:2] == (run, f)]
            want += [(*r[:3], i) for r, i in zip(now, t.step(f, [np.array(r[3]).reshape(17, 3) for r in now]), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = tracking.track(spark.createDataFrame(rows[::-1], BODIES)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(want) and len({w[3] for w in want}) > 5


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_stitches_as_over_all_pairs(spark, seed):
    df = spark.createDataFrame(bodies(seed, 120, 3), BODIES)
    tracked = tracking.track(df).toPandas()
    got = tracking.stitch(spark.createDataFrame(tracked), df, least=3).toPandas().sort_values(["frame", "det"])
    p = tracked.merge(df.toPandas(), on=["run", "frame", "det"]).sort_values(["frame", "det"])
    m = [Tracker.measure(np.array(j, float).reshape(17, 3)) for j in p.joints]
    want = all_pairs(p.tracklet.to_numpy(), p.frame.to_numpy(), np.array([x[0] for x in m]), np.array([x[1] for x in m]), 30.0, 3)
    assert got.track.fillna(-1).astype(int).tolist() == want.tolist()
    assert p.tracklet.nunique() > want.max() + 2 > 3


def test_a_long_run_is_not_all_its_pairs(spark):
    """4,000 tracklets of a body each: 8 million pairs, of which each meets those of 150 frames."""
    rng = np.random.default_rng(6)
    rows = [(1, f, 0, body(rng, rng.normal(0, 12), rng.normal(0, 12), 12).ravel().tolist()) for f in range(4000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "frame", "det", "joints"]), BODIES)
    began = time.time()
    got = tracking.stitch(df.selectExpr("run", "frame", "det", "frame AS tracklet"), df, least=1).toPandas()
    assert len(got) == 4000 and got.track.notna().all() and time.time() - began < 90
