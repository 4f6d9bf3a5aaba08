"""Steps that go over the same rows many times have them made once; rows that are settled aren't gone over again."""

import uuid

import numpy as np
import pandas as pd

from cadenza.operators import identity, stitching


def test_a_fit_makes_its_rows_once(spark, tmp_path):
    """Every time the rows are made a file is left, whatever the number of Newton steps."""

    def mark(batches):
        for pdf in batches:
            (tmp_path / uuid.uuid4().hex).touch()
            yield pdf

    r = np.random.default_rng(1)
    u = r.normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "same": (u + r.normal(size=100) > 0).astype(int)}), "u double, same int").coalesce(1)
    assert identity.fit(df.mapInPandas(mark, "u double, same int"), ["u"], "same")["status"] == "trained"
    assert len(list(tmp_path.iterdir())) == 1


def test_settled_runs_leave_the_rounds(spark, monkeypatch):
    """Forty runs of two tracklets settle in the first round; the one of sixteen goes on alone."""
    sizes = []
    joined = stitching._joined
    monkeypatch.setattr(stitching, "_joined", lambda merges, live, dets: sizes.append((live.count(), dets.count())) or joined(merges, live, dets))
    rows = [(run, 40 * k + i, 0, k, 0.0, 0.0, 40.0, None) for run, parts in [(0, 16), *[(r, 2) for r in range(1, 41)]] for k in range(parts) for i in range(3)]
    df = spark.createDataFrame(rows, "run long, frame long, det long, tracklet long, x double, y double, size double, extent double")
    got = stitching.link_groups(df).collect()
    assert {r["run"]: (len(r["members"]), r["n"]) for r in got} == {0: (16, 48)} | {r: (2, 6) for r in range(1, 41)} and len(got) == 41
    assert sizes[0] == (96, 288) and len(sizes) > 2 and all(n <= 16 and d == 48 for n, d in sizes[1:])
