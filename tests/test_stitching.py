"""Stitching in rounds against joining the cheapest pair of all first, run by run."""

import heapq
import math
from itertools import combinations

import numpy as np
import pytest

from cadenza.operators import stitching

DETS = "run long, frame long, det long, tracklet long, x double, y double, size double, extent double"


def group(rows):
    rows = sorted(rows)
    x = np.array([[np.nan if v is None else v for v in (r[2], r[3])] for r in rows], float)
    smooth = []
    for i in range(len(x)):
        with np.errstate(all="ignore"):
            part = x[max(0, i - 2) : i + 3]
            smooth.append(np.nanmean(part, 0) if np.isfinite(part).any() else [np.nan, np.nan])
    ext = np.array([np.nan if r[5] is None else r[5] for r in rows], float)
    return {"rows": rows, "f": np.array([r[0] for r in rows]), "c": np.array(smooth), "s": np.array([r[4] for r in rows], float), "e": ext}


def cost(a, b, fps, max_gap):
    if a["f"][-1] >= b["f"][0] and b["f"][-1] >= a["f"][0]:
        return math.inf
    pick = np.array([np.argmin(np.abs(a["f"] - f)) for f in b["f"]])
    gap = np.abs(b["f"] - a["f"][pick])
    sel = np.argsort(gap, kind="stable")[:8]
    if gap[sel].min() > max_gap:
        return math.inf
    size = np.minimum(a["s"][pick[sel]], b["s"][sel])
    e = np.minimum(a["e"][pick[sel]], b["e"][sel])
    size = np.where(np.isfinite(e), np.maximum(size, e / 4), size)
    d = np.hypot(*(a["c"][pick[sel]] - b["c"][sel]).T) / size
    if not np.isfinite(d).any():
        return math.inf
    out = np.nanmedian(np.maximum(0, d - (0.5 + gap[sel] / fps)))
    ratio = abs(math.log(np.median(b["s"]) / np.median(a["s"])))
    ea, eb = a["e"][np.isfinite(a["e"])], b["e"][np.isfinite(b["e"])]
    if len(ea) and len(eb):
        ratio = 0.2 * ratio + abs(math.log(np.median(eb) / np.median(ea)))
    return out + ratio + 0.1 * np.median(gap[sel]) / fps


def cheapest_first(dets, fps=30.0, max_gap=150, most=1.0, least=15):
    """The track of each tracklet, and whether no new group was nearer to a third than its parts had been."""
    of = {}
    for frame, det, t, x, y, s, e in dets:
        of.setdefault(t, []).append((frame, det, x, y, s, e))
    order = sorted(of, key=lambda t: (min(of[t])[0], t))
    live = {k: (group(of[t]), [t]) for k, t in enumerate(order)}
    heap, nxt, plain = [], len(live), True

    def push(i, j):
        c = cost(live[i][0], live[j][0], fps, max_gap)
        if c <= most:
            heapq.heappush(heap, (c, i, j))
        return c

    for i, j in combinations(sorted(live), 2):
        push(i, j)
    while heap:
        _, i, j = heapq.heappop(heap)
        if i in live and j in live:
            (a, m), (b, n) = live.pop(i), live.pop(j)
            live[nxt] = (group(a["rows"] + b["rows"]), m + n)
            for o in list(live):
                if o != nxt:
                    c = push(nxt, o)
                    plain &= not (c <= most and c < min(cost(a, live[o][0], fps, max_gap), cost(b, live[o][0], fps, max_gap)) - 1e-9)
            nxt += 1
    kept = sorted((g["f"][0], min(m, key=lambda t: min(of[t])), m) for g, m in live.values() if len(g["f"]) >= least)
    return {t: k for k, (_, _, m) in enumerate(kept) for t in m}, plain


def walkers(rng, people, boxes):
    """Fragments of people who walk, vanish and come back; tracklets are numbered as they begin."""
    rows, parts = [], []
    for p in range(people):
        x, y, v, s, frame = p * rng.uniform(60, 300), rng.uniform(0, 40), rng.uniform(-1, 1), rng.uniform(30, 60), int(rng.integers(0, 40))
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(2, 30))
            parts.append([(frame + i, x + v * i + rng.normal(0, 1), y + rng.normal(0, 1), s * rng.uniform(0.95, 1.05)) for i in range(n)])
            pause = int(rng.integers(1, 190))
            x, frame = x + v * (n + pause), frame + n + pause
    parts.sort(key=lambda p: p[0][0])
    for t, part in enumerate(parts):
        for frame, x, y, s in part:
            gone = rng.random() < 0.03
            rows.append((frame, t, None if gone else x, None if gone else y, s, s * 4 if boxes and rng.random() > 0.1 else None))
    return [(frame, t, t, x, y, s, e) for frame, t, x, y, s, e in rows]  # det: the tracklet, so no two in a frame


@pytest.mark.parametrize("boxes", [False, True])
def test_rounds_join_as_cheapest_first(spark, boxes):
    rng = np.random.default_rng(11 + boxes)
    data = {run: walkers(rng, int(rng.integers(1, 7)), boxes) for run in range(25)}
    df = spark.createDataFrame([(run, *r) for run, rows in data.items() for r in rows], DETS)
    got = {}
    for r in stitching.stitch(df).collect():
        got.setdefault(r["run"], {})[r["frame"], r["det"]] = r["track"]
    joined = same = 0
    for run, rows in data.items():
        want, plain = cheapest_first(rows)
        equal = got[run] == {(f, d): want.get(t) for f, d, t, *_ in rows}
        assert equal or not plain
        same += equal
        joined += len(want) - len(set(want.values()))
    assert joined > 20 and same >= 23


def test_what_must_hold(spark):
    """Nobody is twice in a frame, runs don't mix, short groups have no track, and a row keeps its place."""
    rng = np.random.default_rng(5)
    rows = [(run, *r) for run in (1, 2) for r in walkers(rng, 5, False)] + [(3, 0, 0, None, 1.0, 1.0, 40.0, None)]
    out = stitching.stitch(spark.createDataFrame(rows, DETS), least=10).collect()
    assert len(out) == len(rows) and [r["track"] for r in out if r["run"] == 3] == [None]
    seen, size = set(), {}
    for r in out:
        if r["track"] is not None:
            assert (r["run"], r["frame"], r["track"]) not in seen
            seen.add((r["run"], r["frame"], r["track"]))
            size[r["run"], r["track"]] = size.get((r["run"], r["track"]), 0) + 1
    assert min(size.values()) >= 10
    for run in (1, 2):
        assert sorted(t for q, t in size if q == run) == list(range(sum(q == run for q, _ in size)))


def test_nothing(spark):
    assert stitching.stitch(spark.createDataFrame([], DETS)).collect() == []
