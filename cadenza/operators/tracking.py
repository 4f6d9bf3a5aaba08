"""Detections to tracks.

Costs are joins and aggregates. Assignment is inherently sequential within a
run: runs are the unit of parallelism, and a run's state is its live tracks.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import seen
from cadenza.operators.geometry import person_scale

# Fixed values of the tracker.
MAX_COST, MAX_GAP, LEAST_LENGTH, DUPLICATE = 2.0, 10, 15, 0.15
STITCH_GAP, STITCH_COST, NEIGHBOURS = 150, 1.0, 8


def pose_cost(pose: DataFrame) -> DataFrame:
    """run, frame, a, b, n, cost: mean distance over joints that both bodies of a frame show, in a's scale; from three shared joints on."""
    v = pose.where(seen()).select("run", "frame", "joint", F.col("track").alias("a"), "x", "y")
    o = v.select("run", "frame", "joint", F.col("a").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    j = v.join(o, ["run", "frame", "joint"]).where("a <> b")
    d = j.groupBy("run", "frame", "a", "b").agg(F.count("*").alias("n"), F.avg(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))).alias("d")).where("n >= 3")
    s = person_scale(pose).select("run", "frame", F.col("track").alias("a"), "scale")
    return d.join(s, ["run", "frame", "a"]).select("run", "frame", "a", "b", "n", (F.col("d") / F.col("scale")).alias("cost"))


def keep_best(cost: DataFrame, bodies: DataFrame, close: float = DUPLICATE) -> DataFrame:
    """run, frame, track, kept: of two bodies closer than ``close`` one goes, the lower by (n_visible, confidence), the later of equal ones.

    bodies: run, frame, track, n_visible, confidence. The pairs of a frame are
    folded in order, so that a body that has gone removes no other.
    """
    both = cost.groupBy("run", "frame", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.min("cost").alias("c")).where(F.col("c") < close)
    rank = bodies.select("run", "frame", "track", F.struct("n_visible", "confidence").alias("r"))
    p = both.join(rank.select("run", "frame", F.col("track").alias("i"), F.col("r").alias("ri")), ["run", "frame", "i"]).join(rank.select("run", "frame", F.col("track").alias("j"), F.col("r").alias("rj")), ["run", "frame", "j"])
    p = p.select("run", "frame", F.struct("i", "j", F.when(F.col("ri") < F.col("rj"), F.col("i")).otherwise(F.col("j")).alias("loser")).alias("p"))
    g = p.groupBy("run", "frame").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def fold(gone: Column, q: Column) -> Column:
        open_ = ~F.array_contains(gone, q["i"]) & ~F.array_contains(gone, q["j"])
        return F.when(open_, F.array_append(gone, q["loser"])).otherwise(gone)

    gone = g.select("run", "frame", F.explode(F.aggregate("ps", F.array().cast("array<bigint>"), fold)).alias("track")).withColumn("_gone", F.lit(True))
    return bodies.join(gone, ["run", "frame", "track"], "left").select("run", "frame", "track", F.col("_gone").isNull().alias("kept"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost over a matrix; pairs of infinite cost are not made.

    Shortest augmenting paths with potentials; for the some tens of bodies of a frame.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    finite = cost[np.isfinite(cost)]
    big = (finite.max() if len(finite) else 0.0) * (n + m + 1) + 1e6
    c = np.where(np.isfinite(cost), cost, big)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]] = now[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and np.isfinite(cost[match[j] - 1, j - 1]))


def frame_assignment(costs: DataFrame, keys: list[str], most: float = MAX_COST) -> DataFrame:
    """keys, a, b, cost: of each group's pairs (keys, a, b, cost) the one-to-one set that makes most pairs, of these the cheapest.

    keys: a run and a frame. Pairs over ``most`` and pairs of null cost are
    never made; a pair that comes twice counts with its lower cost. Of equally
    cheap sets one is taken, the same in every run. A group is the bodies of a
    frame; many groups go through one Arrow batch.
    """
    kept = costs.where(F.col("cost") <= most).groupBy(*keys, "a", "b").agg(F.min("cost").alias("cost"))
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b", "cost"))).alias("pairs"))
    kinds = ", ".join(f"{k} {costs.schema[k].dataType.simpleString()}" for k in keys)
    kind = ", ".join([kinds, *[f"{c} {costs.schema[c].dataType.simpleString()}" for c in ("a", "b")], "cost double"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, pairs in enumerate(batch.column("pairs").to_pylist()):
                left, right = (sorted({p[c] for p in pairs}) for c in "ab")
                at, to = {v: k for k, v in enumerate(left)}, {v: k for k, v in enumerate(right)}
                matrix = np.full((len(left), len(right)), np.inf)
                for p in pairs:
                    matrix[at[p["a"]], to[p["b"]]] = p["cost"]
                for r, c in assign(matrix):
                    of.append(i)
                    rows.append((left[r], right[c], float(matrix[r, c])))
            own = batch.select(keys).take(pa.array(of, pa.int64()))
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field("pairs").type.value_type.field("a").type, batch.schema.field("pairs").type.value_type.field("b").type, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *new], [*keys, "a", "b", "cost"])

    return grouped.mapInArrow(solve, kind)


class Tracker:
    """The live tracks of one run. ``step`` takes a frame's bodies (17 x 3 arrays, absent joints NaN) and gives each an id.

    A body may continue a track of up to MAX_GAP frames ago if it is near the
    place that the track's recent motion leads to and of similar size.
    """

    def __init__(self, tracks: list[dict] | None = None, next_id: int = 0):
        self.tracks, self.next_id = tracks or [], next_id

    @staticmethod
    def measure(pose: np.ndarray) -> tuple[np.ndarray, float]:
        ok = np.isfinite(pose[:, 0]) & (pose[:, 2] >= 0.3)
        xy = np.where(ok[:, None], pose[:, :2], np.nan)
        if ok[[5, 6, 11, 12]].all():
            size = float(np.hypot(*(xy[[5, 6]].mean(0) - xy[[11, 12]].mean(0))))
        elif ok.sum() >= 2:
            size = 0.4 * float(np.hypot(*(np.nanmax(xy, 0) - np.nanmin(xy, 0))))
        else:
            size = 1.0
        hips = ok[[11, 12]]
        centre = xy[[11, 12]][hips].mean(0) if hips.any() else (xy[ok].mean(0) if ok.any() else np.full(2, np.nan))
        return centre, max(1.0, size)

    @staticmethod
    def recall(track: dict) -> dict:
        """What a track's last places say, kept until its next body: its last pose and place, its speed and its usual size."""
        if track.get("of") != track["frame"]:
            centres, frames = np.array(track["centres"]), np.array(track["frames"])
            speed = np.median(np.diff(centres, axis=0) / np.diff(frames)[:, None], axis=0) if len(frames) > 1 else np.zeros(2)
            track |= {"of": track["frame"], "last": np.array(track["pose"]), "centre": centres[-1], "speed": speed, "usual": float(np.median(track["sizes"]))}
        return track

    def costs(self, poses: list[np.ndarray], seen_: list[tuple[np.ndarray, float]], frame: int) -> np.ndarray:
        """The cost of every body for every track. Distances are taken at once; the rest only of pairs near enough."""
        out = np.full((len(poses), len(self.tracks)), math.inf)
        if not out.size:
            return out
        known = [self.recall(t) for t in self.tracks]
        gap = frame - np.array([t["frame"] for t in known])
        moved = np.stack([t["speed"] for t in known]) * gap[:, None]
        off = np.stack([m[0] for m in seen_])[:, None] - np.stack([t["centre"] for t in known])[None] - moved[None]
        far = np.hypot(off[..., 0], off[..., 1]) / np.array([t["usual"] for t in known])[None]
        with np.errstate(invalid="ignore"):
            near = far <= np.minimum(MAX_COST, 0.8 + 0.1 * (gap - 1))[None]
        for k, i in zip(*np.nonzero(near), strict=True):
            out[k, i] = self.cost(known[i], poses[k], *seen_[k], int(gap[i]), float(far[k, i]))
        return out

    @staticmethod
    def cost(track: dict, pose: np.ndarray, centre: np.ndarray, size: float, gap: int, d: float) -> float:
        usual, last = track["usual"], track["last"]
        ratio = abs(math.log(size / usual))
        if ratio > math.log(2.5):
            return math.inf
        shared = (pose[:, 2] >= 0.3) & (last[:, 2] >= 0.3) & np.isfinite(pose[:, 0]) & np.isfinite(last[:, 0])
        if shared.sum() < 3:
            return math.inf
        moved = (pose[shared, :2] - centre) - (last[shared, :2] - track["centre"])
        return d + 0.15 * float(np.hypot(moved[:, 0], moved[:, 1]).mean()) / usual + 0.5 * ratio + 0.03 * (gap - 1)

    def step(self, frame: int, poses: list[np.ndarray]) -> list[int]:
        self.tracks = [t for t in self.tracks if frame - t["frame"] <= MAX_GAP]
        seen_ = [self.measure(p) for p in poses]
        matrix = self.costs(poses, seen_, frame)
        # Bodies and tracks that no pair is possible with take no part in the assignment.
        rows, columns = (np.flatnonzero(np.isfinite(matrix).any(axis)) for axis in (1, 0))
        chosen = {int(rows[r]): int(columns[c]) for r, c in assign(matrix[np.ix_(rows, columns)])}
        ids = []
        for k, (pose, (centre, size)) in enumerate(zip(poses, seen_, strict=True)):
            if k in chosen:
                t = self.tracks[chosen[k]]
            else:
                t = {"id": self.next_id, "centres": [], "frames": [], "sizes": []}
                self.next_id += 1
                self.tracks.append(t)
            t |= {"pose": pose.tolist(), "frame": frame}
            for name, x in (("centres", centre.tolist()), ("frames", frame), ("sizes", size)):
                t[name] = [*t[name], x][-5:]
            ids.append(t["id"])
        return ids


def bodies(pose: DataFrame) -> DataFrame:
    """run, frame, det, joints array<double> (17 x 3 in a row): one row a body, absent joints as NaN."""
    p = pose.groupBy("run", "frame", F.col("track").alias("det")).agg(F.map_from_entries(F.collect_list(F.struct("joint", F.array("x", "y", "c")))).alias("m"))
    nan = F.array(*[F.lit(float("nan"))] * 3)
    return p.select("run", "frame", "det", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.coalesce(F.try_element_at("m", j), nan))).alias("joints"))


def _joints(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's joints as bodies x 17 x 3, nulls as NaN."""
    return np.asarray(batch.column("joints").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 17, 3)


def track(detections: DataFrame) -> DataFrame:
    """run, frame, det, tracklet: the online tracker over each run's frames in order. detections: as ``bodies``.

    Runs are dealt over tasks, and a task reads its runs' bodies in order: it holds
    a frame and the live tracks, not a run.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, of = Tracker(), None
        kept: list[tuple] = []  # bodies of the frame that is being read

        def frame_done() -> list[tuple]:
            ids = t.step(kept[0][1], [b[3] for b in kept]) if kept else []
            out = [(*b[:3], i) for b, i in zip(kept, ids, strict=True)]
            kept.clear()
            return out

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["run", "frame", "det", "tracklet"])

        for batch in batches:
            rows = []
            for run, frame, det, pose in zip(*(batch.column(c).to_pylist() for c in ("run", "frame", "det")), _joints(batch), strict=True):
                if kept and kept[0][:2] != (run, frame):
                    rows += frame_done()
                if run != of:
                    t, of = Tracker(), run
                kept.append((run, frame, det, pose))
            yield packed(rows)
        yield packed(frame_done())

    cols = [F.col(c).cast("long").alias(c) for c in ("run", "frame", "det")]
    ordered = detections.select(*cols, "joints").repartition("run").sortWithinPartitions("run", "frame", "det")
    return ordered.mapInArrow(follow, "run long, frame long, det long, tracklet long")


class _Ends:
    """Groups of one run's bodies by what links look at: each one's first and last ``NEIGHBOURS`` bodies, in order. Of all pairs of bodies of two groups the nearest in time are among these."""

    def __init__(self, most: int):
        self.first, self.last, self.n, self.label = (np.zeros(most, np.int64) for _ in range(4))
        # frame, x, y, size by place; absent places are after the head's and before the tail's.
        self.head, self.tail = np.full((most, NEIGHBOURS, 4), np.nan), np.full((most, NEIGHBOURS, 4), np.nan)
        self.head[..., 0], self.tail[..., 0] = np.inf, -np.inf
        self.box = np.full((most, 2, 6), np.nan)  # of head and tail: least and most x and y, largest size, frame farthest inside

    def put(self, g: int, label: int, n: int, head: np.ndarray, tail: np.ndarray) -> None:
        self.label[g], self.n[g], self.first[g], self.last[g] = label, n, head[0, 0], tail[-1, 0]
        self.head[g, : len(head)], self.tail[g, NEIGHBOURS - len(tail) :] = head, tail
        for k, (end, inside) in enumerate(((head, head[-1, 0]), (tail, tail[0, 0]))):
            at = end[np.isfinite(end[:, 1])]
            if len(at):
                self.box[g, k] = [at[:, 1].min(), at[:, 1].max(), at[:, 2].min(), at[:, 2].max(), at[:, 3].max(), inside]

    def merged(self, g: int, early: int, late: int) -> None:
        def own(end: np.ndarray) -> np.ndarray:
            return end[np.isfinite(end[:, 0])]

        head = np.concatenate([own(self.head[early]), own(self.head[late])])[:NEIGHBOURS]
        tail = np.concatenate([own(self.tail[early]), own(self.tail[late])])[-NEIGHBOURS:]
        self.put(g, int(min(self.label[early], self.label[late])), int(self.n[early] + self.n[late]), head, tail)

    def near(self, early: np.ndarray, late: np.ndarray, fps: float) -> np.ndarray:
        """Which pairs may cost STITCH_COST at most: no two of their bodies are nearer than the boxes of the ends, nor is a pause longer than from end to end."""
        a, b = self.box[early, 1], self.box[late, 0]
        dx = np.maximum(0, np.maximum(a[:, 0] - b[:, 1], b[:, 0] - a[:, 1]))
        dy = np.maximum(0, np.maximum(a[:, 2] - b[:, 3], b[:, 2] - a[:, 3]))
        reach = np.minimum(a[:, 4], b[:, 4]) * (STITCH_COST + 0.5 + (b[:, 5] - a[:, 5]) / fps)
        return np.maximum(dx, dy) <= reach * (1 + 1e-9)

    def costs(self, early: np.ndarray, late: np.ndarray, fps: float) -> np.ndarray:
        """Cost of joining groups of which one ends before the other begins: how far apart they are beyond what the pause allows, their sizes' ratio, and the pause. Over STITCH_COST it is infinite."""
        out = np.full(len(early), np.inf)
        kept = np.flatnonzero((self.first[late] - self.last[early] <= STITCH_GAP) & self.near(early, late, fps))
        if not len(kept):
            return out
        a, b = self.tail[early[kept]], self.head[late[kept]]
        gap = (b[:, :, None, 0] - a[:, None, :, 0]).reshape(len(kept), -1)
        at = np.argsort(gap, axis=1, kind="stable")[:, :NEIGHBOURS]
        gaps = np.take_along_axis(gap, at, 1)
        gaps[np.isinf(gaps)] = np.nan
        row = np.arange(len(kept))[:, None]
        p, q = b[row, at // NEIGHBOURS], a[row, at % NEIGHBOURS]
        d = np.hypot(p[..., 1] - q[..., 1], p[..., 2] - q[..., 2]) / np.minimum(p[..., 3], q[..., 3])
        excess = _medians(np.maximum(0, d - (0.5 + gaps / fps)))
        pause = 0.1 * _medians(gaps) / fps
        ratio = _medians(p[..., 3] / q[..., 3])
        for k in np.flatnonzero(excess + pause <= STITCH_COST * (1 + 1e-9)):
            cost = float(excess[k] + abs(math.log(ratio[k])) + pause[k])
            if cost <= STITCH_COST:
                out[kept[k]] = cost
        return out


def _medians(values: np.ndarray) -> np.ndarray:
    """Each row's median without its NaN, NaN if it has nothing else."""
    s, n = np.sort(values, axis=1), (~np.isnan(values)).sum(1)
    row = np.arange(len(s))
    return np.where(n > 0, (s[row, np.maximum(n - 1, 0) // 2] + s[row, np.minimum(n // 2, s.shape[1] - 1)]) / 2, np.nan)


def _greedy(tracklet: np.ndarray, frame: np.ndarray, measured: np.ndarray, fps: float, block: int = 500) -> tuple[np.ndarray, _Ends, np.ndarray]:
    """The group of each body (rows in order of frame) when the cheapest pair of all is joined first; the groups; which of them are left.

    A pair is costed once, when the later of its groups is made, and only if its
    pause allows it. A group keeps its pairs with earlier ones while it lives, so
    there are some tens a tracklet, not all pairs.
    """
    order = np.argsort(tracklet, kind="stable")
    labels, begins = np.unique(tracklet[order], return_index=True)
    parts = np.split(order, begins[1:])
    n = len(labels)
    ends = _Ends(2 * n)
    rows = np.column_stack([frame.astype(float), measured])
    by_first = sorted(range(n), key=lambda k: (frame[parts[k][0]], labels[k]))
    of = np.zeros(len(tracklet), np.int64)
    for g, k in enumerate(by_first):
        of[parts[k]] = g
        ends.put(g, int(labels[k]), len(parts[k]), rows[parts[k][:NEIGHBOURS]], rows[parts[k][-NEIGHBOURS:]])
    lo, hi = (np.searchsorted(ends.first[:n], ends.last[:n] + x, "right") for x in (0, STITCH_GAP))
    found = []
    for i in range(0, n, block):
        size = (hi - lo)[i : i + block]
        early = np.repeat(np.arange(i, min(n, i + block)), size)
        late = np.arange(len(early)) - np.repeat(np.cumsum(size) - size, size) + lo[early]
        c = ends.costs(early, late, fps)
        kept = np.isfinite(c)
        found.append((c[kept], early[kept], late[kept]))
    cost, early, late = (np.concatenate([f[k] for f in found]) for k in range(3))
    pair = np.sort(np.stack([ends.label[early], ends.label[late]]), axis=0)
    first = np.lexsort((pair[1], pair[0], cost))
    cost, early, late, pair = cost[first], early[first], late[first], pair[:, first]
    alive, parent = np.zeros(2 * n, bool), np.arange(2 * n)
    alive[:n] = True
    starts: dict[int, list[int]] = defaultdict(list)
    stops: dict[int, list[int]] = defaultdict(list)
    for g in range(n):
        starts[int(ends.first[g])].append(g)
        stops[int(ends.last[g])].append(g)
    heap: list[tuple] = []
    own: dict[int, list[tuple]] = {}  # a made group's pairs with groups before it, the cheapest last
    at, made = 0, n

    def offer(g: int) -> None:
        pairs = own.get(g, [])
        while pairs and not alive[pairs[-1][3]]:
            pairs.pop()
        if pairs:
            heapq.heappush(heap, (*pairs.pop(), g))

    while True:
        while at < len(cost) and not (alive[early[at]] and alive[late[at]]):
            at += 1
        while heap and not (alive[heap[0][3]] and alive[heap[0][4]]):
            *_, g = heapq.heappop(heap)
            if alive[g]:
                offer(g)
        if at < len(cost) and (not heap or (cost[at], pair[0, at], pair[1, at]) < heap[0][:3]):
            x, y = int(early[at]), int(late[at])
        elif heap:
            x, y = heap[0][3:]
        else:
            break
        if ends.first[x] > ends.first[y]:
            x, y = y, x
        g, made = made, made + 1
        ends.merged(g, x, y)
        for o in (x, y):
            alive[o], parent[o] = False, g
            own.pop(o, None)
            starts[int(ends.first[o])].remove(o)
            stops[int(ends.last[o])].remove(o)
        alive[g] = True
        a, b = int(ends.first[g]), int(ends.last[g])
        before = np.array([o for f in range(a - STITCH_GAP, a) for o in stops.get(f, ())], np.int64)
        after = np.array([o for f in range(b + 1, b + STITCH_GAP + 1) for o in starts.get(f, ())], np.int64)
        starts[a].append(g)
        stops[b].append(g)
        others, me = np.concatenate([before, after]), np.full(len(before) + len(after), g)
        c = ends.costs(np.concatenate([before, me[len(before) :]]), np.concatenate([me[: len(before)], after]), fps)
        label = int(ends.label[g])
        own[g] = sorted(((float(c[k]), min(label, int(ends.label[others[k]])), max(label, int(ends.label[others[k]])), int(others[k])) for k in np.flatnonzero(np.isfinite(c))), reverse=True)
        offer(g)
    for g in range(made - 1, -1, -1):
        parent[g] = parent[parent[g]]
    return parent[of], ends, np.flatnonzero(alive)


def stitch(tracked: DataFrame, detections: DataFrame, fps: float = 30.0, least: int = LEAST_LENGTH) -> DataFrame:
    """run, frame, det, track: tracklets joined across pauses, the cheapest pair first; groups of fewer than ``least`` bodies are null.

    Groups are numbered by first frame, then first tracklet. Bodies are measured
    wherever they are; a run's task has a row of seven numbers a body.
    """
    joined = tracked.join(detections, ["run", "frame", "det"]).select("run", "frame", "det", "tracklet", "joints")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [Tracker.measure(p) for p in _joints(batch)]
            new = [pa.array([v[0][0] for v in m], pa.float64()), pa.array([v[0][1] for v in m], pa.float64()), pa.array([v[1] for v in m], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], ["run", "frame", "det", "tracklet", "x", "y", "size"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "det"]).reset_index(drop=True)
        of, groups, left = _greedy(pdf.tracklet.to_numpy(), pdf.frame.to_numpy(), pdf[["x", "y", "size"]].to_numpy(float), fps)
        kept = sorted((g for g in left if groups.n[g] >= least), key=lambda g: (groups.first[g], groups.label[g]))
        number = np.full(len(groups.n), -1)
        number[kept] = np.arange(len(kept))
        return pdf[["run", "frame", "det"]].assign(track=number[of])

    kind = "run long, frame long, det long, tracklet long, x double, y double, size double"
    out = joined.mapInArrow(measure, kind).groupBy("run").applyInPandas(run, "run long, frame long, det long, track long")
    return out.withColumn("track", F.when(F.col("track") >= 0, F.col("track")))


def link_candidates(tracklets: DataFrame, keys: list[str], within: float, cost: float) -> DataFrame:
    """Pairs of a group's tracklets of which one begins at most ``within`` after the other's end: a, b, gap, cost <= the bound.

    tracklets: keys, tracklet, t0, t1, centre. Times are cut into ranges of
    ``within``, so the join is by range and the one after instead of all pairs.
    """
    a = tracklets.select(*keys, F.col("tracklet").alias("a"), F.col("t1").alias("_end"), F.col("centre").alias("ca"), F.floor(F.col("t1") / within).alias("_r"))
    b = tracklets.select(*keys, F.col("tracklet").alias("b"), F.col("t0").alias("_begin"), F.col("centre").alias("cb"), F.explode(F.array(F.floor(F.col("t0") / within), F.floor(F.col("t0") / within) - 1)).alias("_r"))
    j = a.join(b, [*keys, "_r"]).withColumn("gap", F.col("_begin") - F.col("_end")).where((F.col("gap") > 0) & (F.col("gap") <= within))
    c = F.abs(F.col("ca") - F.col("cb")) / 100 + 0.1 * F.col("gap") / within
    return j.withColumn("cost", c).where(F.col("cost") <= cost).select(*keys, "a", "b", "gap", "cost")


def best_duplicate(detections: DataFrame, keys: list[str], confidence: str, order: str) -> DataFrame:
    """All rows with kept: whether it is its group's row of the highest confidence, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence), order)
    return detections.withColumn("kept", F.row_number().over(w) == 1)


def source_tracks(detections: DataFrame, run: list[str], frame: str, ident: str) -> DataFrame:
    """Ids of a source, renumbered from 0 in order of their first frame, then id."""
    first = detections.groupBy(*run, ident).agg(F.min(frame).alias("_first"))
    w = Window.partitionBy(*run).orderBy("_first", ident)
    return first.select(*run, ident, (F.row_number().over(w) - 1).cast("long").alias("track"))

