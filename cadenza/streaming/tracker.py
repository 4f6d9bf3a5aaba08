"""The online tracker over a stream of records.

A run's state has the live tracks as a typed row each, the clock, and frames
that wait. Frames may come in any order within ``delay`` frames: a frame is
taken when one that is so much later has come, so the result doesn't depend on
how files were dealt over micro-batches. A frame without bodies (a null det)
moves the clock too. What comes for a frame that has been taken is late: it is
given out without a tracklet and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.tracking import Tracker

OUT = "run string, frame long, det long, tracklet long"
CLOCK = "taken long, newest long, next_id long"
TRACK = "id long, frame long, pose array<double>, centres array<double>, frames array<long>, sizes array<double>"
WAITING = "det long, joints array<double>"
NONE = -(1 << 62)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunTracker(StatefulProcessor):
    """One run's tracker. ``idle_ms``: after so long without rows everything that waits is taken, and the run is forgotten."""

    def __init__(self, delay: int, idle_ms: int | None):
        self.delay, self.idle_ms = delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.tracks = handle.getListState("tracks", TRACK)
        self.waiting = handle.getMapState("waiting", "frame long", f"bodies array<struct<{WAITING.replace('det long', 'det: bigint').replace('joints array', 'joints: array')}>>")

    def _load(self) -> tuple[Tracker, int, int]:
        taken, newest, next_id = self.clock.get() if self.clock.exists() else (NONE, NONE, 0)
        live = []
        for t in self.tracks.get() if self.tracks.exists() else ():
            live.append({"id": t[0], "frame": t[1], "pose": np.array(t[2], float).reshape(17, 3).tolist(), "centres": np.array(t[3], float).reshape(-1, 2).tolist(), "frames": list(t[4]), "sizes": list(t[5])})
        return Tracker(live, int(next_id)), int(taken), int(newest)

    def _save(self, tracker: Tracker, taken: int, newest: int) -> None:
        self.clock.update((taken, newest, int(tracker.next_id)))
        rows = [(int(t["id"]), int(t["frame"]), [float(v) for p in t["pose"] for v in p], [float(v) for c in t["centres"] for v in c], [int(f) for f in t["frames"]], [float(s) for s in t["sizes"]]) for t in tracker.tracks]
        if rows:
            self.tracks.put(rows)
        else:
            self.tracks.clear()

    def _take(self, key: tuple, tracker: Tracker, upto: int) -> tuple[list, int | None]:
        """Rows of the waiting frames up to one, in order, and the last of these frames."""
        rows, last = [], None
        for (frame,) in sorted(self.waiting.keys()):
            if frame > upto:
                break
            found = sorted((b for b in self.waiting.getValue((frame,))[0]), key=lambda b: b[0])
            ids = tracker.step(int(frame), [np.asarray(b[1], float).reshape(17, 3) for b in found])
            rows += [(key[0], int(frame), int(b[0]), int(i)) for b, i in zip(found, ids, strict=True)]
            self.waiting.removeKey((frame,))
            last = int(frame)
        return rows, last

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        tracker, taken, newest = self._load()
        late, new = [], {}
        for pdf in rows:
            for frame, det, joints in zip(pdf["frame"], pdf["det"], pdf["joints"], strict=True):
                newest = max(newest, int(frame))
                if frame > taken:
                    of = new.setdefault(int(frame), [])
                    if not pd.isna(det):
                        of.append((int(det), [float(v) for v in joints]))
                elif not pd.isna(det):
                    late.append((key[0], int(frame), int(det), None))
        for frame, found in new.items():
            old = [tuple(b) for b in self.waiting.getValue((frame,))[0]] if self.waiting.containsKey((frame,)) else []
            self.waiting.updateValue((frame,), ([*old, *found],))
        done, last = self._take(key, tracker, newest - self.delay)
        self._save(tracker, taken if last is None else last, newest)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame([*done, *late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tracker, _, newest = self._load()
        done, _ = self._take(key, tracker, newest)
        for state in (self.clock, self.tracks, self.waiting):
            state.clear()
        yield self._frame(done)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["run", "frame", "det", "tracklet"])
        return out.astype({"frame": "int64", "det": "int64", "tracklet": "Int64"})

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, delay: int = 0, idle_ms: int | None = None) -> DataFrame:
    """run, frame, det, tracklet of a stream of (run string, frame, det, joints array<double>).

    ``delay``: how many frames late a body may come; a run's last frames wait
    until a later one, an empty one for instance, or ``idle_ms``. A query with
    ``idle_ms`` has batches without data for ever, so it must be stopped. The
    session's state store must be RocksDB; it is set here if it isn't.
    """
    conf = detections.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = detections.select(F.col("run").cast("string").alias("run"), F.col("frame").cast("long").alias("frame"), F.col("det").cast("long").alias("det"), "joints")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("run").transformWithStateInPandas(RunTracker(delay, idle_ms), OUT, "append", mode)
