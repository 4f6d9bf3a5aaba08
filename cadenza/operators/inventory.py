"""All features of a track in one pass, as a catalogue says.

The signals of every body are columns (speeds of groups of joints, and the
biomechanics of ``geometry``). A track is then one group: its signals are laid
on the run's frames, gaps are filled by straight lines, and every feature that
the catalogue names is computed from them. What can't be computed is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import geometry
from cadenza.operators.features import spectrum
from cadenza.schema import VISIBLE

# Joints of the speed signals, the speed from which one is active, and the features of each signal.
SPEEDS = {"pose_motion": (None, 0.15), "wrist_speed": ((9, 10), 0.15), "limb_motion": ((7, 8, 13, 14), 0.12)}
TIME = {
    "pose_motion": ("mean", "std", "median", "iqr", "p95", "peak", "active_fraction", "trend", "autocorr_lag1", "zero_cross_rate"),
    "wrist_speed": ("mean", "std", "p95", "active_fraction", "trend"),
    "limb_motion": ("mean", "std", "p95"),
}
FREQUENCY = {
    "pose": ("dominant_hz", "centroid_hz", "bandwidth_hz", "entropy", "flatness", "low_band_ratio", "high_band_ratio"),
    "wrist": ("dominant_hz", "centroid_hz", "entropy"),
    "limb": ("dominant_hz", "high_band_ratio"),
}
TIME_FREQUENCY = {
    "pose": ("energy_mean", "energy_std", "centroid_mean_hz", "centroid_std_hz", "entropy_mean", "entropy_std", "spectral_flux"),
    "wrist": ("energy_mean", "energy_std", "spectral_flux"),
}
PHYSICAL = (
    "wrist_height_mean", "wrist_height_std", "limb_extension_mean", "limb_extension_std", "limb_angle_range_rad", "body_sway", "vertical_bounce", "pose_compactness",
    "wrist_height_asymmetry", "step_width", "shoulder_tilt_abs_deg", "wrist_acceleration_rms",
)
CONTEXT = ("frames_present", "track_duration_s", "visible_frame_fraction", "mean_pose_confidence", "median_person_height_px", "median_x_fraction", "median_y_fraction", "center_distance")
LOW, HIGH = (0.25, 1.5), (1.5, 6.0)
SPEED_OF = {"pose": "pose_motion", "wrist": "wrist_speed", "limb": "limb_motion"}

BODY = geometry.BODY
SIGNALS = [*SPEEDS, "wrist_height", "wrist_asymmetry", "limb_extension", "limb_angle", "body_x", "body_y", "compactness", "step_width", "shoulder_tilt", "confidence"]
#: Columns of a body's box.
BOX = ["height", "box_x", "box_y"]


def catalogue() -> list[dict]:
    """feature, category, signal and whether a predictor may use it, in order."""
    out = []
    for category, prefix, table in (("time", "time", TIME), ("frequency", "freq", FREQUENCY), ("time-frequency", "tf", TIME_FREQUENCY)):
        out += [{"feature": f"{prefix}_{s}_{name}", "category": category, "signal": SPEED_OF.get(s, s), "eligible": True} for s, names in table.items() for name in names]
    out += [{"feature": f"physical_{n}", "category": "biomechanics", "signal": "geometry", "eligible": True} for n in PHYSICAL]
    return out + [{"feature": f"context_{n}", "category": "context", "signal": "observation", "eligible": False} for n in CONTEXT]


def signals(pose: DataFrame) -> DataFrame:
    """run, track, frame (place in the run's frames, from 0), n_frames, rate, edges and the signals of every body.

    ``rate``: one over the median step of the run's frames. The edges are those of the run's boxes, of seen joints.
    """
    frames = pose.groupBy("run", "frame").agg(F.max("t").alias("t"))
    w = Window.partitionBy("run").orderBy("frame")
    frames = frames.select("run", "frame", (F.row_number().over(w) - 1).cast("long").alias("_i"), (F.col("t") - F.lag("t").over(w)).alias("_d"))
    run = frames.groupBy("run").agg(F.count("*").alias("n_frames"), F.coalesce(F.try_divide(F.lit(1.0), F.median("_d")), F.lit(30.0)).alias("rate"))
    p = pose.join(frames.select("run", "frame", "_i"), ["run", "frame"]).withColumn("frame", F.col("_i")).drop("_i")
    out = geometry.biomechanics(p).drop("scale")
    for name, (joints, _) in SPEEDS.items():
        out = out.join(geometry.motion_speed(p, joints, name).select(*BODY, name), BODY, "left")
    xs, ys = (F.when(F.col("c") >= VISIBLE, F.col(k)) for k in "xy")
    box = p.groupBy(*BODY).agg((F.max(ys) - F.min(ys)).alias("height"), ((F.max(xs) + F.min(xs)) / 2).alias("box_x"), ((F.max(ys) + F.min(ys)) / 2).alias("box_y"), F.max(xs).alias("_right"), F.max(ys).alias("_low"))
    edges = box.groupBy("run").agg(F.max("_right").alias("width"), F.max("_low").alias("low"))
    return out.join(box.drop("_right", "_low"), BODY).join(run, "run").join(edges, "run")


def filled(x: np.ndarray) -> np.ndarray:
    """Straight lines over the gaps, the nearest value before the first and after the last; nothing with fewer than four values."""
    good = np.flatnonzero(np.isfinite(x))
    return np.interp(np.arange(len(x)), good, x[good]) if len(good) >= 4 else np.zeros(0)


def _shape(x: np.ndarray, active: float) -> dict[str, float]:
    if not len(x):
        return {}
    q25, q75, q95 = np.percentile(x, [25, 75, 95])
    c = x - x.mean()
    total, i = float(c @ c), np.arange(len(x)) - (len(x) - 1) / 2
    return {
        "mean": x.mean(), "std": x.std(), "median": np.median(x), "iqr": q75 - q25, "p95": q95, "peak": x.max(), "active_fraction": (x > active).mean(), "trend": float(i @ x) / float(i @ i),
        "autocorr_lag1": float(c[:-1] @ c[1:]) / total if total else 0.0, "zero_cross_rate": (np.diff(np.signbit(c)) != 0).mean(),
    }


def _share(freq: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, float, float]:
    p = power / power.sum()
    return p, float(freq @ p), float(-(p * np.log(p + 1e-12)).sum() / np.log(len(p)))


def _spectral(x: np.ndarray, rate: float) -> dict[str, float]:
    if len(x) < 8:
        return {}
    freq, power = spectrum(x, rate)
    if power.sum() <= 0:
        return {}
    p, centroid, entropy = _share(freq, power)
    return {
        "dominant_hz": freq[power.argmax()], "centroid_hz": centroid, "bandwidth_hz": np.sqrt(((freq - centroid) ** 2) @ p), "entropy": entropy, "flatness": np.exp(np.log(power + 1e-12).mean()) / power.mean(),
        "low_band_ratio": p[(freq >= LOW[0]) & (freq < LOW[1])].sum(), "high_band_ratio": p[(freq >= HIGH[0]) & (freq <= HIGH[1])].sum(),
    }


def _local(x: np.ndarray, rate: float) -> dict[str, float]:
    """Of windows of two seconds, half a window apart."""
    if len(x) < 16:
        return {}
    size = min(len(x), max(16, round(2 * rate)))
    cut = [x[s : s + size] for s in range(0, len(x) - size + 1, max(4, size // 2))]
    shapes = [_share(f, p) for f, p in (spectrum(c, rate) for c in cut) if p.sum() > 0]
    energy = np.array([np.sqrt((c**2).mean()) for c in cut])
    centroid, entropy = np.array([s[1] for s in shapes]), np.array([s[2] for s in shapes])
    moved = [np.linalg.norm(b[0] - a[0]) for a, b in zip(shapes[:-1], shapes[1:], strict=True)]
    out = {"energy_mean": energy.mean(), "energy_std": energy.std(), "spectral_flux": np.mean(moved) if moved else 0.0}
    if shapes:
        out |= {"centroid_mean_hz": centroid.mean(), "centroid_std_hz": centroid.std(), "entropy_mean": entropy.mean(), "entropy_std": entropy.std()}
    return out


def _finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def evaluate(s: dict[str, np.ndarray], at: np.ndarray, n_frames: int, rate: float, width: float, low: float) -> dict[str, float]:
    """All features of one track: s has the signals and the box of its bodies, at their places among the run's frames."""
    def laid(name: str) -> np.ndarray:
        out = np.full(n_frames, np.nan)
        out[at] = s[name]
        return out

    found: dict[str, float] = {}
    clean = {name: filled(laid(name)) for name in SPEEDS}
    for name in SPEEDS:
        found |= {f"time_{name}_{k}": v for k, v in _shape(clean[name], SPEEDS[name][1]).items()}
    for short, name in SPEED_OF.items():
        found |= {f"freq_{short}_{k}": v for k, v in _spectral(clean[name], rate).items()}
        found |= {f"tf_{short}_{k}": v for k, v in _local(clean[name], rate).items()}
    for name, signal, how in (
        ("wrist_height_mean", "wrist_height", np.mean), ("wrist_height_std", "wrist_height", np.std), ("limb_extension_mean", "limb_extension", np.mean), ("limb_extension_std", "limb_extension", np.std),
        ("body_sway", "body_x", np.std), ("vertical_bounce", "body_y", np.std), ("pose_compactness", "compactness", np.mean), ("wrist_height_asymmetry", "wrist_asymmetry", np.mean),
        ("step_width", "step_width", np.mean), ("shoulder_tilt_abs_deg", "shoulder_tilt", np.mean),
    ):
        x = _finite(s[signal])
        if len(x):
            found[f"physical_{name}"] = how(x)
    angle, wrist = filled(laid("limb_angle")), clean["wrist_speed"]
    if len(angle):
        found["physical_limb_angle_range_rad"] = np.ptp(np.unwrap(angle))
    if len(wrist) > 1:
        found["physical_wrist_acceleration_rms"] = np.sqrt(((np.diff(wrist) * rate) ** 2).mean())
    found |= {"context_frames_present": len(at), "context_track_duration_s": len(at) / rate, "context_visible_frame_fraction": len(at) / n_frames}
    if len(c := _finite(s["confidence"])):
        found["context_mean_pose_confidence"] = c.mean()
    if len(h := _finite(s["height"])):
        x, y = np.median(_finite(s["box_x"])) / width, np.median(_finite(s["box_y"])) / low
        found |= {"context_median_person_height_px": np.median(h), "context_median_x_fraction": x, "context_median_y_fraction": y, "context_center_distance": np.hypot(x - 0.5, y - 0.5) / np.sqrt(0.5)}
    return {k: float(v) for k, v in found.items() if np.isfinite(v)}


def feature_values(pose: DataFrame, features: list[str] | None = None) -> DataFrame:
    """run, track, values: a map of the catalogue's features, or of those asked for, of every track; what can't be computed isn't in it.

    A track of a run is one group, as long as the run at most. An unknown
    feature is an error.
    """
    known = [f["feature"] for f in catalogue()]
    wanted = known if features is None else features
    if odd := set(wanted) - set(known):
        raise ValueError(f"no such features: {sorted(odd)}")
    numbers = [*SIGNALS, *BOX]
    rows = signals(pose).select("run", "track", "frame", "n_frames", "rate", F.coalesce("width", F.lit(1.0)).alias("width"), F.coalesce("low", F.lit(1.0)).alias("low"), *numbers)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("run", "track")}

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        s = {c: table.column(c).cast(pa.float64()).to_numpy().astype(float) for c in numbers}
        first = table.slice(0, 1).to_pylist()[0]
        values = evaluate(s, table.column("frame").to_numpy(), first["n_frames"], first["rate"], first["width"], first["low"])
        return pa.table({"run": table.column("run").slice(0, 1), "track": table.column("track").slice(0, 1), "values": pa.array([[(k, values[k]) for k in wanted if k in values]], pa.map_(pa.string(), pa.float64()))})

    return rows.groupBy("run", "track").applyInArrow(one, f"run {kind['run']}, track {kind['track']}, values map<string,double>")


def feature_matrix(values: DataFrame, features: list[str]) -> DataFrame:
    """run, track and a column for each feature, null where it couldn't be computed."""
    return values.select("run", "track", *[F.try_element_at("values", F.lit(f)).alias(f) for f in features])
