"""All features against their definitions written out in NumPy, and what the catalogue says."""

import math

import numpy as np
import pytest

from cadenza.operators import inventory, tracking

POSE = "run long, track long, frame long, t double, joint int, x double, y double, c double"


def by_definition(frames, times, pose):
    """pose: {frame: 17 x 3 array}; the features of one track."""
    n = len(frames)
    p = np.full((n, 17, 3), np.nan)
    for i, f in enumerate(frames):
        if f in pose:
            p[i] = pose[f]
    see = p[:, :, 2] >= 0.3
    xy = np.where(see[..., None], p[:, :, :2], np.nan)
    sho, hip = xy[:, [5, 6]].mean(1), xy[:, [11, 12]].mean(1)
    s = np.hypot(*(sho - hip).T)
    rate = 1 / np.median(np.diff(times))

    def speed(joints):
        out = np.full(n, np.nan)
        for i in range(1, n):
            d = [np.hypot(*(xy[i, j] - xy[i - 1, j])) for j in joints if see[i, j] and see[i - 1, j]]
            if d and np.isfinite(s[i] + s[i - 1]):
                out[i] = np.mean(d) / ((times[i] - times[i - 1]) * (s[i] + s[i - 1]) / 2)
        return out

    def fill(x):
        ok = np.isfinite(x)
        return np.interp(np.arange(n), np.flatnonzero(ok), x[ok]) if ok.sum() >= 4 else np.array([])

    def power(x):
        w = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
        return np.fft.rfftfreq(len(x), 1 / rate)[1:], w[1:]

    v = {}
    moves = {"pose_motion": speed(range(17)), "wrist_speed": speed([9, 10]), "limb_motion": speed([7, 8, 13, 14])}
    for name, sig in moves.items():
        x = fill(sig)
        if not len(x):
            continue
        c = x - x.mean()
        v |= {f"time_{name}_{k}": y for k, y in {
            "mean": x.mean(), "std": x.std(), "median": np.median(x), "iqr": np.percentile(x, 75) - np.percentile(x, 25), "p95": np.percentile(x, 95), "peak": x.max(), "active_fraction": np.mean(x > inventory.SPEEDS[name][1]),
            "trend": np.polyfit(np.arange(n), x, 1)[0], "autocorr_lag1": c[:-1] @ c[1:] / (c @ c), "zero_cross_rate": np.mean(np.diff(np.signbit(c)) != 0)}.items()}
        short = name.split("_")[0]
        if n >= 8:
            f, w = power(x)
            q = w / w.sum()
            m = (f * q).sum()
            v |= {f"freq_{short}_{k}": y for k, y in {
                "dominant_hz": f[np.argmax(w)], "centroid_hz": m, "bandwidth_hz": math.sqrt((((f - m) ** 2) * q).sum()), "entropy": -(q * np.log(q + 1e-12)).sum() / math.log(len(q)),
                "flatness": np.exp(np.mean(np.log(w + 1e-12))) / w.mean(), "low_band_ratio": w[(f >= 0.25) & (f < 1.5)].sum() / w.sum(), "high_band_ratio": w[(f >= 1.5) & (f <= 6)].sum() / w.sum()}.items()}
        if n >= 16:
            size = min(n, max(16, round(rate * 2)))
            cut = [x[a : a + size] for a in range(0, n - size + 1, max(4, size // 2))]
            e, shapes = [math.sqrt((y**2).mean()) for y in cut], [power(y) for y in cut]
            shapes = [(f, w / w.sum()) for f, w in shapes]
            cen, ent = [(f * q).sum() for f, q in shapes], [-(q * np.log(q + 1e-12)).sum() / math.log(len(q)) for _, q in shapes]
            flux = [np.linalg.norm(b[1] - a[1]) for a, b in zip(shapes, shapes[1:])]  # noqa: B905
            v |= {f"tf_{short}_{k}": y for k, y in {"energy_mean": np.mean(e), "energy_std": np.std(e), "centroid_mean_hz": np.mean(cen), "centroid_std_hz": np.std(cen), "entropy_mean": np.mean(ent), "entropy_std": np.std(ent), "spectral_flux": np.mean(flux) if flux else 0.0}.items()}
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        height = np.nanmean((hip[:, 1:2] - xy[:, [9, 10], 1]) / s[:, None], 1)
        pairs = [(5, 9), (6, 10), (11, 15), (12, 16)]
        ext = np.nanmean([np.hypot(*(xy[:, b] - xy[:, a]).T) / s for a, b in pairs], 0)
        ang = np.nanmean([np.where(np.isfinite(s), np.arctan2(*(xy[:, b] - xy[:, a])[:, ::-1].T), np.nan) for a, b in pairs], 0)
        compact = np.nanmean(np.hypot(*np.moveaxis(xy - hip[:, None], 2, 0)), 1) / s
        a = fill(ang)
        v |= {
            "physical_wrist_height_mean": np.nanmean(height), "physical_wrist_height_std": np.nanstd(height), "physical_limb_extension_mean": np.nanmean(ext), "physical_limb_extension_std": np.nanstd(ext),
            "physical_limb_angle_range_rad": np.ptp(np.unwrap(a)) if len(a) else np.nan, "physical_body_sway": np.nanstd(hip[:, 0] / s), "physical_vertical_bounce": np.nanstd(hip[:, 1] / s), "physical_pose_compactness": np.nanmean(compact),
            "physical_wrist_height_asymmetry": np.nanmean(np.abs(xy[:, 9, 1] - xy[:, 10, 1]) / s), "physical_step_width": np.nanmean(np.hypot(*(xy[:, 15] - xy[:, 16]).T) / s),
            "physical_shoulder_tilt_abs_deg": np.nanmean(np.where(np.isfinite(s), np.abs(np.degrees(np.arctan2(*(xy[:, 6] - xy[:, 5])[:, ::-1].T))), np.nan)),
        }
        w = fill(moves["wrist_speed"])
        if len(w) > 1:
            v["physical_wrist_acceleration_rms"] = math.sqrt(np.mean((np.diff(w) * rate) ** 2))
        v |= {"context_frames_present": len(pose), "context_track_duration_s": len(pose) / rate, "context_visible_frame_fraction": len(pose) / n, "context_mean_pose_confidence": np.nanmean(np.nanmean(np.where(see, p[:, :, 2], np.nan), 1))}
    return {k: x for k, x in v.items() if np.isfinite(x)}, xy


@pytest.mark.parametrize("n", [5, 12, 200])
def test_features_by_definition(spark, n):
    rng = np.random.default_rng(n)
    rows, poses = [], {}
    frames = list(range(100, 100 + 2 * n, 2))
    times = [f / 30 for f in frames]
    base = rng.uniform(-50, 50, (17, 2))
    base[[5, 6], 1], base[[11, 12], 1] = -60, 10
    for run in (0, 1):
        for track in range(2):
            own = {}
            for f, t in zip(frames, times, strict=True):
                if (rng.random() < 0.1 or track == 1 and f < frames[2]) and not (run, track) == (0, 0):
                    continue
                xy = base + 8 * np.sin(2 * np.pi * (1.5 + track) * t + np.arange(17))[:, None] + rng.normal(0, 1, (17, 2))
                own[f] = np.concatenate([xy, rng.uniform(0.25, 1, (17, 1))], 1)
            poses[run, track] = own
            rows += [(run, track, f, f / 30, j, *[float(v) for v in p[j]]) for f, p in own.items() for j in range(17)]
    got = {(r["run"], r["track"]): r["values"] for r in inventory.feature_values(spark.createDataFrame(rows, POSE)).collect()}
    for run in (0, 1):
        seen = sorted({f for (r, _), own in poses.items() if r == run for f in own})
        found = {k: by_definition(seen, [f / 30 for f in seen], own) for k, own in poses.items() if k[0] == run}
        right, low = (max(np.nanmax(xy[..., a]) for _, xy in found.values()) for a in (0, 1))
        for k, (want, xy) in found.items():
            x = np.nanmedian((np.nanmax(xy[..., 0], 1) + np.nanmin(xy[..., 0], 1)) / 2) / right
            y = np.nanmedian((np.nanmax(xy[..., 1], 1) + np.nanmin(xy[..., 1], 1)) / 2) / low
            want |= {"context_median_person_height_px": np.nanmedian(np.nanmax(xy[..., 1], 1) - np.nanmin(xy[..., 1], 1)), "context_median_x_fraction": x, "context_median_y_fraction": y, "context_center_distance": math.hypot(x - 0.5, y - 0.5) / math.sqrt(0.5)}
            known = {f["feature"] for f in inventory.catalogue()}
            want = {f: v for f, v in want.items() if f in known}
            assert set(got[k]) == set(want)
            for f, v in want.items():
                assert math.isclose(got[k][f], v, rel_tol=1e-6, abs_tol=1e-9), f


def test_catalogue_and_matrix(spark):
    c = inventory.catalogue()
    assert len({f["feature"] for f in c}) == len(c) == 60 and sum(f["eligible"] for f in c) == 52
    rows = [(0, 0, f, f / 30, j, float(j), float(j * f), 0.9) for f in range(3) for j in range(17)]
    df = spark.createDataFrame(rows, POSE)
    m = inventory.feature_matrix(inventory.feature_values(df, ["context_frames_present", "time_pose_motion_mean"]), ["context_frames_present", "time_pose_motion_mean"])
    assert [tuple(r) for r in m.collect()] == [(0, 0, 3.0, None)]
    with pytest.raises(ValueError):
        inventory.feature_values(df, ["no_such"])
    assert inventory.feature_values(df.limit(0)).collect() == []


def test_frame_assignment_is_the_best(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for frame in range(60):
        n, m = (int(k) for k in rng.integers(1, 5, 2))
        cost = {(a, b): float(rng.uniform(0, 3)) for a in range(n) for b in range(m) if rng.random() > 0.2}
        rows += [(0, frame, a, b, c) for (a, b), c in cost.items()] + [(0, frame, a, 9, None) for a in range(n)]
        best = (0, 0.0)
        for p in permutations(list(range(m)) + [-1] * n, n):
            made = [cost[a, b] for a, b in enumerate(p) if cost.get((a, b), 9) <= 2]
            best = min(best, (-len(made), sum(made)))
        want[frame] = best
    got = {}
    for r in tracking.frame_assignment(spark.createDataFrame(rows, "run long, frame long, a long, b long, cost double"), ["run", "frame"]).collect():
        got.setdefault(r["frame"], []).append(r)
    for frame, (pairs, total) in want.items():
        own = got.get(frame, [])
        assert len(own) == -pairs and math.isclose(sum(r["cost"] for r in own), total, abs_tol=1e-9)
        assert len({r["a"] for r in own}) == len({r["b"] for r in own}) == len(own) and all(r["cost"] <= 2 for r in own)
