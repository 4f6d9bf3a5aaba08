import math
import random

import numpy as np
import pytest

from cadenza.operators import series


def frame(spark, values, track=1):
    return spark.createDataFrame([(track, i, float(i), v) for i, v in enumerate(values)], "track long, i long, t double, value double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("width", [1, 2, 3, 9, 15])
def test_moving_mean_matches_loop(spark, width):
    r = random.Random(width)
    v = [None if r.random() < 0.3 else r.random() for _ in range(60)]
    got = column(series.moving_mean(frame(spark, v), ["track"], "i", "value", width, "m"), "m")
    h = width // 2
    for k, g in enumerate(got):
        near = [x for x in v[max(0, k - h) : k + h + 1] if x is not None]
        assert g is None if not near else math.isclose(g, sum(near) / len(near), abs_tol=1e-9)


def test_gap_lengths_and_short_fill(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    assert column(series.gap_lengths(frame(spark, v), ["track"], "i", "value"), "gap") == [1, 0, 2, 2, 0, 3, 3, 3, 0, 1]
    got = column(series.interpolate(frame(spark, v), ["track"], "i", "value", "f", 2), "f")
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, 8.0]
    assert column(series.interpolate(frame(spark, v), ["track"], "i", "value", "f"), "f")[5:8] == [5.0, 6.0, 7.0]


def test_series_with_one_value_is_left_alone(spark):
    v = [None, 3.0, None]
    assert column(series.smooth_gaps(frame(spark, v), ["track"], "i", "value", "f"), "f") == v


def test_islands_cut_only_beyond_the_gap(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 0.5, 1.1, 1.2)], "track long, t double")
    assert column(series.islands(df, ["track"], "t", 0.5), "island", "t") == [0, 0, 1, 1]


def test_separated_peaks_against_loop(spark):
    r = random.Random(3)
    v = [round(r.random(), 2) for _ in range(40)]
    kept = []
    for i in sorted(range(40), key=lambda i: (-v[i], i)):
        if len(kept) < 4 and all(abs(i - k) >= 5 for k in kept):
            kept.append(i)
    got = series.separated_peaks(frame(spark, v), ["track"], "t", "value", ["i"], 4, 5.0)
    assert column(got, "i", "rank") == kept
    assert column(series.separated_peaks(frame(spark, v), ["track"], "t", "value", ["i"], 4, 5.0, by_time=True), "i", "rank") == sorted(kept)


def test_separated_peaks_of_nothing(spark):
    assert series.separated_peaks(frame(spark, [None, None]), ["track"], "t", "value", ["i"]).count() == 0


def test_nearest_takes_the_earlier_of_two_as_near(spark):
    left = spark.createDataFrame([(1, 1, 2.0), (1, 2, 9.0), (2, 3, 1.0)], "track long, id long, t double")
    right = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0), (1, 8.5, 85.0)], "track long, t double, value double")
    got = {r["id"]: r["nearest"] for r in series.nearest(left, right, ["track"], "t", "value").collect()}
    assert got == {1: 10.0, 2: 85.0, 3: None}


def test_resample_against_numpy(spark):
    src = spark.createDataFrame([(1, float(t), float(t * t)) for t in range(5)] + [(1, 5.0, None)], "track long, t double, value double")
    at = [-1.0, 0.0, 0.25, 2.0, 3.5, 4.5, 6.0]
    times = spark.createDataFrame([(1, x) for x in at], "track long, t double")
    got = column(series.resample(src, times, ["track"], "t", "value", "v"), "v", "t")
    want = [None, 0.0, 0.25, 4.0, 12.5, None, None]
    assert got == want


def test_unwrap_against_numpy(spark):
    r = np.random.default_rng(0)
    a = np.angle(np.exp(1j * np.cumsum(r.normal(size=50) * 1.5)))
    got = column(series.unwrap(frame(spark, a.tolist()), ["track"], "i", "value", "u"), "u")
    assert np.allclose(got, np.unwrap(a))


def test_time_bins(spark):
    got = series.time_bins(frame(spark, [1.0, 3.0, 5.0, 7.0, 9.0]), ["track"], "i", "value", 3).orderBy("bin").collect()
    assert [(r["bin"], r["value"], r["rows"]) for r in got] == [(0, 2.0, 2), (1, 6.0, 2), (2, 9.0, 1)]
