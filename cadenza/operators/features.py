"""Features of series: order statistics, trends, spectra, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_features(df: DataFrame, keys: list[str], order: str, value: str, active: float) -> DataFrame:
    """mean, std, median, iqr, p95, peak, active_fraction, trend, autocorr_lag1, zero_cross_rate of each series' values, in order, nulls left out."""
    v = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    every = Window.partitionBy(*keys)
    v = v.withColumn("_i", F.row_number().over(w) - 1).withColumn("_d", F.col(value) - F.avg(value).over(every))
    # One ulp of the largest value is no deviation: a constant series has no variance.
    v = v.withColumn("_l", F.lag("_d").over(w)).withColumn("_c", F.when(F.lag("_d").over(w).isNotNull(), ((F.col("_d") < 0) != (F.lag("_d").over(w) < 0)).cast("double")))
    q = F.percentile(value, [0.25, 0.75])
    den = F.sum(F.col("_d") * F.col("_d"))
    return v.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.median(value).alias("median"),
        (q[1] - q[0]).alias("iqr"),
        F.percentile(value, 0.95).alias("p95"),
        F.max(value).alias("peak"),
        F.avg((F.col(value) > active).cast("double")).alias("active_fraction"),
        F.coalesce(F.regr_slope(value, F.col("_i")), F.lit(0.0)).alias("trend"),
        F.coalesce(F.sum(F.col("_d") * F.col("_l")) / F.nullif(den, F.lit(0.0)), F.lit(0.0)).alias("autocorr_lag1"),
        F.coalesce(F.avg("_c"), F.lit(0.0)).alias("zero_cross_rate"),
    )


def spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power of a series without its mean, under a Hann window, without the constant."""
    y = (x - x.mean()) * np.hanning(len(x))
    return np.fft.rfftfreq(len(x), 1 / fs)[1:], np.abs(np.fft.rfft(y))[1:] ** 2


def power_spectrum(df: DataFrame, keys: list[str], order: str, value: str, fs: float, points: int) -> DataFrame:
    """keys, w, k, freq, power of every stretch w of ``points`` values of each series: a Fourier sum as a join with its cosines and sines.

    Only whole stretches count. The join multiplies a series' rows by half a
    stretch's length, which pays for short fixed lengths only; a whole series
    as one spectrum goes through ``spectral_features``.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    v = df.where(F.col(value).isNotNull()).withColumn("_i", place).withColumn("w", F.floor(F.col("_i") / points)).withColumn("_i", F.col("_i") % points)
    every = Window.partitionBy(*keys, "w")
    v = v.withColumn("_n", F.count("*").over(every)).where(F.col("_n") == points)
    hann = 0.5 - 0.5 * F.cos(2 * np.pi * F.col("_i") / (points - 1))
    v = v.withColumn("_y", (F.col(value) - F.avg(value).over(every)) * hann)
    v = v.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(points // 2))))
    turn = 2 * np.pi * F.col("k") * F.col("_i") / points
    p = F.pow(F.sum(F.col("_y") * F.cos(turn)), 2) + F.pow(F.sum(F.col("_y") * F.sin(turn)), 2)
    return v.groupBy(*keys, "w", "k").agg(p.alias("power")).withColumn("freq", F.col("k") * fs / points)


def spectrum_statistics(power: DataFrame, keys: list[str], low: tuple = (0.25, 1.5), high: tuple = (1.5, 6.0)) -> DataFrame:
    """Dominant frequency, centroid, bandwidth, entropy, flatness and band shares of (freq, power) rows."""
    every = Window.partitionBy(*keys)
    p = power.withColumn("_p", F.try_divide("power", F.sum("power").over(every)))
    p = p.withColumn("_c", F.sum(F.col("freq") * F.col("_p")).over(every))
    f = F.col("freq")
    return p.groupBy(*keys).agg(
        F.max(F.struct("power", (-f).alias("o")))["o"].alias("_o"),
        F.max("_c").alias("centroid_hz"),
        F.sqrt(F.sum(F.pow(f - F.col("_c"), 2) * F.col("_p"))).alias("bandwidth_hz"),
        (-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-12)) / F.ln(F.count("*"))).alias("entropy"),
        (F.exp(F.avg(F.ln(F.col("power") + 1e-12))) / F.avg("power")).alias("flatness"),
        F.sum(F.when((f >= low[0]) & (f < low[1]), F.col("_p")).otherwise(0.0)).alias("low_band_ratio"),
        F.sum(F.when((f >= high[0]) & (f <= high[1]), F.col("_p")).otherwise(0.0)).alias("high_band_ratio"),
    ).withColumn("dominant_hz", -F.col("_o")).drop("_o")


SPECTRAL = ("dominant_hz", "centroid_hz", "bandwidth_hz", "entropy", "flatness", "energy_mean", "energy_std", "spectral_flux")


def _statistics(freq: np.ndarray, power: np.ndarray) -> tuple[float, float, float, float, float]:
    total = power.sum()
    if len(power) < 2 or total <= 0:
        return (np.nan,) * 5
    p = power / total
    centroid = float((freq * p).sum())
    return float(freq[power.argmax()]), centroid, float(np.sqrt(((freq - centroid) ** 2 * p).sum())), float(-(p * np.log(p + 1e-12)).sum() / np.log(len(p))), float(np.exp(np.log(power + 1e-12).mean()) / power.mean())


def spectral_features(df: DataFrame, keys: list[str], order: str, value: str, fs: float) -> DataFrame:
    """Spectrum statistics of whole series, and of their two-second windows; null with too few values (8, and 16 for windows).

    A series is one array, handed over in Arrow batches of series.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("p"))
    v = v.select(*keys, F.col(f"p.{value}").alias("xs"))
    kind = ", ".join([f"{k} {v.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in SPECTRAL])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for xs in b["xs"]:
                x = np.asarray(xs, float)
                stats = _statistics(*spectrum(x, fs)) if len(x) >= 8 else (np.nan,) * 5
                energy = flux = spread = np.nan
                if len(x) >= 16:
                    size = min(len(x), max(16, round(2 * fs)))
                    parts = [x[s : s + size] for s in range(0, len(x) - size + 1, max(4, size // 2))]
                    rms = np.array([np.sqrt((p**2).mean()) for p in parts])
                    shapes = [q / q.sum() if q.sum() > 0 else q for q in (spectrum(p, fs)[1] for p in parts)]
                    energy, spread = rms.mean(), rms.std()
                    flux = float(np.mean([np.linalg.norm(c - a) for a, c in zip(shapes[:-1], shapes[1:], strict=True)])) if len(shapes) > 1 else 0.0
                rows.append((*stats, energy, spread, flux))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=SPECTRAL, dtype=float)], axis=1)

    out = v.mapInPandas(run, kind)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in SPECTRAL})


def window_energy(df: DataFrame, keys: list[str], order: str, value: str, size: int, hop: int) -> DataFrame:
    """keys, w, energy: root mean square of windows of ``size`` values, every ``hop``; only whole windows."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = df.where(F.col(value).isNotNull()).withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / hop)).cast("long")
    v = v.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("_i") / hop).cast("long"))))
    return v.groupBy(*keys, "w").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("energy")).where(F.col("n") == size).drop("n")


def window_sequences(df: DataFrame, keys: list[str], time: str, value: str, length: float, count: int, width: float, hop: float, least: int, slack: float = 1e-6) -> DataFrame:
    """keys, step, n, mean: ``count`` windows of ``width`` every ``hop`` in the middle ``length`` of each series; null means under ``least`` values.

    Series shorter than ``length`` are left out. Windows are half-open; each
    row joins the few windows it is in by arithmetic, not by a range join.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).where(F.col("_hi") - F.col("_lo") >= length)
    j = df.join(span, keys).withColumn("_at", F.col(time) - F.col("_lo") - (F.col("_hi") - F.col("_lo") - length) / 2)
    steps = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    grid = span.select(*keys, steps.alias("step"))
    last = F.least(F.lit(count - 1), F.floor((F.col("_at") + slack) / hop)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("_at") + slack - width) / hop) + 1).cast("int")
    inside = j.where((last >= first) & (F.col("_at") >= -slack)).withColumn("step", F.explode(F.sequence(first, last)))
    agg = inside.groupBy(*keys, "step").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    out = grid.join(agg, [*keys, "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("mean", F.when(F.col("n") >= least, F.col("mean")))


def context(pose: DataFrame) -> DataFrame:
    """A track's frames, duration, share of frames, mean confidence, median height and place relative to the run's largest extent."""
    from cadenza.functions.columns import seen
    from cadenza.operators.geometry import person_center

    body = pose.groupBy("run", "track", "frame").agg(
        F.max("t").alias("t"), F.avg(F.when(seen(), F.col("c"))).alias("conf"), (F.max(F.when(seen(), F.col("y"))) - F.min(F.when(seen(), F.col("y")))).alias("height"), F.max(F.when(seen(), F.greatest(F.abs("x"), F.abs("y")))).alias("edge")
    )
    body = body.join(person_center(pose), ["run", "track", "frame"])
    run = body.groupBy("run").agg(F.countDistinct("frame").alias("_frames"), F.max("edge").alias("_edge"))
    g = body.groupBy("run", "track").agg(
        F.count("*").alias("frames_present"), (F.max("t") - F.min("t")).alias("span_s"), F.avg("conf").alias("mean_confidence"), F.median("height").alias("median_height"), F.median("cx").alias("_x"), F.median("cy").alias("_y")
    )
    return g.join(run, "run").select(
        "run", "track", "frames_present", "span_s", (F.col("frames_present") / F.col("_frames")).alias("visible_fraction"), "mean_confidence", "median_height", (F.col("_x") / F.col("_edge")).alias("median_x_fraction"), (F.col("_y") / F.col("_edge")).alias("median_y_fraction")
    )


def rates(frames: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Both estimates of a series' rate: (n - 1) over its span, 30 without one; and one over the median step."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = frames.withColumn("_d", F.col(time) - F.lag(time).over(w))
    span = F.max(time) - F.min(time)
    return d.groupBy(*keys).agg(F.coalesce((F.count("*") - 1) / F.nullif(span, F.lit(0.0)), F.lit(30.0)).alias("mean_rate"), F.try_divide(F.lit(1.0), F.median("_d")).alias("median_rate"))
