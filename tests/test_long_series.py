"""Windows over long series: no frame reaches to the end, as Spark builds such a frame anew at every row."""

import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import selection, series


def plans(spark):
    s = spark.createDataFrame([("a", k, float(k), float(k) if k % 3 else None) for k in range(9)], "track string, i long, t double, v double")
    times = s.select("track", (F.col("t") + 0.5).alias("t"))
    return {
        "interpolate": series.interpolate(s, ["track"], "i", "v", "f"),
        "smooth_gaps": series.smooth_gaps(s, ["track"], "i", "v", "f"),
        "nearest": series.nearest(times, s.where("v IS NOT NULL"), ["track"], "t", "v"),
        "resample": series.resample(s, times, ["track"], "t", "v", "f"),
        "nearest_k": selection.nearest_k(times, s, ["track"], "t", "t"),
    }


@pytest.mark.parametrize("name", ["interpolate", "smooth_gaps", "nearest", "resample", "nearest_k"])
def test_no_frame_to_the_end(spark, name):
    frames = plans(spark)[name]._jdf.queryExecution().analyzed().toString().lower()
    assert "currentrow$(), unboundedfollowing" not in frames and "0, unboundedfollowing" not in frames
    assert "unboundedpreceding" in frames


def test_interpolate_fills_both_sides(spark):
    s = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, None), ("a", 5, 8.0), ("a", 6, None)], "track string, i long, v double")
    got = series.interpolate(s, ["track"], "i", "v", "f").orderBy("i").collect()
    assert [r["f"] for r in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_a_long_series_takes_no_square(spark):
    """200,000 rows in one series: a frame to the end reads 20 billion."""
    s = spark.range(200_000, numPartitions=1).select(F.lit("a").alias("track"), F.col("id").alias("i"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    began = time.time()
    got = series.interpolate(s, ["track"], "i", "v", "f").agg(F.sum("f").alias("f"), F.count("f").alias("n")).first()
    assert got["n"] == 200_000 and time.time() - began < 60
