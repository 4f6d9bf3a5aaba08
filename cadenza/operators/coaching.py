"""Scores, feedback and events for a group's bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import similarity
from cadenza.operators.series import separated_peaks
from cadenza.schema import JOINTS, REGION_OF

LEAST_JOINTS, NOTICE = 6, 0.15
ORDER = ("head", "arms", "torso", "legs")


def region(joint: str = "joint") -> Column:
    """A joint's region."""
    return F.element_at(F.create_map(*[F.lit(x) for j, r in REGION_OF.items() for x in (j, r)]), F.col(joint))


def comparable(dev: DataFrame, norm: DataFrame) -> DataFrame:
    """dev's rows that count: the joint is seen, and at that frame on another track as well."""
    w = Window.partitionBy("run", "frame", "joint")
    both = norm.where(F.col("nx").isNotNull()).withColumn("_n", F.count("*").over(w)).where("_n >= 2")
    return dev.where(F.col("deviation").isNotNull()).join(both.select("run", "track", "frame", "joint"), ["run", "track", "frame", "joint"], "left_semi")


def eligible(compared: DataFrame) -> DataFrame:
    """Of the comparable rows those of bodies with at least six."""
    n = F.count("*").over(Window.partitionBy("run", "track", "frame"))
    return compared.withColumn("_n", n).where(F.col("_n") >= LEAST_JOINTS).drop("_n")


def summary(dev: DataFrame, norm: DataFrame) -> DataFrame:
    """A row a track: mean of frame means, similarity, coverage of the run's frames, closest and furthest region, worst joint.

    Region and joint means are over all their joint rows, not over frames.
    """
    e = eligible(comparable(dev, norm))
    frames = norm.groupBy("run").agg(F.countDistinct("frame").alias("n_frames"))
    per = e.groupBy("run", "track", "frame").agg(F.avg("deviation").alias("m"))
    means = per.groupBy("run", "track").agg(F.avg("m").alias("mean_dev"), F.count("*").alias("n_valid"))
    place = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("region")).alias("o")
    regions = e.withColumn("region", region()).groupBy("run", "track", "region").agg(F.avg("deviation").alias("m"))
    regions = regions.groupBy("run", "track").agg(
        F.min(F.struct("m", place, "region"))["region"].alias("closest"), F.max(F.struct("m", (-place).alias("o"), "region"))["region"].alias("furthest")
    )
    joints = e.groupBy("run", "track", "joint").agg(F.avg("deviation").alias("m"))
    joints = joints.groupBy("run", "track").agg(F.max(F.struct("m", (-F.col("joint")).alias("o"))).alias("w"))
    out = means.join(frames, "run").join(regions, ["run", "track"]).join(joints, ["run", "track"])
    return out.select(
        "run", "track", "mean_dev", similarity(F.col("mean_dev")).alias("score"), (F.col("n_valid") / F.col("n_frames")).alias("coverage"),
        "closest", "furthest", (-F.col("w.o")).alias("worst_joint"), F.col("w.m").alias("worst_mean"), (F.col("w.m") >= NOTICE).alias("improve"),
    )


def overall(summaries: DataFrame, reference_track: int | None = None) -> DataFrame:
    """run, overall: mean of the tracks' scores, the reference's own apart."""
    own = summaries if reference_track is None else summaries.where(F.col("track") != reference_track)
    return own.groupBy("run").agg(F.avg("score").alias("overall"))


def joint_text(rotated: bool = False) -> Column:
    """What to say of a joint that deviates by dx, dy: y points down. Directions are left out when poses were turned."""
    name = F.element_at(F.array(*[F.lit(j.replace("_", " ")) for j in JOINTS]), F.col("joint") + 1)
    d = F.col("deviation")
    upright = (F.abs("dy") >= NOTICE) & (F.abs("dy") >= 1.5 * F.abs("dx")) & F.lit(not rotated)
    return (
        F.when(d.isNull(), F.concat(name, F.lit(": insufficient")))
        .when(d < NOTICE, F.concat(name, F.lit(": close")))
        .when(upright & (F.col("dy") > 0), F.concat(name, F.lit(": lower")))
        .when(upright, F.concat(name, F.lit(": higher")))
        .otherwise(F.concat(name, F.lit(": differs")))
    )


def feedback(dev: DataFrame, norm: DataFrame, most: int = 3, apart: float = 1.0) -> DataFrame:
    """run, track, rank, t, score, joint, text: each track's worst frames that have a joint worth a notice, in order of time."""
    e = eligible(comparable(dev, norm)).withColumn("_said", joint_text())
    worst = F.max(F.struct("deviation", (-F.col("joint")).alias("o"), F.col("_said").alias("text"), "joint")).alias("w")
    per = e.groupBy("run", "track", "frame").agg(F.max("t").alias("t"), F.avg("deviation").alias("score"), worst)
    per = per.where(F.col("w.deviation") >= NOTICE).select("run", "track", "t", "score", F.col("w.joint").alias("joint"), F.col("w.text").alias("text"))
    return separated_peaks(per, ["run", "track"], "t", "score", ["joint", "text"], most, apart, by_time=True)


def pair_frames(norm: DataFrame) -> DataFrame:
    """run, a, b, frame, t, n, mean, worst, region, joint of every two tracks in a frame: an equi-join on frame and joint."""
    v = norm.where(F.col("nx").isNotNull()).select("run", "frame", "t", "joint", "track", "nx", "ny")
    o = v.select("run", "frame", "joint", F.col("track").alias("b"), F.col("nx").alias("ox"), F.col("ny").alias("oy"))
    j = v.withColumnRenamed("track", "a").join(o, ["run", "frame", "joint"]).where("a < b")
    j = j.withColumn("d", F.sqrt(F.pow(F.col("nx") - F.col("ox"), 2) + F.pow(F.col("ny") - F.col("oy"), 2))).withColumn("region", region())
    key = ["run", "a", "b", "frame"]
    place = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("region"))
    regions = j.groupBy(*key, "region").agg(F.max("t").alias("t"), F.count("*").alias("n"), F.sum("d").alias("s"), F.max("d").alias("most"), F.max(F.struct("d", (-F.col("joint")).alias("o"))).alias("w"))
    top = F.max(F.struct((F.col("s") / F.col("n")).alias("m"), (-place).alias("o"), "region", F.col("w.o").alias("jo"))).alias("r")
    out = regions.groupBy(*key).agg(F.max("t").alias("t"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.max("most").alias("most"), top)
    return out.select(*key, "t", "n", "mean", "most", F.col("r.region").alias("region"), (-F.col("r.jo")).alias("joint"))


def key_moments(norm: DataFrame, most: int = 5, least_s: float = 0.25, apart: float = 1.0) -> DataFrame:
    """The run's main mismatches of two tracks: run, rank, a, b, start, end, peak, mean, region, joint.

    Frames of a pair mismatch with six shared joints of which one is at least
    NOTICE apart. Stretches of them, cut at other frames and at long pauses,
    count from ``least_s`` on; the worst ``most`` are taken, ``apart`` seconds apart.
    """
    times = norm.select("run", "frame", "t").distinct()
    w = Window.partitionBy("run").orderBy("frame")
    pause = times.withColumn("dt", F.col("t") - F.lag("t").over(w)).groupBy("run").agg(F.greatest(F.lit(0.25), 2 * F.median("dt")).alias("pause"))
    p = pair_frames(norm).withColumn("bad", (F.col("n") >= LEAST_JOINTS) & (F.col("most") >= NOTICE)).join(pause, "run")
    pairs = p.select("run", "a", "b").distinct()
    p = pairs.join(times, "run").join(p.drop("t"), ["run", "a", "b", "frame"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    o = Window.partitionBy("run", "a", "b").orderBy("frame")
    begins = F.col("bad") & (~F.coalesce(F.lag("bad").over(o), F.lit(False)) | (F.col("t") - F.lag("t").over(o) > F.col("pause")))
    p = p.withColumn("_b", F.when(begins, 1).otherwise(0)).withColumn("island", F.sum("_b").over(o)).where("bad")
    peak = F.max(F.struct("mean", (-F.col("t")).alias("nt"), "region", "joint")).alias("p")
    e = p.groupBy("run", "a", "b", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), peak)
    e = e.where(F.col("end") - F.col("start") >= least_s).select("run", "a", "b", "start", "end", (-F.col("p.nt")).alias("peak"), F.col("p.mean").alias("mean"), F.col("p.region").alias("region"), F.col("p.joint").alias("joint"))
    return separated_peaks(e.withColumnRenamed("peak", "t"), ["run"], "t", "mean", ["a", "b", "start", "end", "region", "joint"], most, apart).withColumnRenamed("t", "peak")
