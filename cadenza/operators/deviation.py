"""How far each body is from a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import angle_between
from cadenza.operators.series import separated_peaks
from cadenza.schema import JOINTS, LIMBS, REGIONS

BODY = ["run", "track", "frame"]


def joint_deviation(norm: DataFrame, reference: DataFrame, reference_track: int | None = None) -> DataFrame:
    """run, track, frame, t, joint, deviation: distance of each seen joint from the reference; null where either is missing, and for the reference's own track."""
    own = ["run", "track", "frame", "joint"] if "track" in reference.columns else ["run", "frame", "joint"]
    j = norm.join(reference, own, "left")
    far = F.sqrt(F.pow(F.col("nx") - F.col("rx"), 2) + F.pow(F.col("ny") - F.col("ry"), 2))
    if reference_track is not None:
        far = F.when(F.col("track") != reference_track, far)
    return j.select(*BODY, "t", "joint", far.alias("deviation"), (F.col("nx") - F.col("rx")).alias("dx"), (F.col("ny") - F.col("ry")).alias("dy"))


def frame_score(dev: DataFrame) -> DataFrame:
    """Mean deviation of each body, and of each of its regions."""
    regions = [F.avg(F.when(F.col("joint").isin(*js), F.col("deviation"))).alias(name) for name, js in REGIONS.items()]
    worst = F.max_by("joint", F.struct("deviation", -F.col("joint"))).alias("worst_joint")
    return dev.groupBy(*BODY).agg(F.max("t").alias("t"), F.avg("deviation").alias("score"), *regions, F.when(F.max("deviation").isNotNull(), worst).alias("worst_joint"))


def limb_deviation(norm: DataFrame, reference: DataFrame) -> DataFrame:
    """Difference in degrees of each limb's direction from the reference's: run, track, frame, limb, degrees."""
    ref = reference.groupBy("run", "frame").agg(*[F.max(F.when(F.col("joint") == j, F.col(k))).alias(f"{k}{j}") for j in range(5, 17) for k in ("rx", "ry")])
    own = norm.groupBy(*BODY).agg(*[F.max(F.when(F.col("joint") == j, F.col(k))).alias(f"{k}{j}") for j in range(5, 17) for k in ("nx", "ny")])
    j = own.join(ref, ["run", "frame"])

    def angle(k: str, a: int, b: int):
        return F.atan2(F.col(f"{k}y{b}") - F.col(f"{k}y{a}"), F.col(f"{k}x{b}") - F.col(f"{k}x{a}"))

    degrees = F.array(*[angle_between(angle("n", a, b), angle("r", a, b)) for a, b in LIMBS])
    return j.select(*BODY, F.posexplode(degrees).alias("limb", "degrees"))


def within_tolerance(norm: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """The best match of each body within so many frames of the reference: run, track, frame, lag, score; of scores equal to nine digits the smaller, then the earlier lag.

    Each joint row is sent to 2 * tolerance + 1 frames, an equi-join by frame
    instead of a range join; lag 0 and a null score where nothing matches.
    """
    lags = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))
    n = norm.where(F.col("nx").isNotNull()).select(*BODY, "joint", "nx", "ny", lags.alias("lag")).withColumn("at", F.col("frame") + F.col("lag"))
    r = reference.where(F.col("rx").isNotNull()).select("run", F.col("frame").alias("at"), "joint", "rx", "ry")
    d = n.join(r, ["run", "at", "joint"]).withColumn("d", F.sqrt(F.pow(F.col("nx") - F.col("rx"), 2) + F.pow(F.col("ny") - F.col("ry"), 2)))
    s = d.groupBy(*BODY, "lag").agg(F.avg("d").alias("score"))
    best = s.groupBy(*BODY).agg(F.min(F.struct(F.round("score", 9).alias("about"), F.abs("lag").alias("far"), "lag", "score")).alias("m"))
    return norm.select(*BODY).distinct().join(best, BODY, "left").select(*BODY, F.coalesce("m.lag", F.lit(0)).alias("lag"), F.col("m.score").alias("score"))


def worst_moments(scores: DataFrame, most: int = 3, apart: float = 1.0) -> DataFrame:
    """run, track, rank, t, score, worst_joint: each track's worst frames, at least a second apart."""
    return separated_peaks(scores, ["run", "track"], "t", "score", ["worst_joint"], most, apart)


def track_summary(dev: DataFrame) -> DataFrame:
    """run, track, frames_present, mean_dev, worst_joint: over all of a track's frames."""
    scores = frame_score(dev)
    mean = scores.groupBy("run", "track").agg(F.count_if(F.col("score").isNotNull()).alias("frames_present"), F.avg("score").alias("mean_dev"))
    joints = dev.groupBy("run", "track", "joint").agg(F.avg("deviation").alias("m")).where("m IS NOT NULL")
    worst = joints.groupBy("run", "track").agg(F.max_by("joint", F.struct("m", -F.col("joint"))).alias("worst_joint"))
    return mean.join(worst, ["run", "track"], "left")


def report_rows(dev: DataFrame) -> DataFrame:
    """The rows of a deviation report: frame, t, dancer from 1, score, a column a joint; only scored bodies."""
    wide = dev.groupBy(*BODY).agg(F.max("t").alias("t"), F.avg("deviation").alias("score"), *[F.max(F.when(F.col("joint") == j, F.col("deviation"))).alias(n) for j, n in enumerate(JOINTS)])
    return wide.where("score IS NOT NULL").select("frame", F.round("t", 3).alias("t"), (F.col("track") + 1).alias("dancer"), F.round("score", 4).alias("score"), *[F.round(n, 4).alias(n) for n in JOINTS], F.round(100 / (1 + F.col("score")), 4).alias("movement_similarity"))
