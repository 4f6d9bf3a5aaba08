"""Bodies from joints: sizes, centres, limb angles, the body's own frame of reference, and per-frame signals.

A pose table has a row a joint (run, track, frame, t, joint, x, y, c). Each of
these is one aggregate per body, hashed by (run, track, frame), or a window
within a track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import either, joint, mean_at, seen
from cadenza.operators.series import moving_mean
from cadenza.schema import LIMBS

BODY = ["run", "track", "frame"]


def visible_counts(pose: DataFrame) -> DataFrame:
    """Seen joints of every body, and whether they are enough to score it."""
    return pose.groupBy(*BODY).agg(F.count_if(seen()).alias("n_visible")).withColumn("eligible", F.col("n_visible") >= 6)


def person_scale(pose: DataFrame) -> DataFrame:
    """scale: torso length, or 0.4 of the seen joints' box diagonal, at least 1; strict_scale: torso length or null."""
    ls, rs, lh, rh = ({k: joint(j, k) for k in "xy"} for j in (5, 6, 11, 12))
    torso = F.sqrt(F.pow((ls["x"] + rs["x"] - lh["x"] - rh["x"]) / 2, 2) + F.pow((ls["y"] + rs["y"] - lh["y"] - rh["y"]) / 2, 2))
    spread = [F.max(F.when(seen(), F.col(k))) - F.min(F.when(seen(), F.col(k))) for k in "xy"]
    box = F.when(F.count_if(seen()) >= 2, 0.4 * F.sqrt(F.pow(spread[0], 2) + F.pow(spread[1], 2)))
    return pose.groupBy(*BODY).agg(F.greatest(F.coalesce(torso, box, F.lit(1.0)), F.lit(1.0)).alias("scale"), torso.alias("strict_scale"))


def person_center(pose: DataFrame) -> DataFrame:
    """The mean of the seen hips, else of all seen joints, else null."""
    hip = {k: mean_at((11, 12), k) for k in "xy"}
    every = {k: F.avg(F.when(seen(), F.col(k))) for k in "xy"}
    return pose.groupBy(*BODY).agg(*[F.coalesce(hip[k], every[k]).alias(f"c{k}") for k in "xy"])


def limb_angles(pose: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Direction of each limb: run, track, frame, limb, angle; null where an end is not seen."""
    ends = [(joint(a, x), joint(a, y), joint(b, x), joint(b, y)) for a, b in LIMBS]
    wide = pose.groupBy(*BODY).agg(*[F.atan2(by - ay, bx - ax).alias(f"_{k}") for k, (ax, ay, bx, by) in enumerate(ends)])
    return wide.select(*BODY, F.posexplode(F.array(*[f"_{k}" for k in range(len(LIMBS))])).alias("limb", "angle"))


def body_frame(pose: DataFrame) -> DataFrame:
    """ox, oy, scale, rot of each body: smoothed hip middle, torso length and torso direction, filled over short absences."""
    hip = {k: either(joint(11, k), joint(12, k)) for k in "xy"}
    sho = {k: either(joint(5, k), joint(6, k)) for k in "xy"}
    b = pose.groupBy(*BODY).agg(hip["x"].alias("hx"), hip["y"].alias("hy"), sho["x"].alias("sx"), sho["y"].alias("sy"))
    dx, dy = F.col("sx") - F.col("hx"), F.col("sy") - F.col("hy")
    b = b.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("sin", F.sin(F.atan2(dx, -dy))).withColumn("cos", F.cos(F.atan2(dx, -dy)))
    for value, width, out in (("length", 15, "scale"), ("hx", 3, "ox"), ("hy", 3, "oy"), ("sin", 15, "_sin"), ("cos", 15, "_cos")):
        b = moving_mean(b, ["run", "track"], "frame", value, width, out, by_range=True)
    return b.select(*BODY, "ox", "oy", "scale", F.atan2("_sin", "_cos").alias("rot"))


def normalize(pose: DataFrame, rotate: bool = False) -> DataFrame:
    """pose with nx, ny, nc: positions in units of the torso around the hips, and turned upright if ``rotate``; null where not seen or not finite."""
    p = pose.join(body_frame(pose), BODY)
    rx, ry = F.try_divide(F.col("x") - F.col("ox"), F.col("scale")), F.try_divide(F.col("y") - F.col("oy"), F.col("scale"))
    if rotate:
        s, c = F.sin(-F.col("rot")), F.cos(-F.col("rot"))
        rx, ry = rx * c - ry * s, rx * s + ry * c
    shown = seen() & rx.isNotNull()
    return p.select(*pose.columns, "ox", "oy", "scale", "rot", F.when(shown, rx).alias("nx"), F.when(shown, ry).alias("ny"), F.when(shown, F.col("c")).alias("nc"))


def denormalize(norm: DataFrame, rotate: bool = False) -> DataFrame:
    """norm with bx, by: positions taken back to the picture."""
    nx, ny = F.col("nx"), F.col("ny")
    if rotate:
        s, c = F.sin("rot"), F.cos("rot")
        nx, ny = nx * c - ny * s, nx * s + ny * c
    return norm.withColumn("bx", nx * F.col("scale") + F.col("ox")).withColumn("by", ny * F.col("scale") + F.col("oy"))


def biomechanics(pose: DataFrame) -> DataFrame:
    """Ten signals of each body; all but confidence need a strict scale, each the joints that it names. compactness: mean distance of the seen joints from the middle of the hips. y points down."""
    at = {j: (joint(j, "x"), joint(j, "y")) for j in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)}
    names = {j: (f"x{j}", f"y{j}") for j in at}
    sums = [v.alias(n) for j in at for v, n in zip(at[j], names[j], strict=True)]
    b = pose.groupBy(*BODY).agg(*sums, F.avg(F.when(seen(), F.col("c"))).alias("confidence"), F.collect_list(F.when(seen(), F.struct("x", "y"))).alias("_seen"))
    x, y = {j: F.col(names[j][0]) for j in at}, {j: F.col(names[j][1]) for j in at}
    hx, hy = (x[11] + x[12]) / 2, (y[11] + y[12]) / 2
    scale = F.sqrt(F.pow((x[5] + x[6]) / 2 - hx, 2) + F.pow((y[5] + y[6]) / 2 - hy, 2))
    b = b.withColumn("scale", F.when(scale > 0, scale))
    s = F.col("scale")

    def dist(a: int, c: int):
        return F.sqrt(F.pow(x[a] - x[c], 2) + F.pow(y[a] - y[c], 2))

    def mean(*values):
        kept = F.filter(F.array(*values), lambda v: v.isNotNull())
        return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(kept), F.lit(0))

    heights = [(hy - y[9]) / s, (hy - y[10]) / s]
    chains = [(5, 9), (6, 10), (11, 15), (12, 16)]
    b = b.withColumn("_hx", hx).withColumn("_hy", hy)
    spread = F.aggregate("_seen", F.lit(0.0), lambda a, p: a + F.sqrt(F.pow(p["x"] - F.col("_hx"), 2) + F.pow(p["y"] - F.col("_hy"), 2)))
    return b.select(
        *BODY,
        mean(*heights).alias("wrist_height"),
        F.abs(heights[0] - heights[1]).alias("wrist_asymmetry"),
        mean(*[dist(a, c) / s for a, c in chains]).alias("limb_extension"),
        mean(*[F.when(s.isNotNull(), F.atan2(y[c] - y[a], x[c] - x[a])) for a, c in chains]).alias("limb_angle"),
        (hx / s).alias("body_x"),
        (hy / s).alias("body_y"),
        F.when(F.size("_seen") > 0, spread / F.nullif(F.size("_seen"), F.lit(0)) / s).alias("compactness"),
        (dist(15, 16) / s).alias("step_width"),
        F.when(s.isNotNull(), F.abs(F.degrees(F.atan2(y[6] - y[5], x[6] - x[5])))).alias("shoulder_tilt"),
        "confidence",
        "scale",
    )


def motion_speed(pose: DataFrame, joints: tuple[int, ...] | None = None, out: str = "speed") -> DataFrame:
    """Mean speed in torso lengths a second of the joints that are seen in a frame and in the one before; null without either scale."""
    p = pose if joints is None else pose.where(F.col("joint").isin(*joints))
    w = Window.partitionBy("run", "track", "joint").orderBy("frame")
    beside = F.lag("frame").over(w) == F.col("frame") - 1
    far = F.when(seen() & F.lag(seen()).over(w) & beside, F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)))
    moved = p.withColumn("_far", far).groupBy(*BODY).agg(F.avg("_far").alias("_far"), F.max("t").alias("t"))
    m = moved.join(person_scale(pose).select(*BODY, "strict_scale"), BODY)
    v = Window.partitionBy("run", "track").orderBy("frame")
    dt = F.when(F.lag("frame").over(v) == F.col("frame") - 1, F.col("t") - F.lag("t").over(v))
    scale = (F.col("strict_scale") + F.lag("strict_scale").over(v)) / 2
    return m.withColumn(out, F.when((dt > 0) & (scale > 0), F.col("_far") / (dt * scale))).select(*BODY, "t", out)


def visible_histogram(pose: DataFrame) -> DataFrame:
    """Histogram of each body's seen confidences over ten equal bins, as an array that sums to 1; null if none is seen."""
    bins = [F.count_if(seen() & (F.least(F.floor(F.col("c") * 10), F.lit(9)) == k)) for k in range(10)]
    n = F.count_if(seen())
    return pose.groupBy(*BODY).agg(F.when(n > 0, F.array(*[F.try_divide(b.cast("double"), n.cast("double")) for b in bins])).alias("histogram"))

