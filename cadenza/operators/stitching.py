"""Tracklets of one person put together again, in rounds over all runs at once.

What a link costs depends on the ends of two groups that face each other and
on their usual sizes. So a group is a row: its first and last detections, its
span and its medians; its other detections stay where they are. A round joins
every pair of groups that are the cheapest partner of each other, and costs
the new groups against those near them in time. Groups of different runs, and
far apart in one run, are joined in one round; no task has a run's all pairs.

Joining the cheapest pair of all first gives the same groups as long as a new
group is no nearer to a third than its parts were. Where one is, by its new
median size, the order may matter; in the tests one random run of 25 differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.geometry import person_center, person_scale
from cadenza.operators.tracking import LEAST_LENGTH, NEIGHBOURS, STITCH_COST, STITCH_GAP
from cadenza.plans.scratch import Scratch
from cadenza.schema import VISIBLE

#: Detections that a moving mean of five looks to on each side.
REACH = 2
ENDS = NEIGHBOURS + REACH


def measured(tracked: DataFrame, pose: DataFrame) -> DataFrame:
    """run, frame, det, tracklet, x, y, size, extent of tracked bodies (run, frame, det, tracklet), whose joints are in pose with det as track."""
    seen = F.col("c") >= VISIBLE
    box = pose.where("x IS NOT NULL").groupBy("run", "track", "frame").agg(*[(F.max(F.when(seen, F.col(k))) - F.min(F.when(seen, F.col(k)))).alias(f"_{k}") for k in "xy"])
    m = person_center(pose).join(person_scale(pose), ["run", "track", "frame"]).join(box, ["run", "track", "frame"], "left")
    m = m.select("run", "frame", F.col("track").alias("det"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("scale").alias("size"), F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("extent"))
    return tracked.join(m, ["run", "frame", "det"])


def groups_of(dets: DataFrame) -> DataFrame:
    """One row a tracklet: run, g, lead, members, made, first, last, n, size, extent, head, tail. made: the cost at which it was joined, -1 if it wasn't."""
    part = Window.partitionBy("run", "tracklet")
    point = F.struct("frame", "det", "x", "y", "size", "extent")
    d = dets.withColumn("_a", F.row_number().over(part.orderBy("frame", "det"))).withColumn("_z", F.row_number().over(part.orderBy(F.desc("frame"), F.desc("det"))))
    head, tail = (F.array_sort(F.collect_list(F.when(F.col(c) <= ENDS, point))) for c in ("_a", "_z"))
    return d.groupBy("run", F.col("tracklet").alias("g")).agg(
        F.first("tracklet").alias("lead"), F.array(F.first("tracklet")).alias("members"), F.lit(-1.0).alias("made"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"),
        F.median("size").alias("size"), F.median(F.when(F.col("extent") > 0, F.col("extent"))).alias("extent"), head.alias("head"), tail.alias("tail"),
    )


def _mean(points: Column, i: Column, axis: str) -> Column:
    """The moving mean of an axis at place i (from 1) of an end; nulls are left out."""
    lo = F.greatest(F.lit(1), i - REACH)
    near = F.filter(F.transform(F.slice(points, lo, i + REACH - lo + 1), lambda p: p[axis]), lambda v: v.isNotNull())
    return F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(near), F.lit(0))


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _faces(groups: DataFrame) -> DataFrame:
    """The groups with hs and ts: the ``NEIGHBOURS`` detections at each end, with their places averaged."""

    def held(points: str, first: Column) -> Column:
        places = F.sequence(first, F.least(F.size(points), first + NEIGHBOURS - 1))
        p = lambda i: F.get(F.col(points), i - 1)
        return F.transform(places, lambda i: F.struct(p(i)["frame"].alias("frame"), p(i)["size"].alias("size"), p(i)["extent"].alias("extent"), _mean(F.col(points), i, "x").alias("x"), _mean(F.col(points), i, "y").alias("y")))

    last = F.greatest(F.lit(1), F.size("tail") - NEIGHBOURS + 1)
    return groups.withColumns({"hs": held("head", F.lit(1)), "ts": held("tail", last)}).drop("head", "tail", "members", "lead")


def link_cost(a: str, b: str, fps: float, max_gap: int) -> Column:
    """Cost of groups a and b (names of struct columns, with faces) being one person, null if they can't be.

    The nearest ``NEIGHBOURS`` detections of b are held against a's end that
    faces them: how far they are beyond what the pause allows, in sizes, the
    ratio of the usual sizes, and the pause.
    """
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    before = x("last") < y("first")
    own = F.when(before, F.element_at(x("ts"), -1)).otherwise(F.get(x("hs"), F.lit(0)))
    face = F.when(before, y("hs")).otherwise(y("ts"))

    def held(p: Column, o: Column) -> Column:
        gap = F.abs(p["frame"] - o["frame"]).cast("double")
        size = F.least(o["size"], p["size"])
        extent = F.when(o["extent"].isNotNull() & p["extent"].isNotNull(), F.least(o["extent"], p["extent"]) / 4)
        far = F.sqrt(F.pow(o["x"] - p["x"], 2) + F.pow(o["y"] - p["y"], 2)) / F.greatest(size, F.coalesce(extent, size))
        return F.struct(gap.alias("gap"), F.greatest(F.lit(0.0), far - (0.5 + gap / fps)).alias("excess"), far.isNotNull().alias("ok"))

    def total(o: Column) -> Column:
        return F.get(F.transform(F.array(F.transform(face, lambda p: held(p, o))), summed), F.lit(0))

    def summed(pairs: Column) -> Column:
        gaps = F.transform(pairs, lambda p: p["gap"])
        excess = _median(F.transform(F.filter(pairs, lambda p: p["ok"]), lambda p: p["excess"]))
        return F.when(F.array_min(gaps) <= max_gap, excess + 0.1 * _median(gaps) / fps)

    ratio = F.abs(F.ln(y("size") / x("size")))
    whole = F.abs(F.ln(y("extent") / x("extent")))
    return F.get(F.transform(F.array(own), total), F.lit(0)) + F.coalesce(0.2 * ratio + whole, ratio)


def _costs(early: DataFrame, late: DataFrame, fps: float, max_gap: int, most: float) -> DataFrame:
    """run, x, y, cost of pairs of an early and a late group that may be one person. Time is cut into ranges of the longest pause, so only groups of one range and the next meet."""
    step = float(max_gap + 1)
    early, late = _faces(early), _faces(late)
    whole = [F.struct(*early.columns).alias("v")]
    e = early.select("run", F.floor(F.col("last") / step).alias("_r"), *whole).withColumnRenamed("v", "e")
    la = late.select("run", F.explode(F.array(F.floor(F.col("first") / step), F.floor(F.col("first") / step) - 1)).alias("_r"), *whole).withColumnRenamed("v", "l")
    j = e.join(la, ["run", "_r"]).where("e.last < l.first").where(F.col("l.first") - F.col("e.last") <= max_gap)
    # The group that was made later looks at the other; of two that weren't made, the earlier.
    turn = F.col("l.made") > F.col("e.made")
    j = j.withColumn("a", F.when(turn, F.col("l")).otherwise(F.col("e"))).withColumn("b", F.when(turn, F.col("e")).otherwise(F.col("l")))
    c = j.select("run", F.least("e.g", "l.g").alias("x"), F.greatest("e.g", "l.g").alias("y"), link_cost("a", "b", fps, max_gap).alias("cost"))
    return c.where(F.col("cost") <= most)


def _mutual(pairs: DataFrame) -> DataFrame:
    """The pairs that are the cheapest of both their groups; ties go to the smaller numbers."""
    of = pairs.select("run", F.explode(F.array("x", "y")).alias("g"), F.struct("cost", "x", "y").alias("p"))
    best = of.groupBy("run", "g").agg(F.min("p").alias("p"))
    return best.groupBy("run", "p").agg(F.count("*").alias("n")).where("n = 2").select("run", "p.x", "p.y", "p.cost")


def _joined(merges: DataFrame, live: DataFrame, dets: DataFrame) -> DataFrame:
    """The rows of the new groups: ends of both parts in order, medians of all their detections."""
    u, v = (live.select("run", F.col("g").alias(c), F.struct(*live.columns).alias(s)) for c, s in (("x", "u"), ("y", "v")))
    j = merges.join(u, ["run", "x"]).join(v, ["run", "y"])
    first = F.col("u.first") < F.col("v.first")
    j = j.withColumn("e", F.when(first, F.col("u")).otherwise(F.col("v"))).withColumn("l", F.when(first, F.col("v")).otherwise(F.col("u")))
    every_tail = F.concat("e.tail", "l.tail")
    j = j.select(
        "run", F.col("x").alias("g"), F.col("e.lead").alias("lead"), F.concat("e.members", "l.members").alias("members"), F.col("cost").alias("made"), F.col("e.first").alias("first"), F.col("l.last").alias("last"), (F.col("u.n") + F.col("v.n")).alias("n"),
        F.slice(F.concat("e.head", "l.head"), 1, ENDS).alias("head"), F.slice(every_tail, F.greatest(F.lit(1), F.size(every_tail) - ENDS + 1), F.lit(ENDS)).alias("tail"),
    )
    inside = dets.join(j.select("run", "g", F.explode("members").alias("tracklet")), ["run", "tracklet"])
    medians = inside.groupBy("run", "g").agg(F.median("size").alias("size"), F.median(F.when(F.col("extent") > 0, F.col("extent"))).alias("extent"))
    return j.join(medians, ["run", "g"]).select(live.columns)


def link_groups(dets: DataFrame, fps: float = 30.0, max_gap: int = STITCH_GAP, most: float = STITCH_COST) -> DataFrame:
    """The groups' rows, with their members; dets: run, frame, det, tracklet, x, y, size, extent, places and extents may be null.

    A run without pairs is settled. Whenever half of the runs are, they are put
    aside, so that all rounds together go over few times the rows of the first.
    """
    scratch = Scratch(dets.sparkSession, "stitch")
    live = scratch.save(groups_of(dets))
    pairs = scratch.save(_costs(live, live, fps, max_gap, most))
    settled: list[DataFrame] = []
    at_work, of = None, dets
    while True:
        runs = pairs.select("run").distinct()
        n = runs.count()
        if not n:
            return reduce(DataFrame.unionByName, [*settled, live])
        if at_work is not None and 2 * n <= at_work:
            settled.append(scratch.save(live.join(runs, "run", "left_anti")))
            fewer, left = scratch.save(live.join(runs, "run", "left_semi")), scratch.save(of.join(runs, "run", "left_semi"))
            scratch.drop(live)
            scratch.drop(of)
            live, of = fewer, left
        at_work = n if at_work is None or 2 * n <= at_work else at_work
        merges = scratch.save(_mutual(pairs))
        fresh = scratch.save(_joined(merges, live, of))
        touched = merges.select("run", F.explode(F.array("x", "y")).alias("g"))
        rest = live.join(touched, ["run", "g"], "left_anti")
        new_live = scratch.save(rest.unionByName(fresh))
        kept = pairs
        for c in ("x", "y"):
            kept = kept.join(touched.withColumnRenamed("g", c), ["run", c], "left_anti")
        found = _costs(fresh, new_live, fps, max_gap, most).unionByName(_costs(rest, fresh, fps, max_gap, most))
        new_pairs = scratch.save(kept.select("run", "x", "y", "cost").unionByName(found))
        for old in (merges, fresh, live, pairs):
            scratch.drop(old)
        live, pairs = new_live, new_pairs


def stitch(dets: DataFrame, fps: float = 30.0, max_gap: int = STITCH_GAP, most: float = STITCH_COST, least: int = LEAST_LENGTH) -> DataFrame:
    """run, frame, det, track: groups of tracklets, numbered in each run by first frame, then first tracklet; those of fewer than ``least`` detections are null.

    dets: run, frame, det, tracklet, x, y (centre), size, extent (box diagonal,
    null without). A detection without a tracklet has no track. An empty table gives no rows.
    """
    scratch = Scratch(dets.sparkSession, "stitch")
    kept = scratch.save(dets.where("tracklet IS NOT NULL").select("run", "frame", "det", "tracklet", "x", "y", F.col("size").cast("double").alias("size"), F.col("extent").cast("double").alias("extent")))
    groups = link_groups(kept, fps, max_gap, most)
    number = F.row_number().over(Window.partitionBy("run").orderBy("first", "lead")) - 1
    tracks = groups.where(F.col("n") >= least).select("run", "members", number.cast("long").alias("track"))
    of = tracks.select("run", "track", F.explode("members").alias("tracklet"))
    return dets.select("run", "frame", "det", "tracklet").join(of, ["run", "tracklet"], "left").select("run", "frame", "det", "track")


def fragments(tracked: DataFrame, tracklets: DataFrame) -> DataFrame:
    """run, base, n: how many tracklets each track was made of."""
    j = tracked.where("track IS NOT NULL").join(tracklets.select("run", "frame", "det", "tracklet"), ["run", "frame", "det"])
    return j.groupBy("run", F.col("track").alias("base")).agg(F.countDistinct("tracklet").alias("n"))
