"""Who is who: merges, an edit log, cross tables, and learned joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import logistic

KEY = ["run", "frame"]


def compact(persons: DataFrame) -> DataFrame:
    """persons (run, frame, det, person, size) with person renumbered from 0 without holes, in order; null stays null."""
    ids = persons.where("person IS NOT NULL").select("run", "person").distinct()
    ids = ids.withColumn("_new", (F.row_number().over(Window.partitionBy("run").orderBy("person")) - 1).cast("long"))
    out = persons.join(ids, ["run", "person"], "left")
    return out.withColumn("person", F.col("_new")).select(persons.columns)


def one_each(persons: DataFrame) -> DataFrame:
    """Of several rows of a person in a frame only the largest keeps it, the first by det of equal ones; the others' person becomes null."""
    w = Window.partitionBy("run", "frame", "person").orderBy(F.desc("size"), "det")
    keep = F.when(F.row_number().over(w) == 1, F.col("person"))
    return persons.withColumn("person", F.when(F.col("person").isNotNull(), keep))


def canonical_groups(groups: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Member arrays sorted and without repeats; groups of fewer than two and repeated groups are left out."""
    g = groups.withColumn(members, F.array_sort(F.array_distinct(members)))
    return g.where(F.size(members) >= 2).select(*keys, members).distinct()


def merge(persons: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Every group of persons becomes its lowest member; then compacted and resolved."""
    flat = [m for g in groups for m in g]
    if len(flat) != len(set(flat)) or any(m < 0 for m in flat):
        raise ValueError("merge groups must be disjoint and of persons from 0 on")
    to = {m: min(g) for g in groups for m in g}
    if not to:
        return one_each(compact(persons))
    table = F.create_map(*[F.lit(x).cast("long") for pair in to.items() for x in pair])
    merged = persons.withColumn("person", F.coalesce(F.try_element_at(table, F.col("person")), F.col("person")))
    return one_each(compact(merged))


def apply_edit(persons: DataFrame, edit: dict) -> DataFrame:
    """One edit on (run, frame, det, person, size); numbers in it are those after the edits before it."""
    p, f = F.col("person"), F.col("frame")
    if edit["op"] == "merge":
        return merge(persons, edit["groups"])
    if edit["op"] == "split":
        n = F.max("person").over(Window.partitionBy("run")) + 1
        new = F.when((p == edit["person"]) & (f >= edit["frame"]), n).otherwise(p)
    elif edit["op"] == "swap":
        a, b = edit["people"]
        inside = f.between(*edit["frames"])
        new = F.when(inside & (p == a), F.lit(b)).when(inside & (p == b), F.lit(a)).otherwise(p)
    elif edit["op"] == "remove":
        new = F.when(~((p == edit["person"]) & f.between(*edit["frames"])), p)
    else:
        raise ValueError(f"no such edit: {edit['op']}")
    return one_each(compact(persons.withColumn("person", new.cast("long"))))


def replay(persons: DataFrame, edits: list[dict], every: int = 10) -> DataFrame:
    """All edits in order. The plan is cut by a checkpoint after every few, so a long log stays plannable."""
    for k, e in enumerate(edits, 1):
        persons = apply_edit(persons, e)
        if k % every == 0 and k < len(edits):
            from cadenza.plans.scratch import Scratch

            persons = Scratch(persons.sparkSession, "edits").save(persons)
    return persons


def cross_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """run, base, finals, final: the persons that each base track became, and the one if it is one."""
    j = before.select("run", "frame", "det", F.col("person").alias("base")).join(after.select("run", "frame", "det", F.col("person").alias("final")), ["run", "frame", "det"])
    j = j.where("base IS NOT NULL AND final IS NOT NULL")
    g = j.groupBy("run", "base").agg(F.array_sort(F.collect_set("final")).alias("finals"))
    return g.withColumn("final", F.when(F.size("finals") == 1, F.col("finals")[0]))


def fragments(before: DataFrame, after: DataFrame) -> DataFrame:
    """run, person, fragments: how many base tracks each final person has."""
    j = before.select("run", "frame", "det", F.col("person").alias("base")).join(after.select("run", "frame", "det", F.col("person").alias("final")), ["run", "frame", "det"])
    return j.where("base IS NOT NULL AND final IS NOT NULL").groupBy("run", F.col("final").alias("person")).agg(F.countDistinct("base").alias("fragments"))


def band_pairs(tracklets: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Pairs a < b of a group's tracklets that don't overlap and are at most ``most`` apart: features size, motion, gap.

    Like ``tracking.link_candidates`` by ranges of time.
    """
    a = tracklets.select(*keys, F.col("tracklet").alias("a"), F.col("t1").alias("_end"), F.col("n").alias("na"), F.col("centre").alias("ca"), F.floor(F.col("t1") / most).alias("_r"))
    b = tracklets.select(*keys, F.col("tracklet").alias("b"), F.col("t0").alias("_begin"), F.col("n").alias("nb"), F.col("centre").alias("cb"), F.explode(F.array(F.floor(F.col("t0") / most), F.floor(F.col("t0") / most) - 1)).alias("_r"))
    j = a.join(b, [*keys, "_r"]).withColumn("gap", F.col("_begin") - F.col("_end")).where((F.col("gap") >= 0) & (F.col("gap") <= most) & (F.col("a") != F.col("b")))
    return j.select(*keys, "a", "b", "gap", F.abs(F.ln(F.col("na") / F.col("nb"))).alias("size"), (F.abs(F.col("ca") - F.col("cb")) / 100).alias("motion"))


def examples(pairs: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with same: whether both tracklets are of one person, by truth (keys, tracklet, person); pairs of unknown ones are left out."""
    t = truth.select(*keys, "tracklet", "person")
    j = pairs.join(t.select(*keys, F.col("tracklet").alias("a"), F.col("person").alias("pa")), [*keys, "a"]).join(t.select(*keys, F.col("tracklet").alias("b"), F.col("person").alias("pb")), [*keys, "b"])
    return j.where("pa IS NOT NULL AND pb IS NOT NULL").withColumn("same", (F.col("pa") == F.col("pb")).cast("int")).drop("pa", "pb")


def probability(weights: dict[str, float], bias: float, mean: dict[str, float], std: dict[str, float]) -> Column:
    """The probability of a linear model on standardised features, as a column."""
    logit = F.lit(bias)
    for name, w in weights.items():
        logit = logit + w * (F.col(name) - mean[name]) / std[name]
    return logistic(logit)


def fit(rows: DataFrame, features: list[str], label: str) -> dict:
    """Class-weighted logistic regression with a ridge of one half the squared weights, on standardised features, the intercept free.

    Newton steps on sums that each are one aggregate over the rows, so only
    a matrix of the features' number squared comes to the driver. The rows are
    written once, as what makes them may be joins that no step should repeat.
    """
    from cadenza.plans.scratch import Scratch

    scratch = Scratch(rows.sparkSession, "fit")
    rows = scratch.save(rows.select(*features, label))
    try:
        return _newton(rows, features, label)
    finally:
        scratch.drop(rows)


def _newton(rows: DataFrame, features: list[str], label: str) -> dict:
    """The fit on rows that are cheap to read again."""
    stats = rows.agg(F.count("*").alias("n"), F.sum(label).alias("pos"), *[g(f).alias(f"{p}_{f}") for f in features for p, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, pos = stats["n"], stats["pos"] or 0
    if not pos or pos == n:
        return {"status": "collecting", "rows": n}
    mean = {f: stats[f"m_{f}"] for f in features}
    std = {f: stats[f"s_{f}"] if stats[f"s_{f}"] > 1e-12 else 1.0 for f in features}
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    x = [*[(F.col(f) - mean[f]) / std[f] for f in features], F.lit(1.0)]
    k, w = len(x), np.zeros(len(x))
    ridge = np.array([1.0] * len(features) + [0.0])
    for _ in range(25):
        logit = sum((float(a) * c for a, c in zip(w, x, strict=True)), F.lit(0.0))
        p = logistic(logit)
        sums = rows.agg(*[F.sum(weight * (p - F.col(label)) * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(weight * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        g = np.array([sums[f"g{i}"] for i in range(k)]) + ridge * w
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return {"status": "trained", "rows": n, "weights": dict(zip(features, w[:-1].tolist(), strict=True)), "bias": float(w[-1]), "mean": mean, "std": std}


def complete_linkage(pairs: DataFrame, keys: list[str], least: float = 0.85) -> DataFrame:
    """keys, tracklet, person: tracklets joined by falling probability p, only where every pair across the two groups is a candidate.

    pairs: keys, a, b, p. A group's pairs are handled in one task: they are
    one run's candidates, which the band join has bounded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {t: {t} for t in sorted({*pdf.a, *pdf.b})}
        ok = {(min(a, b), max(a, b)) for a, b, p in zip(pdf.a, pdf.b, pdf.p, strict=True) if p >= least}
        for _, a, b in sorted((-p, min(a, b), max(a, b)) for a, b, p in zip(pdf.a, pdf.b, pdf.p, strict=True)):
            x, y = of[a], of[b]
            if x is not y and all((min(i, j), max(i, j)) in ok for i in x for j in y):
                x |= y
                for t in y:
                    of[t] = x
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(of) for k in keys}, "tracklet": list(of), "person": [min(g) for g in of.values()]})

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{kinds}, tracklet long, person long")
