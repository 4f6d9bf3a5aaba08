"""Choosing, counting and comparing rows: the small operators around a run's report and its registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.series import unwrap


def angle_span(df: DataFrame, keys: list[str], order: str, angle: str) -> DataFrame:
    """keys, span: from the least to the largest of each series' unwrapped angles; rows without an angle don't count."""
    v = unwrap(df.where(F.col(angle).isNotNull()), keys, order, angle, "_u")
    return v.groupBy(*keys).agg((F.max("_u") - F.min("_u")).alias("span"))


def change_rms(df: DataFrame, keys: list[str], order: str, value: str, fps: float) -> DataFrame:
    """keys, rms: root mean square of a series' change by second; of a speed, its acceleration. Null for fewer than two values."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = (F.col(value) - F.lag(value).over(w)) * fps
    return df.where(F.col(value).isNotNull()).withColumn("_d", d).groupBy(*keys).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"))


def nearest_row(series: DataFrame, asked: DataFrame, keys: list[str], time: str, at: str) -> DataFrame:
    """keys, ``at``, and the series' row nearest in time to each asked one, the first of equally near ones. asked: keys, ``at``; keys of few asked times each."""
    gap = F.abs(F.col(time) - F.col(at))
    best = F.min_by(F.struct(*[F.col(c) for c in series.columns if c not in keys]), F.struct(gap, F.col(time)))
    return series.join(asked.distinct(), keys).groupBy(*keys, at).agg(best.alias("_r")).select(*keys, at, "_r.*")


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, k: int = 8) -> DataFrame:
    """keys, rank, a, b, gap: the k smallest gaps between each left time's neighbours on the right, on both sides; ties to the earlier.

    One sorted union gives each left row the last right row up to it and the
    first one after it, so no pair of all rows is made.
    """
    u = left.select(*keys, F.col(a).alias("_t"), F.lit(1).alias("_left")).unionByName(right.select(*keys, F.col(b).alias("_t"), F.lit(0).alias("_left")))
    w = Window.partitionBy(*keys).orderBy("_t", "_left")
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_left"))  # a frame to the end is built anew at every row
    there = F.when(F.col("_left") == 0, F.col("_t"))
    near = u.withColumn("_b", F.last(there, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last(there, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    both = near.where("_left = 1").select(*keys, F.col("_t").alias("a"), F.explode(F.array_distinct(F.array("_b", "_n"))).alias("b")).where("b IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("gap", "a", "b"))
    return both.withColumn("gap", F.abs(F.col("a") - F.col("b"))).withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "a", "b", "gap")


def selected(tracks: DataFrame, track: str, chosen: list[int]) -> DataFrame:
    """Rows of the chosen tracks, numbered from 0 in ``selected``. No choice, or one that isn't there, is an error."""
    if not chosen:
        raise ValueError("no track is chosen")
    own = sorted(set(chosen))
    there = {r[0] for r in tracks.where(F.col(track).isin(own)).select(track).distinct().collect()}  # as many as chosen
    if missing := [t for t in own if t not in there]:
        raise ValueError(f"tracks that this run doesn't have: {missing}")
    number = F.map_from_arrays(F.array(*[F.lit(t).cast("long") for t in own]), F.array(*[F.lit(k).cast("long") for k in range(len(own))]))
    return tracks.where(F.col(track).isin(own)).withColumn("selected", F.element_at(number, F.col(track).cast("long")))


def of_member(rows: DataFrame, member, single: str | None = None, pair: tuple[str, str] | None = None) -> DataFrame:
    """A report's rows about one member: where ``single`` is it, or a pair has it on either side."""
    if single:
        return rows.where(F.col(single) == member)
    return rows.where(F.array_contains(F.array(*pair), member))


def operation_counts(edits: DataFrame, run: list[str], op: str) -> DataFrame:
    """run, n, text: how many edits there were, and of each operation, in order of first use: "2 merges, 1 split"."""
    names = {"merge": "merge", "split": "split", "swap": "swap", "remove": "removal"}  # fixed values: how operations are called
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(op)], F.col(op))
    each = edits.groupBy(*run, name.alias("_name")).agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    said = F.concat(F.col("_n").cast("string"), F.lit(" "), F.col("_name"), F.when(F.col("_n") > 1, "s").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("_first", said.alias("s"))))
    return each.groupBy(*run).agg(F.sum("_n").alias("n"), F.array_join(parts["s"], ", ").alias("text"))


def coalesce_upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All keys of both; a new value that is null leaves the old one as it was."""
    values = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    return old.join(fresh, key, "full").select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def set_relations(left: DataFrame, right: DataFrame, group: list[str], item: str) -> DataFrame:
    """group, subset, equal: whether the left items of a group are all among its right ones, and the other way round as well. An empty side has no rows."""
    both = left.select(*group, item).distinct().withColumn("_l", F.lit(1)).join(right.select(*group, item).distinct().withColumn("_r", F.lit(1)), [*group, item], "full")
    lacks = lambda c: F.count_if(F.col(c).isNull())
    return both.groupBy(*group).agg((lacks("_r") == 0).alias("subset"), ((lacks("_r") == 0) & (lacks("_l") == 0)).alias("equal"))


def top_of_group(df: DataFrame, group: list[str], value: str, item: str, n: int = 3) -> DataFrame:
    """group, rank, item, value: each group's n largest values, ties to the smaller item."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), item)
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*group, "rank", item, value)


def longest(pose: DataFrame, run: list[str], joint: int = 0) -> DataFrame:
    """run, track, n: the track that shows a joint in most frames, the first of equal ones."""
    c = pose.where((F.col("joint") == joint) & F.col("x").isNotNull() & (F.col("c") >= 0.3)).groupBy(*run, "track").agg(F.count("*").alias("n"))
    return c.groupBy(*run).agg(F.max(F.struct("n", (-F.col("track")).alias("o"))).alias("m")).select(*run, (-F.col("m.o")).alias("track"), F.col("m.n").alias("n"))


def unit(feature: str | Column) -> Column:
    """The unit a feature is measured in, by its name (fixed values)."""
    f = F.col(feature) if isinstance(feature, str) else feature
    return (
        F.when(f.startswith("human_"), "external annotation")
        .when(f.endswith("_hz"), "Hz")
        .when(f.rlike("_fraction|_autocorr|_entropy|_flatness|_ratio|_flux"), "dimensionless")
        .when(f == "physical_limb_angle_range_rad", "radians")
        .when(f == "physical_wrist_acceleration_rms", "torso lengths / s²")
        .when(f.startswith("physical_"), "torso lengths")
        .otherwise("torso lengths / s")
    )


def run_label(name: str) -> Column:
    """When a run was made, from its folder's name (yyyyMMdd-HHmmss): "Mar 05 14:07"; another name stays as it is."""
    at = F.try_to_timestamp(F.col(name), F.lit("yyyyMMdd-HHmmss"))
    return F.coalesce(F.date_format(at, "MMM dd HH:mm"), F.col(name))
