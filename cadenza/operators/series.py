"""Operators on series: rows in order within a group.

All windows are partitioned by the group's keys, so a series is the unit of
parallelism; frames are short, except for the running counts that number the
islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: str | list[str]):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def _back(keys: list[str], order: str):
    """The rows from the last one. What follows a row is a frame from the start here, which Spark keeps as it goes; a frame to the end it builds anew at every row."""
    return Window.partitionBy(*keys).orderBy(F.desc(order))


def moving_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str, by_range: bool = False) -> DataFrame:
    """Centred mean over width // 2 rows to both sides, nulls skipped; with by_range over so many steps of the order column.

    It fills nulls that have a value in reach and is null only where none is.
    """
    h = width // 2
    w = _by(keys, order)
    return df.withColumn(out, F.avg(value).over(w.rangeBetween(-h, h) if by_range else w.rowsBetween(-h, h)))


def gap_lengths(df: DataFrame, keys: list[str], order: str, value: str, out: str = "gap") -> DataFrame:
    """Length of the run of nulls that each row is in; 0 for rows with a value."""
    w = _by(keys, order)
    run = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_run", run)
    n = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys, "_run"))
    return df.withColumn(out, F.when(F.col(value).isNull(), n).otherwise(F.lit(0)).cast("long")).drop("_run")


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, out: str, most: int | None = None, least: int = 2) -> DataFrame:
    """Linear interpolation of nulls by the order column; before the first and after the last value, that value.

    Gaps of more than ``most`` rows stay null; so does every gap of a series
    with fewer than ``least`` values.
    """
    df = gap_lengths(df, keys, order, value, "_gap")
    w = _by(keys, order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    df = df.withColumn("_lo", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_hi", F.last(at, ignorenulls=True).over(_back(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(value).over(Window.partitionBy(*keys))
    part = (F.col(order) - F.col("_lo.o")) / F.nullif(F.col("_hi.o") - F.col("_lo.o"), F.lit(0))
    line = F.coalesce(F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * part, F.col("_lo.v"), F.col("_hi.v"))
    fills = (n >= least) & (F.lit(most is None) | (F.col("_gap") <= (most or 0)))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(fills, line)).drop("_gap", "_lo", "_hi")


def smooth_gaps(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 5, most: int = 8) -> DataFrame:
    """Short gaps filled, then a moving mean; what is null after filling stays null. A series with fewer than two values is left as it is."""
    df = interpolate(df, keys, order, value, "_f", most, 2)
    df = moving_mean(df, keys, order, "_f", width, "_s")
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(n < 2, F.col(value)).when(F.col("_f").isNotNull(), F.col("_s"))).drop("_f", "_s")


def islands(df: DataFrame, keys: list[str], time: str, gap: float | Column, tie: str | None = None, broken: Column | None = None, out: str = "island") -> DataFrame:
    """Numbers stretches of rows, from 0: a row begins one if it is more than ``gap`` after the row before, or ``broken`` holds there."""
    w = _by(keys, [time, tie] if tie else time)
    step = F.col(time) - F.lag(time).over(w)
    new = step > gap
    if broken is not None:
        new = new | broken
    df = df.withColumn("_new", F.when(new, 1).otherwise(0))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def separated_peaks(df: DataFrame, keys: list[str], time: str, score: str, keep: list[str], most: int = 3, apart: float = 1.0, by_time: bool = False) -> DataFrame:
    """Up to ``most`` rows of each group by falling score, each at least ``apart`` from the ones taken before; ties by time.

    A group's scored rows are folded as one sorted array, so a group must fit
    a task: it is one entity's frames, not a corpus.
    """
    row = F.struct((-F.col(score)).alias("_neg"), F.col(time).alias("_t"), *keep)
    kind = df.where(F.col(score).isNotNull()).select(row.alias("r"))
    packed = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.lit(None).cast(f"array<{kind.schema['r'].dataType.simpleString()}>")

    def take(acc: Column, r: Column) -> Column:
        free = F.forall(acc, lambda a: F.abs(a["_t"] - r["_t"]) >= apart)
        return F.when((F.size(acc) < most) & free, F.array_append(acc, r)).otherwise(acc)

    folded = F.aggregate("rows", F.coalesce(none, F.slice("rows", 1, 0)), take)
    if by_time:
        folded = F.array_sort(folded, lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).otherwise(0))
    out = packed.select(*keys, F.posexplode(folded).alias("rank", "r"))
    return out.select(*keys, (F.col("rank") + 1).cast("long").alias("rank"), F.col("r._t").alias(time), (-F.col("r._neg")).alias(score), *[F.col(f"r.{k}").alias(k) for k in keep])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str = "nearest") -> DataFrame:
    """To each left row the right row of its group that is nearest in time, the earlier of two as near: {out}_t, {out}.

    Both sides are one sorted union, so no row is paired with more than its two neighbours.
    """
    cols = left.columns
    both = left.withColumn("_rt", F.lit(None).cast("double")).withColumn("_rv", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    other = right.select(*keys, time, F.col(time).alias("_rt"), F.col(value).alias("_rv"))
    both = both.unionByName(other.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = _by(keys, time)
    at = F.when(F.col("_rt").isNotNull(), F.struct("_rt", "_rv"))
    # Range frames, so that rows of the same time see each other; of equal right times the smallest value counts.
    before = F.max(F.when(F.col("_rt").isNotNull(), F.struct("_rt", (-F.col("_rv")).alias("n")))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(at).over(_back(keys, time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_b", before).withColumn("_a", after).where("_left")
    early = (F.col("_a").isNull()) | (F.col(time) - F.col("_b._rt") <= F.col("_a._rt") - F.col(time))
    both = both.withColumn(f"{out}_t", F.when(F.col("_b").isNotNull() & early, F.col("_b._rt")).otherwise(F.col("_a._rt")))
    both = both.withColumn(out, F.when(F.col("_b").isNotNull() & early, -F.col("_b.n")).otherwise(F.col("_a._rv")))
    return both.select(*cols, f"{out}_t", out)


def resample(source: DataFrame, times: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """The source series at other times, by linear interpolation: null outside its range, and where either neighbour is null.

    An exact hit counts as the upper neighbour, so it needs the one before as
    well; only the first time of the source, which has none, pairs with the second.
    """
    cols = times.columns
    s = source.select(*keys, F.col(time).alias("_st"), F.col(value).alias("_sv"))
    w = _by(keys, "_st")
    s = s.withColumn("_pt", F.lag("_st").over(w)).withColumn("_pv", F.lag("_sv").over(w)).withColumn("_nt", F.lead("_st").over(w)).withColumn("_nv", F.lead("_sv").over(w))
    marks = s.select(*keys, F.col("_st").alias(time), F.struct("_st", "_sv", "_pt", "_pv", "_nt", "_nv").alias("_m"))
    both = times.withColumn("_own", F.lit(True)).unionByName(marks.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    up = F.min("_m").over(_back(keys, time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_u", up).where("_own")
    first = F.col("_u._pt").isNull()
    lo_t, lo_v = F.when(first, F.col("_u._st")).otherwise(F.col("_u._pt")), F.when(first, F.col("_u._sv")).otherwise(F.col("_u._pv"))
    hi_t, hi_v = F.when(first, F.col("_u._nt")).otherwise(F.col("_u._st")), F.when(first, F.col("_u._nv")).otherwise(F.col("_u._sv"))
    part = F.least(F.greatest((F.col(time) - lo_t) / F.greatest(hi_t - lo_t, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    inside = F.when(first, F.col(time) == F.col("_u._st")).otherwise(F.lit(True))
    return both.withColumn(out, F.when(inside, lo_v + (hi_v - lo_v) * part)).select(*cols, out)


def time_bins(df: DataFrame, keys: list[str], index: str, value: str, bins: int = 2000) -> DataFrame:
    """keys, bin, mean value and rows of at most ``bins`` stretches of equal length in rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_stride", F.ceil(F.col("_n") / bins))
    j = df.join(n, keys).withColumn("bin", F.floor(F.col(index) / F.col("_stride")).cast("long"))
    return j.groupBy(*keys, "bin").agg(F.avg(value).alias(value), F.count("*").alias("rows"))


def unwrap(df: DataFrame, keys: list[str], order: str, angle: str, out: str) -> DataFrame:
    """Angles without jumps of over pi: a running sum of whole turns; a step of exactly pi stays as it is."""
    import math

    w = _by(keys, order)
    d = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(F.abs(d) > math.pi, -2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))).otherwise(0.0)
    df = df.withColumn("_turn", F.coalesce(turn, F.lit(0.0)))
    return df.withColumn(out, F.col(angle) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")
