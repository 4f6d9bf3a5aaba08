"""Column expressions on poses held as one row a joint, and on angles and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import VISIBLE


def seen() -> Column:
    """Whether a joint row is seen: a position, and enough confidence."""
    return F.col("x").isNotNull() & (F.col("c") >= VISIBLE)


def joint(j: int, of: str) -> Column:
    """In an aggregate over a body's joint rows: a column's value at one seen joint, else null."""
    return F.max(F.when((F.col("joint") == j) & seen(), F.col(of)))


def either(a: Column, b: Column) -> Column:
    """The middle of two values, or the one that is not null."""
    return F.coalesce((a + b) / 2, a, b)


def mean_at(joints: Sequence[int], of: str) -> Column:
    """In an aggregate: mean of a column over some seen joints."""
    return F.avg(F.when(F.col("joint").isin(*joints) & seen(), F.col(of)))


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two angles in degrees, 0 to 180."""
    return F.degrees(F.abs(F.atan2(F.sin(a - b), F.cos(a - b))))


def similarity(deviation: Column) -> Column:
    """100 / (1 + x); null where x is null, negative, or not a number."""
    return F.when((deviation >= 0) & (deviation < float("inf")), 100 / (1 + deviation))


def logistic(logit: Column) -> Column:
    """Probability of a logit, which is cut at 30 to both sides."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def soft(x: Column, by: float) -> Column:
    """Soft threshold."""
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def hellinger(a: Column, b: Column) -> Column:
    """Hellinger distance of two histograms (arrays that each sum to 1)."""
    root = F.aggregate(F.zip_with(a, b, lambda p, q: F.sqrt(p * q)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(1 - root, F.lit(0.0)))
