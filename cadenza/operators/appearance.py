"""What a track looks like over time, from descriptors of its bodies: a few regions, each a histogram or null.

The descriptor itself comes from elsewhere. A track's reference changes by a
tenth of what each frame shows, so one frame in which somebody stands in front
doesn't replace it; the order of the frames matters, so a track is one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import hellinger

# How many parts of a reference stay for one new, and the distances above which two can't be one body in a frame, one track over a pause, or copies of one body.
STAY, MATCH, LINK, COPY = 9, 0.8, 0.6, 0.25


def distance(a: Column, b: Column) -> Column:
    """Mean Hellinger distance of two descriptors (array<array<double>>) over the regions that both have; null without one."""
    both = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    each = F.transform(both, lambda z: hellinger(z["a"], z["b"]))
    return F.aggregate(each, F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size(each), F.lit(0))


def _array(descriptor: list | None, like: np.ndarray) -> np.ndarray:
    out = np.full(like.shape, np.nan)
    for k, region in enumerate(descriptor or ()):
        if region is not None:
            out[k] = [np.nan if v is None else v for v in region]
    return out


def references(rows: DataFrame, keys: list[str], order: str, descriptor: str) -> DataFrame:
    """keys, order, before, reference of every row: a track's reference before it and after it, as array<array<double>>, null while nothing has been seen.

    A value that both have becomes nine parts of the old and one of the new; a
    value that one of them lacks is the other's. All descriptors of a track
    have the same regions and sizes. Rows of equal order come in any order.
    """
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, order])
    nested = pa.list_(pa.list_(pa.float64()))

    def listed(v: np.ndarray | None) -> list | None:
        return None if v is None else [None if np.isnan(r).all() else [None if np.isnan(x) else float(x) for x in r] for r in v]

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        seen = table.column(descriptor).to_pylist()
        size = max((len(r) for d in seen for r in d or () if r is not None), default=0)
        like = np.zeros((max((len(d) for d in seen if d is not None), default=0), size))
        now, before, after = None, [], []
        for d in seen:
            before.append(listed(now))
            if d is not None:
                new = _array(d, like)
                if now is None:
                    now = new
                else:
                    mixed = (STAY * now + new) / (STAY + 1)
                    now = np.where(np.isnan(new), now, np.where(np.isnan(now), new, mixed))
            after.append(listed(now))
        return table.select([*keys, order]).append_column("before", pa.array(before, nested)).append_column("reference", pa.array(after, nested))

    return rows.select(*keys, order, descriptor).groupBy(*keys).applyInArrow(walk, f"{kind}, before array<array<double>>, reference array<array<double>>")


def passes(before: Column, descriptor: Column, most: float = MATCH) -> Column:
    """Whether a descriptor may be of a track with this reference: it isn't further than ``most``; an unknown distance passes."""
    d = distance(before, descriptor)
    return d.isNull() | (d <= most)
