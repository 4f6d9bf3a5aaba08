"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component of every node with an edge: the smallest node it reaches.

    ``edges`` has the long columns a and b. Large stars point each node's
    larger neighbours to its smallest one, small stars the smaller ones; the
    rounds end when the edges are stars around each component's smallest node.
    Every round is written to the shared folder, so lineage stays short.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e)
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    seen = e.agg(mark.alias("m")).first()["m"]
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small)
        scratch.drop(e)
        e, last = new, seen
        seen = e.agg(mark.alias("m")).first()["m"]
        if seen == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
