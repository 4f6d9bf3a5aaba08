"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time. Scaled so that its
integral is the source's target, it is the rate at which the source's words are
asked for; the rates of all sources at a time are the mix at that time, and
their summed integral is the cumulative demand, in words of training. A
document's place among its source's words is spent at the time at which its
source's integral reaches it; the demand of all sources by then is the
document's training position. The mix is the documents range-sorted by
position, repeated or cut where a source's target is not its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Documents of a source are laid out in so many hash ranges, so that one source's running sum is many small ones.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight, target of each source. ``sizes`` has source and source_size, one row a source.

    Sources by code point, null last, take the weights in turn. All words
    there are get shared by weight; a source gets at most most_epochs times
    its size, and what it can't take goes to the others by weight. Capping in
    order of size over weight gives that in one pass: the sources that are
    capped are those whose cap is reached before the level all others end at.
    """
    byte_order = F.hex(F.encode(F.col("source"), "UTF-8"))
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), byte_order)) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    cap = (F.lit(most_epochs) * F.col("source_size")).cast("double")
    x = (
        sizes.withColumn("weight", F.element_at(w, (n % len(weights) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("ratio", F.col("source").isNull(), byte_order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (
        x.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("words", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", (F.col("words") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("open_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), byte_order, "level"))).over(every)["level"])
    )
    target = F.least(F.col("cap"), F.col("weight") * F.col("open_level"))
    return x.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def ramp(start: float, end: float) -> tuple[float, float]:
    """A weight schedule that goes in a line from start to end over training time 0 to 1."""
    if start < 0 or end < 0 or start + end <= 0:
        raise ValueError("a schedule needs weights of 0 or more, not both 0")
    return start, end


def moment(share: Column, start: Column, end: Column) -> Column:
    """The training time at which a source has spent this share of its words: the inverse of the schedule's integral.

    The integral of start + (end - start) t from 0 to p, over its whole, is
    the share; p is the root of that quadratic, in the form that has no
    cancellation and no special case for a level schedule.
    """
    whole = (start + end) / 2
    need = share * whole
    root = F.sqrt(F.greatest(start * start + 2 * (end - start) * need, F.lit(0.0)))
    return F.coalesce(F.least(F.try_divide(2 * need, start + root), F.lit(1.0)), F.lit(0.0))


OUTPUTS = ("size", "source_size", "target", "uses", "taken")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    schedules: Sequence[tuple[float, float]] = (ramp(3, 1), ramp(1, 1), ramp(1, 3)),
    texts: bool = False,
) -> DataFrame:
    """The documents' columns, and size, source_size, target, taken, uses; text only if ``texts``.

    taken is the number of words the mix takes of the document, its repeats
    counted; uses array<struct<position, words>> lists its appearances: the
    training position, in words that all sources are asked for before it, and
    how many of its words, less than all only for the one document at which a
    source reaches its target. Documents of a source
    are laid out in order of a hash of their id and text, so reruns agree. A
    null source is a source; null and empty texts have size 0, are taken with
    0 words, and appear nowhere. Equal rows are laid out one after the other.
    An empty table gives an empty mix. Columns with an output's name give way.
    """
    d = (
        docs.drop(*OUTPUTS)
        .withColumn("size", word_count())
        .withColumn("_h", F.xxhash64("doc_id", "text"))
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn("_r", F.pmod(F.col("_h"), F.lit(RANGES)))
    )
    if not texts:
        d = d.drop("text")
    # Both uses of the blocks read the same columns, so that one aggregation serves both.
    blocks = d.groupBy("_s", "_r").agg(F.sum("size").alias("_words"))
    named = F.when(F.col("_s") != "", F.substr("_s", F.lit(2)))
    sizes = blocks.groupBy("_s").agg(F.sum("_words").alias("source_size")).select(named.alias("source"), "source_size")
    plan = targets(sizes, weights, most_epochs)
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.hex(F.encode(F.col("source"), "UTF-8")))) - 1
    plan = plan.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s"), "source_size", "target", (k % len(schedules)).cast("int").alias("_k"))
    first, last = (F.element_at(F.array(*[F.lit(float(s[j])) for s in schedules]), F.col("_k") + 1) for j in (0, 1))
    # Cumulative demand of all sources at a time: _linear times it and _square times its square.
    rate = F.col("target") / ((first + last) / 2)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a source
    plan = plan.withColumns({"_linear": F.sum(rate * first).over(every), "_square": F.sum(rate * (last - first) / 2).over(every)})
    order = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_s", "_r", F.coalesce(F.sum("_words").over(order), F.lit(0)).alias("_before"))
    grid = starts.join(plan, "_s")
    within = Window.partitionBy("_s", "_r").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    x = d.join(grid, ["_s", "_r"]).withColumn("_at", F.col("_before") + F.col("_in"))

    demand = F.round("target").cast("long")

    def use(epoch: Column) -> Column:
        at = F.col("_at") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - at))
        share = F.coalesce(F.try_divide(at.cast("double"), demand.cast("double")), F.lit(0.0))
        t = moment(share, first, last)
        return F.struct((F.col("_linear") * t + F.col("_square") * t * t).alias("position"), words.cast("long").alias("words"))

    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most_epochs - 1)), use), lambda u: u["words"] > 0)
    x = x.withColumn("uses", uses).withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"]))
    return x.drop("_h", "_s", "_r", "_k", "_before", "_in", "_at", "_linear", "_square")


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The training order itself: docs' rows and columns, once for each use, range-sorted by position."""
    own = {c: f"_own_{c}" for c in docs.columns if c in OUTPUTS}
    mixed = mix(docs.withColumnsRenamed(own), texts=True, **options)
    rows = mixed.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns], F.explode("uses.position").alias("_position"))
    return rows.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id").drop("_position")


def sequence(mixed: DataFrame) -> DataFrame:
    """The training order: a row for each use of a document (doc_id, position, words), range-sorted by position."""
    rows = mixed.select("doc_id", F.explode("uses").alias("u")).select("doc_id", "u.position", "u.words")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's share of the mix of all sources, in order of its first training position, then doc_id; documents that the mix doesn't take come first.

    Nulls, empty texts, ties and repeated rows: see ``mix``. The sort is by
    ranges of both, so that neither equal positions nor the documents without
    one are in one range.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    first = F.when(F.size("uses") > 0, F.col("uses")[0]["position"])
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return mixed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
