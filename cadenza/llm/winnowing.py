"""Document fingerprints by winnowing, in DataFrame expressions.

Every K consecutive code points of a text are a gram, which begins at every
character: one pass of a look-ahead pattern takes them all, and each is hashed.
Of every WINDOW consecutive grams the one with the smallest hash is kept, the
rightmost of equal ones, with its place in the text; minima of windows are
reached by doubling. Two texts that share a stretch of WINDOW + K - 1
characters share a kept gram, wherever the stretch stands in either.

Texts are worked on in segments, whose characters overlap by a window's reach,
so what a long text needs on the way does not grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram and grams of a window, a power of two.
K = WINDOW = 16
REACH = K + WINDOW - 1
#: Windows of a segment.
SEGMENT = 1 << 14
#: A gram is ranked by bits 31 to 62 of its hash, above its place in the segment counted down.
_PLACE = (1 << 31) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _minima(ranks: Column) -> Column:
    """Of the WINDOW ranks from each place on the smallest; of fewer at the end."""
    reach = 1
    while reach < WINDOW:
        after = F.lit(reach + 1)
        ranks = _let(ranks, lambda v: F.zip_with(v, F.slice(v, after, F.size(v)), lambda a, b: F.least(a, b)))  # noqa: B023
        reach *= 2
    return ranks


def _segment(text: Column, begin: Column) -> Column:
    """Kept grams of the windows of one segment, in order: its text, of K characters at least, from ``begin`` on."""
    place = lambda x: (F.lit(_PLACE).cast("long") - x.bitwiseAND(F.lit(_PLACE))).cast("int")

    def of_grams(g: Column) -> Column:
        ranks = F.transform(g, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~_PLACE & ((1 << 63) - 1))).bitwiseOR(F.lit(_PLACE).cast("long") - i))
        least = F.array_distinct(F.slice(_minima(ranks), F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))))
        return F.transform(least, lambda x: F.struct((begin + place(x)).alias("place"), F.xxhash64(F.get(g, place(x))).alias("hash")))

    return _let(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{K}}}))."), F.lit(1)), of_grams)


def kept_grams(text: Column | str) -> Column:
    """array<struct<place int, hash long>>: a text's kept grams in order of their place, which counts code points from 0.

    A text with fewer than K characters is one gram; one with fewer than
    WINDOW grams is one window; a null or empty text has an empty array.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def joined(text: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.length(text) - REACH, F.lit(0)), F.lit(SEGMENT))
        parts = F.flatten(F.transform(begins, lambda b: _segment(F.substring(text, b + 1, F.lit(SEGMENT + REACH - 1)), b)))
        # A gram may be kept by the last window of a segment and the first one of the next.
        one = lambda k: F.filter(k, lambda x, i: (i == 0) | (x["place"] != F.get(k, i - 1)["place"]))
        return F.when(F.length(text) >= K, _let(parts, one))

    whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(text).alias("hash")))
    return F.coalesce(_let(text, joined), F.slice(whole, F.lit(1), F.least(F.length(text), F.lit(1))))


def kept_after_edit(kept: str, edited: str, same: Column) -> Column:
    """kept_grams of ``edited``, whose first ``same`` characters are those of the text that has ``kept``.

    Only what follows the last window inside of these characters is read: the
    places that windows keep never go back, so up to that window's own the
    grams are the text's.
    """

    def moved(begin: Column) -> Column:
        rest = kept_grams(F.substring(F.col(edited), begin + 1, F.length(edited)))
        return F.transform(rest, lambda x: F.struct((x["place"] + begin).alias("place"), x["hash"].alias("hash")))

    def joined(begin: Column, m: Column) -> Column:
        # A text of one window has no window before the place where the rest begins.
        before = F.when(begin > 0, F.get(m, F.lit(0))["place"]).otherwise(F.lit(0))
        return F.concat(_let(before, lambda p: F.filter(kept, lambda x: x["place"] < p)), m)

    return _let(F.greatest(same - REACH, F.lit(0)), lambda b: _let(moved(b), lambda m: joined(b, m)))


def hashes(kept: str) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(kept, lambda x: x["hash"]))


def text_form(kept: str) -> Column:
    """A fingerprint as text: hash in hexadecimal, colon, place of the gram, comma-joined."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["place"].cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(F.try_divide(both.cast("double"), every.cast("double")))


def _ranges(cuts: list[int]) -> Callable[[Column, Column], Column]:
    """Number of the range of a key and a hash. A cut that is listed r times begins r ranges, which deal its rows by their hash.

    The cuts are searched in chunks: two short lists for each row instead of one long one.
    """
    values = sorted(set(cuts))
    if not values:
        return lambda k, h: F.lit(0)
    times = [cuts.count(v) for v in values]
    first = [1 + sum(times[:j]) for j in range(len(values))]
    side = max(1, int(len(values) ** 0.5))
    chunks = [values[j : j + side] for j in range(0, len(values), side)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    heads, lists = longs([c[0] for c in chunks]), F.array(*[longs(c) for c in chunks])
    of = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(f).alias("first"), F.lit(t).alias("times")) for v, f, t in zip(values, first, times, strict=True)])

    def number(k: Column, h: Column) -> Column:
        within = lambda c: c * side + F.size(F.filter(F.get(lists, c), lambda v: v <= k)) - 1
        cut = _let(F.size(F.filter(heads, lambda v: v <= k)) - 1, lambda c: F.get(of, within(c)))
        share = F.floor((h / F.lit(float(1 << 64)) + 0.5) * cut["times"]).cast("int")
        part = F.when(cut["v"] == k, F.least(share, cut["times"] - 1)).otherwise(cut["times"] - 1)
        return F.when(k < values[0], F.lit(0)).otherwise(cut["first"] + part)

    return number


def with_next(docs: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, buckets: int | None = None) -> DataFrame:
    """Every row, with next: struct of ``columns`` of the row that follows in order of doc_id (nulls first), then of the text's hash; the first after the last.

    The ids are cut into ranges at approximate quantiles (a list of a fixed
    number); an id that many rows have, or null, is several ranges of the
    hash. A copy of each range's first row joins the range before as its end,
    so that every range finds its next rows by itself. ``prepare`` adds columns
    once the rows are dealt, so that these aren't shuffled. Rows with the same
    id and text follow each other in any order and share a range. The columns
    _k, _t, _b, _end and _first are used on the way.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("_t", F.xxhash64("text"))
    cuts = sorted(int(x) for x in d.select("_k").approxQuantile("_k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)) if buckets > 1 else []
    d = d.withColumn("_b", _ranges(cuts)(F.col("_k"), F.col("_t"))).withColumn("_end", F.lit(False))
    firsts = sorted((r["_b"], r.m.k, r.m.t) for r in d.groupBy("_b").agg(F.min(F.struct(F.col("_k").alias("k"), F.col("_t").alias("t"))).alias("m")).collect())  # a row a range
    if firsts:
        whole = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t"), F.lit(firsts[i - 1][0]).alias("to")) for i, (_, k, t) in enumerate(firsts)])
        ends = d.join(F.broadcast(spark.range(1).select(F.inline(whole))), (F.col("_k") == F.col("k")) & (F.col("_t") == F.col("t")))
        ends = ends.withColumn("_b", F.col("to")).withColumn("_end", F.lit(True)).select(d.columns)
        d = d.union(ends)
    order = Window.partitionBy("_b").orderBy("_end", "_k", "_t", "text")
    d = prepare(d.repartition("_b"))
    return d.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("NOT _end").drop("_k", "_t", "_b", "_end")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness.

    Null texts are empty; an empty text has no gram, an empty fingerprint, and
    a likeness of 1 to another empty one and 0 to any other. Of repeated
    doc_ids, the one with the smaller hash of its text comes first.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(docs, ["text", "kept"], lambda x: x.withColumn("kept", kept_grams("text")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", n - cut), F.left(F.col("next.text"), cut)))
    d = d.withColumn("edited_kept", kept_after_edit("kept", "edited", n - cut))
    d = d.withColumns({"own": hashes("kept"), "edited_own": hashes("edited_kept"), "next_own": hashes("next.kept")})
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form("kept").alias("fingerprint"),
        text_form("edited_kept").alias("edited_fingerprint"),
        likeness("own", "edited_own").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
