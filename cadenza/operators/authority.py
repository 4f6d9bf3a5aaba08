"""Who is who in every run: one derivation for all that asks.

Three layers, each with a stamp made of the stamp below and of what it adds:

* base: the tracker's or the source's own numbers;
* learned: joins that were frozen for one base. They count only for the stamp
  and version they were frozen for; a stale freeze is left out, not guessed at;
* manual: the run's log of edits, replayed in order.

All runs go through a layer together. A change of a lower layer changes the
stamps above it, and with a cache only runs whose stamp is new are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.identity import compact, one_each
from cadenza.plans.scratch import Scratch
from cadenza.sources.cache import StampedCache, stamp

#: Version of frozen joins.
VERSION = 1
EDITS = "run long, seq long, op string, groups array<array<long>>, person long, people array<long>, frame long, frames array<long>"
OPS = ("merge", "split", "swap", "remove")


def canonical(groups: Column) -> Column:
    """Merge groups without repeats, each sorted, of two members or more, in order."""
    each = F.transform(groups, lambda g: F.array_sort(F.array_distinct(g)))
    return F.array_sort(F.filter(each, lambda g: F.size(g) >= 2))


def _wrong(op: Column, groups: Column, person: Column, people: Column, n: Column) -> Column:
    """Why an edit can't be applied to a run of n persons, or null."""
    flat = F.flatten(groups)
    named = F.when(op == "merge", flat).when(op == "swap", people).otherwise(F.array(person))
    return (
        F.when(~op.isin(*OPS), F.concat(F.lit("no such edit: "), op))
        .when((op == "merge") & (F.size(F.array_distinct(flat)) != F.size(flat)), "a person can only be in one merge group")
        .when((op == "swap") & (F.coalesce(F.size(F.array_distinct(people)), F.lit(0)) != 2), "swap needs two different people")
        .when(F.exists(named, lambda p: p.isNull() | (p < 0) | (p >= n)), F.concat(op, F.lit(" refers to a person that is not shown")))
    )


def _next(persons: DataFrame, edit: DataFrame) -> DataFrame:
    """One edit of each run: edit has a row for every run of persons."""
    n = persons.groupBy("run").agg((F.coalesce(F.max("person"), F.lit(-1)) + 1).alias("_n"))
    e = edit.withColumn("groups", canonical("groups")).join(n, "run")
    wrong = _wrong(F.col("op"), F.col("groups"), F.col("person"), F.col("people"), F.col("_n"))
    e = e.withColumn("_ok", F.when(wrong.isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("run"), F.col("run").cast("string"), wrong)).cast("boolean")))
    e = e.select("run", "_n", "_ok", F.struct("op", "groups", "person", "people", "frame", "frames").alias("_e"))
    j = persons.join(e, "run")
    p, f = F.col("person"), F.col("frame")
    op, inside = F.col("_e.op"), F.col("frame").between(F.col("_e.frames")[0], F.col("_e.frames")[1])
    mine = F.filter("_e.groups", lambda g: F.array_contains(g, F.col("person")))
    new = (
        F.when((op == "merge") & p.isNotNull(), F.when(F.size(mine) > 0, mine[0][0]).otherwise(p))
        .when((op == "split") & (p == F.col("_e.person")) & (f >= F.col("_e.frame")), F.col("_n"))
        .when((op == "swap") & inside & (p == F.col("_e.people")[0]), F.col("_e.people")[1])
        .when((op == "swap") & inside & (p == F.col("_e.people")[1]), F.col("_e.people")[0])
        .when((op == "remove") & inside & (p == F.col("_e.person")), F.lit(None).cast("long"))
        .otherwise(p)
    )
    return one_each(compact(j.where("_ok").withColumn("person", new.cast("long")).select(persons.columns)))


def replay_runs(persons: DataFrame, edits: DataFrame, every: int = 4) -> DataFrame:
    """persons (run, frame, det, person, size) after each run's own log of edits, in order of seq.

    The k-th edits of all runs are applied together; runs whose log has ended
    are set aside, so the steps are as many as the longest log has. An edit that
    its run can't take is an error that names both. Equal seqs are an error too.
    """
    scratch = Scratch(persons.sparkSession, "replay")
    w = Window.partitionBy("run").orderBy("seq")
    log = scratch.save(edits.withColumn("_k", F.row_number().over(w)))
    if not log.groupBy("run", "seq").count().where("count > 1").isEmpty():
        raise ValueError("two edits of a run have one place in its log")
    last = log.agg(F.max("_k")).first()[0] or 0
    done = persons.join(log.select("run").distinct(), "run", "left_anti")
    live = persons.join(log.select("run").distinct(), "run", "left_semi")
    for k in range(1, last + 1):
        live = _next(live, log.where(F.col("_k") == k).drop("_k", "seq"))
        going = log.where(F.col("_k") == k + 1).select("run")
        if k % every == 0 and k < last:
            live = scratch.save(live)
        if k < last:
            done, live = done.unionByName(live.join(going, "run", "left_anti")), live.join(going, "run", "left_semi")
    return done.unionByName(live)


def freeze(groups: DataFrame, stamps: DataFrame, version: int = VERSION) -> DataFrame:
    """run, version, stamp, groups: learned joins (run, groups) bound to the base that they were learned on (run, stamp)."""
    return groups.join(stamps.select("run", "stamp"), "run").select("run", F.lit(version).alias("version"), "stamp", canonical("groups").alias("groups"))


def layers(stamps: DataFrame, frozen: DataFrame, edits: DataFrame, version: int = VERSION) -> DataFrame:
    """run, base_stamp, learned, learned_stamp, final_stamp, groups: which joins count and each layer's stamp.

    learned: applied, stale (frozen for another base or version) or none.
    """
    log = edits.groupBy("run").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "op", "groups", "person", "people", "frame", "frames")))).alias("_log"))
    j = stamps.select("run", F.col("stamp").alias("base_stamp")).join(frozen, "run", "left").join(log, "run", "left")
    good = (F.col("version") == version) & (F.col("stamp") == F.col("base_stamp"))
    use = F.when(good, canonical("groups"))
    j = j.withColumn("learned", F.when(F.col("version").isNull(), "none").when(good, "applied").otherwise("stale")).withColumn("groups", use)
    j = j.withColumn("learned_stamp", stamp(F.col("base_stamp"), F.to_json("groups")))
    return j.withColumn("final_stamp", stamp(F.col("learned_stamp"), F.col("_log"))).select("run", "base_stamp", "learned", "learned_stamp", "final_stamp", "groups")


def stable_tracks(persons: DataFrame, stamps: DataFrame, frozen: DataFrame, edits: DataFrame, version: int = VERSION, cache: StampedCache | None = None) -> DataFrame:
    """run, frame, det, base, person of every detection: base is its number before the manual edits, person after them; null for none.

    persons: run, frame, det, person, size (which of two detections of a person
    in a frame counts is the larger's). stamps: run, stamp of persons. A run
    without a stamp is an error of the caller: it has no rows here. With a
    cache, runs whose final stamp it has aren't derived again.
    """
    which = layers(stamps, frozen, edits, version)

    def make(only: DataFrame | None) -> DataFrame:
        runs = which if only is None else which.join(only, which["final_stamp"] == only["stamp"], "left_semi")
        mine = one_each(compact(persons.join(runs.select("run"), "run", "left_semi")))
        joins = runs.where(F.size("groups") > 0).select("run", F.lit(1).cast("long").alias("seq"), F.lit("merge").alias("op"), "groups", *[F.lit(None).cast(t).alias(c) for c, t in (("person", "long"), ("people", "array<long>"), ("frame", "long"), ("frames", "array<long>"))])
        base = Scratch(persons.sparkSession, "authority").save(replay_runs(mine, joins))
        final = replay_runs(base, edits.join(runs.select("run"), "run", "left_semi"))
        out = base.select("run", "frame", "det", F.col("person").alias("base"))
        return out.join(final.select("run", "frame", "det", "person"), ["run", "frame", "det"])

    if cache is None:
        return make(None)
    keys = which.select(F.col("run").cast("string").alias("key"), F.col("final_stamp").alias("stamp"))
    found = cache.derive(keys, lambda todo: make(todo.select("stamp")).withColumn("key", F.col("run").cast("string")))
    return found.drop("key", "stamp")


def fragments_of(tracked: DataFrame, fragments: DataFrame) -> DataFrame:
    """run, person, fragments: the automatic fragments behind each final person; a base track that was split counts for both parts, one with none for one.

    tracked: as ``stable_tracks`` gives; fragments: run, base, n.
    """
    pairs = tracked.where("person IS NOT NULL").select("run", "person", "base").distinct()
    j = pairs.join(fragments, ["run", "base"], "left")
    return j.groupBy("run", "person").agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).cast("long").alias("fragments"))
