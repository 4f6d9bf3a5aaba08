"""Per-frame detection records in JSON Lines, labels in CSV, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.schema import JOINTS, RECORD, VISIBLE

# What labels are written as.
POSITIVE = ("dancer", "dance", "1", "true", "yes")
NEGATIVE = ("non_dancer", "non-dancer", "nondancer", "bystander", "0", "false", "no")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or many files; blank lines are skipped. run is the file's folder."""
    r = spark.read.schema(RECORD).json(path)
    return r.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def people(records: DataFrame) -> DataFrame:
    """records with people: taken from poses where a record has these instead. A record with neither is an error.

    Of a pose's landmarks those count that have four values and a joint's name; the fourth is the confidence.
    """
    joints = F.array(*[F.lit(j) for j in JOINTS])

    def person(p: Column, i: Column) -> Column:
        kept = F.map_filter(p["landmarks"], lambda k, v: F.array_contains(joints, k) & (F.size(v) >= 4))
        points = F.transform_values(kept, lambda k, v: F.array(v[0], v[1], v[3]))
        seen = F.filter(F.map_values(points), lambda v: v[2] >= VISIBLE)
        xs, ys = F.transform(seen, lambda v: v[0]), F.transform(seen, lambda v: v[1])
        box = F.when(F.size(seen) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        return F.struct(F.coalesce(p["id"], i.cast("bigint")).alias("id"), box.alias("bbox"), F.lit(None).cast("double").alias("conf"), points.alias("keypoints"))

    other = F.when(F.col("poses").isNotNull(), F.transform("poses", person)).otherwise(F.raise_error(F.lit("a record has neither people nor poses")).cast(records.schema["people"].dataType))
    return records.withColumn("people", F.coalesce("people", other))


def detections(records: DataFrame) -> DataFrame:
    """run, frame, t, det, id, bbox, conf, persistent, joints array<struct<x, y, c>>: a row a person, joints in fixed order, absent ones null.

    A missing id is the person's place, a missing conf 0. persistent holds if
    every record of the run that has people says its ids are tracks.
    """
    p = people(records)
    kept = p.where(F.size("people") > 0).groupBy("run").agg(F.bool_and(F.coalesce("id_type", F.lit("detection")) == "track").alias("persistent"))
    rows = p.select("run", "frame", "t", F.posexplode("people").alias("det", "p")).join(kept, "run")
    joints = F.array(*[F.struct(*[F.try_element_at(F.try_element_at(F.col("p.keypoints"), F.lit(j)), F.lit(k)).alias(n) for k, n in ((1, "x"), (2, "y"), (3, "c"))]) for j in JOINTS])
    return rows.select("run", "frame", "t", F.col("det").cast("long").alias("det"), F.coalesce("p.id", F.col("det")).alias("id"), "p.bbox", F.coalesce("p.conf", F.lit(0.0)).alias("conf"), "persistent", joints.alias("joints"))


def pose(dets: DataFrame, track: str = "id") -> DataFrame:
    """run, track, frame, t, joint, x, y, c of the joints that are there."""
    rows = dets.select("run", F.col(track).alias("track"), "frame", "t", F.posexplode("joints").alias("joint", "j"))
    return rows.select("run", "track", "frame", "t", "joint", "j.x", "j.y", "j.c").where("x IS NOT NULL AND NOT isnan(x)")


def label(column: str) -> Column:
    """1 or 0 for a label's spellings; anything else, null as well, is an error."""
    c = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    wrong = F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("int")
    return F.when(c.isin(*POSITIVE), 1).when(c.isin(*NEGATIVE), 0).otherwise(wrong)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """track_id, label of a CSV file with these columns; the last row of a track counts."""
    r = spark.read.schema("track_id long, label string").csv(path, header=True, enforceSchema=False)
    r = r.withColumn("_at", F.monotonically_increasing_id())
    return r.groupBy("track_id").agg(F.max_by("label", "_at").alias("label")).withColumn("label", label("label"))


def fingerprint(df: DataFrame, column: str) -> Column:
    """SHA-256 of a column's text."""
    return F.sha2(F.col(column).cast("binary"), 256)


def write_records(dets: DataFrame, path: str) -> None:
    """Detections back as records, one JSON line a frame, people in order of det."""
    names = F.array(*[F.lit(j) for j in JOINTS])
    there = F.filter(F.arrays_zip(names.alias("n"), F.col("joints").alias("j")), lambda z: z["j"]["x"].isNotNull())
    points = F.transform(there, lambda z: F.struct(z["n"].alias("n"), F.array(z["j"]["x"], z["j"]["y"], z["j"]["c"]).alias("p")))
    person = F.struct("det", "id", "bbox", "conf", points.alias("points"))  # maps can't be sorted, so they are made afterwards
    frames = dets.groupBy("run", "frame").agg(F.max("t").alias("t"), F.array_sort(F.collect_list(person)).alias("ps"))
    people = F.transform("ps", lambda p: F.struct(p["id"].alias("id"), p["bbox"].alias("bbox"), p["conf"].alias("conf"), F.map_from_entries(p["points"]).alias("keypoints")))
    frames.select("run", "frame", "t", people.alias("people")).write.partitionBy("run").json(path)
