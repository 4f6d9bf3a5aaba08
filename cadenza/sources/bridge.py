"""Views of general tables in the shapes of the motion tables.

pose is one row for each (run, track, frame, joint); body-wide operators group
it by (run, track, frame). signal is one row for each (track, i).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, track, frame, t, joint, x, y, c from embeddings: a label is a track, its vectors in order are frames."""
    e = table(spark, sf_dir, "embeddings").selectExpr(
        "CAST(0 AS BIGINT) AS run", "CAST(label AS BIGINT) AS track", "CAST(dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame", "embedding AS e"
    )
    return e.selectExpr("run", "track", "frame", "CAST(frame AS DOUBLE) / 30 AS t", "e", "explode(sequence(0, 16)) AS joint").selectExpr(
        "run", "track", "frame", "t", "joint", "CAST(e[3 * joint] AS DOUBLE) AS x", "CAST(e[3 * joint + 1] AS DOUBLE) AS y", "least(1D, abs(CAST(e[3 * joint + 2] AS DOUBLE)) * 8) AS c"
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, i, t, value, kind from events: a user is a track; errors are gaps."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS track",
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i",
        "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS t",
        "CASE WHEN event_type <> 'error' THEN value END AS value",
        "event_type AS kind",
        "event_id",
    )


def tracklets(spark: SparkSession, sf_dir: str, gap: float = 7200.0) -> DataFrame:
    """track, tracklet, t0, t1, n, centre from events: stretches of a user's events without a gap of over ``gap`` seconds."""
    from cadenza.operators.series import islands

    s = islands(signal(spark, sf_dir), ["track"], "t", gap, tie="i")
    return s.groupBy("track", F.col("island").alias("tracklet")).agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.avg("value").alias("centre")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, det, conf, size, key from lineitem: an order is a frame, its lines are detections."""
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS frame",
        f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS BIGINT) AS det",
        "l_discount * 10 AS conf",
        "l_quantity AS size",
        "CAST(l_linenumber AS BIGINT) AS id",
        "l_suppkey % 7 AS person",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, track, label, toxic, n_chars, lang from documents and labels: a source is a run, a document a track."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id").selectExpr("source AS run", "doc_id AS track", "CAST(quality AS INT) AS label", "CAST(toxic AS INT) AS toxic", "n_chars", "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, frame, person from conversations: a conversation is a run, a turn a frame, a role a person by number."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS run", "turn AS frame", "CAST(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS BIGINT) AS person", "CAST(length(text) AS BIGINT) AS size"
    )
