"""Queries of the selection operators, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadenza.operators import selection
from cadenza.plans.motion_queries import rounded
from cadenza.plans.oracle import with_views
from cadenza.sources import bridge


def angle_span(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).withColumn("a", F.atan2(F.sin("value"), F.cos("value")))
    return rounded(selection.angle_span(s, ["track"], "i", "a"), "span")


def change_rms(spark, sf_dir):
    return rounded(selection.change_rms(bridge.signal(spark, sf_dir), ["track"], "i", "value", 30.0), "rms", digits=4)


def nearest_frame(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).select("track", "i", F.floor("t").alias("s"))
    asked = s.groupBy("track").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select("track", F.explode(F.array(F.col("lo") - 10, F.floor((F.col("lo") + F.col("hi")) / 2), F.col("hi") + 10)).alias("moment"))
    return selection.nearest_row(s, asked, ["track"], "s", "moment").select("track", "moment", "s")


def nearest_eight(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).select("track", F.floor("t").alias("s"), "kind")
    return selection.nearest_k(s.where("kind = 'purchase'").select("track", "s").distinct(), s.where("kind = 'click'").select("track", "s").distinct(), ["track"], "s", "s", 8)


def selected_tracks(spark, sf_dir):
    p = bridge.pose(spark, sf_dir)
    return selection.selected(p, "track", [7, 2, 5]).groupBy("selected", "track").agg(F.count("*").alias("n"))


def pair_report(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    pairs = t.select("run", F.col("person").alias("a"), "frame").join(t.select("run", F.col("person").alias("b"), (F.col("frame") - 1).alias("frame")), ["run", "frame"])
    return selection.of_member(pairs, 2, pair=("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def operation_counts(spark, sf_dir):
    op = F.element_at(F.array(*[F.lit(x) for x in ("merge", "split", "swap", "remove")]), (F.col("event_id") % 4 + 1).cast("int"))
    return selection.operation_counts(bridge.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), op.alias("op"), F.col("event_id").alias("seq")), ["run"], "op")


def coalesce_upsert(spark, sf_dir):
    d, q = bridge.table(spark, sf_dir, "documents"), bridge.table(spark, sf_dir, "labels")
    old = d.select("doc_id", F.col("n_chars").alias("size"), "lang")
    new = q.select("doc_id", F.when(F.col("toxic") == 1, F.lit(0).cast("long")).alias("size"), F.when(F.col("quality") == 0, "low").alias("lang"))
    return selection.coalesce_upsert(old, new, ["doc_id"])


def set_relations(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir)
    return selection.set_relations(r.where("label = 1"), r, ["run"], "lang")


def top_joints(spark, sf_dir):
    p = bridge.pose(spark, sf_dir).withColumn("c", F.round("c", 6))
    return selection.top_of_group(p, ["track", "frame"], "c", "joint", 3)


def longest_track(spark, sf_dir):
    return selection.longest(bridge.pose(spark, sf_dir), ["run"])


def feature_units(spark, sf_dir):
    names = ("human_", "physical_", "physical_limb_angle_range_rad", "physical_wrist_acceleration_rms", "time_", "freq_dominant_hz", "freq_entropy_", "tf_flux_", "a_ratio", "x_flux", "y_fraction")
    own = F.concat(F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int")), F.when(F.col("event_id") % 3 == 0, "_hz").otherwise(""))
    return bridge.table(spark, sf_dir, "events").select(own.alias("feature")).groupBy("feature", selection.unit("feature").alias("unit")).agg(F.count("*").alias("n"))


def run_labels(spark, sf_dir):
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("run"), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyyMMdd-HHmmss"))
    return bridge.table(spark, sf_dir, "events").select("event_id", name.alias("name")).select("event_id", selection.run_label("name").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        angle_span, change_rms, nearest_frame, nearest_eight, selected_tracks, pair_report, operation_counts, coalesce_upsert, set_relations, top_joints, longest_track,
        feature_units, run_labels,
    )
}

_NAMES = "['human_', 'physical_', 'physical_limb_angle_range_rad', 'physical_wrist_acceleration_rms', 'time_', 'freq_dominant_hz', 'freq_entropy_', 'tf_flux_', 'a_ratio', 'x_flux', 'y_fraction']"

ORACLE_SQL = {
    "angle_span": with_views(
        "signal",
        f"""SELECT track, round(max(u) - min(u), 6) AS span FROM (
        SELECT track, a + sum(CASE WHEN abs(d) > {math.pi} THEN -2 * {math.pi} * floor((d + {math.pi}) / (2 * {math.pi})) ELSE 0 END) OVER (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING) AS u
        FROM (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY track ORDER BY i), 0) AS d FROM (SELECT track, i, atan2(sin(value), cos(value)) AS a FROM signal WHERE value IS NOT NULL))) GROUP BY track""",
    ),
    "change_rms": with_views("signal", "SELECT track, round(sqrt(avg(d * d)), 4) AS rms FROM (SELECT track, (value - lag(value) OVER (PARTITION BY track ORDER BY i)) * 30.0 AS d FROM signal WHERE value IS NOT NULL) GROUP BY track"),
    "nearest_frame": with_views(
        "signal",
        "SELECT track, moment, s FROM (SELECT a.track, a.moment, s.s, row_number() OVER (PARTITION BY a.track, a.moment ORDER BY abs(s.s - a.moment), s.s) AS r FROM (SELECT DISTINCT * FROM a) a JOIN s USING (track)) WHERE r = 1",
        s="SELECT track, CAST(floor(t) AS BIGINT) AS s FROM signal",
        a="SELECT track, unnest([lo - 10, (lo + hi) // 2, hi + 10]) AS moment FROM (SELECT track, min(s) AS lo, max(s) AS hi FROM s GROUP BY track)",
    ),
    "nearest_eight": with_views(
        "signal",
        "SELECT track, CAST(rank AS INTEGER) AS rank, a, b, gap FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY gap, a, b) AS rank FROM n) WHERE rank <= 8",
        s="SELECT DISTINCT track, CAST(floor(t) AS BIGINT) AS s, kind FROM signal",
        n="""SELECT DISTINCT l.track, l.s AS a, r.s AS b, abs(l.s - r.s) AS gap FROM s l JOIN s r ON r.track = l.track AND l.kind = 'purchase' AND r.kind = 'click'
        WHERE r.s = (SELECT max(x.s) FROM s x WHERE x.track = l.track AND x.kind = 'click' AND x.s <= l.s) OR r.s = (SELECT min(x.s) FROM s x WHERE x.track = l.track AND x.kind = 'click' AND x.s >= l.s)""",
    ),
    "selected_tracks": with_views("pose", "SELECT CASE track WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE 2 END::BIGINT AS selected, track, count(*) AS n FROM pose WHERE track IN (2, 5, 7) GROUP BY ALL"),
    "pair_report": with_views("turns", "SELECT a.person AS a, b.person AS b, count(*) AS n FROM turns a JOIN turns b ON a.run = b.run AND b.frame = a.frame + 1 WHERE a.person = 2 OR b.person = 2 GROUP BY ALL"),
    "operation_counts": """SELECT run, CAST(sum(n) AS BIGINT) AS n, string_agg(n || ' ' || name || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY first) AS text FROM (
        SELECT user_id AS run, ['merge', 'split', 'swap', 'removal'][event_id % 4 + 1] AS name, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY run""",
    "coalesce_upsert": """SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 0::BIGINT END, n_chars) AS size, coalesce(CASE WHEN quality = 0 THEN 'low' END, lang) AS lang FROM documents FULL JOIN labels USING (doc_id)""",
    "set_relations": with_views(
        "reviews",
        "SELECT run, count(*) FILTER (l AND NOT r) = 0 AS subset, count(*) FILTER (l <> r) = 0 AS equal FROM x GROUP BY run",
        x="SELECT run, lang, bool_or(label = 1) AS l, true AS r FROM reviews GROUP BY ALL",
    ),
    "top_joints": with_views("pose", "SELECT track, frame, CAST(rank AS INTEGER) AS rank, joint, c FROM (SELECT track, frame, joint, round(c, 6) AS c, row_number() OVER (PARTITION BY track, frame ORDER BY round(c, 6) DESC, joint) AS rank FROM pose) WHERE rank <= 3"),
    "longest_track": with_views("pose", "SELECT 0::BIGINT AS run, track, n FROM (SELECT track, count(*) AS n FROM pose WHERE joint = 0 AND px IS NOT NULL GROUP BY track) ORDER BY n DESC, track LIMIT 1"),
    "feature_units": f"""SELECT feature, CASE WHEN feature LIKE 'human\\_%' ESCAPE '\\' THEN 'external annotation' WHEN feature LIKE '%\\_hz' ESCAPE '\\' THEN 'Hz'
        WHEN regexp_matches(feature, '_fraction|_autocorr|_entropy|_flatness|_ratio|_flux') THEN 'dimensionless' WHEN feature = 'physical_limb_angle_range_rad' THEN 'radians'
        WHEN feature = 'physical_wrist_acceleration_rms' THEN 'torso lengths / s²' WHEN feature LIKE 'physical\\_%' ESCAPE '\\' THEN 'torso lengths' ELSE 'torso lengths / s' END AS unit, count(*) AS n
        FROM (SELECT {_NAMES}[event_id % 11 + 1] || CASE WHEN event_id % 3 = 0 THEN '_hz' ELSE '' END AS feature FROM events) GROUP BY ALL""",
    "run_labels": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'run' || event_id ELSE strftime(ts, '%b %d %H:%M') END AS label FROM events",
}
