"""Queries of the operators that go over all runs together, each with its SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import appearance, authority, features, identity, inventory, prediction, stitching, tracking
from cadenza.operators.snapshots import Store
from cadenza.plans.motion_queries import _JOINTS_XY, rounded
from cadenza.plans.oracle import with_views
from cadenza.plans.scratch import shared_dir
from cadenza.sources import bridge
from cadenza.sources.cache import StampedCache, cached_scan, stamp


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _identities(spark, sf_dir):
    """Persons of all conversations, their stamps, frozen joins of every third (half of them stale), and logs of edits of the odd ones."""
    turns = bridge.turns(spark, sf_dir).withColumn("det", F.lit(0).cast("long")).select("run", "frame", "det", "person", "size")
    persons = identity.one_each(identity.compact(turns))
    runs = persons.groupBy("run").agg(F.max("person").alias("top"), F.sum("size").alias("size"))
    stamps = runs.select("run", stamp(F.col("run"), F.col("size")).alias("stamp"))
    joins = runs.where("run % 3 = 0 AND top >= 1").select("run", F.expr("array(array(0L, 1L, 1L))").alias("groups"))
    frozen = authority.freeze(joins, stamps).withColumn("stamp", F.when(F.col("run") % 2 == 0, F.col("stamp")).otherwise("of another base"))
    steps = F.expr(
        "array(named_struct('seq', 1L, 'op', 'split', 'person', 0L, 'frame', 2L, 'frames', CAST(NULL AS ARRAY<BIGINT>)), named_struct('seq', 2L, 'op', 'split', 'person', 0L, 'frame', 1L, 'frames', NULL), "
        "named_struct('seq', 3L, 'op', 'remove', 'person', 0L, 'frame', NULL, 'frames', array(0L, 0L)))"
    )
    log = runs.where("run % 2 = 1").select("run", F.explode(F.when(F.col("run") % 4 == 1, steps).otherwise(F.slice(steps, 1, 1))).alias("e"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("groups", "array<array<bigint>>"), ("people", "array<bigint>"))]
    edits = log.select("run", "e.seq", "e.op", none[0], "e.person", none[1], "e.frame", "e.frames")
    return persons, stamps, frozen, edits


def stable_tracks(spark, sf_dir):
    out = authority.stable_tracks(*_identities(spark, sf_dir))
    return out.select("run", "frame", "base", "person")


def cached_tracks(spark, sf_dir):
    """The same by way of a cache: the second time, nothing is derived, and what comes out is the cache's."""
    cache = StampedCache(spark, _folder(spark, "tracks"))
    authority.stable_tracks(*_identities(spark, sf_dir), cache=cache)
    return authority.stable_tracks(*_identities(spark, sf_dir), cache=cache).select("run", "frame", "base", "person")


def identity_layers(spark, sf_dir):
    _, *rest = _identities(spark, sf_dir)
    return authority.layers(*rest).groupBy("learned").agg(F.count("*").alias("runs"), F.countDistinct("final_stamp").alias("stamps"))


def stitched_runs(spark, sf_dir):
    """Tracklets of every user's events, joined over pauses of up to a day: a minute is a frame, a stretch without an hour's pause a tracklet."""
    s = bridge.signal(spark, sf_dir).select(F.col("track").alias("run"), F.floor(F.col("t") / 60).alias("frame"), "i", "value")
    one = s.groupBy("run", "frame").agg(F.avg("value").alias("x"), F.count("*").alias("n"))
    from cadenza.operators.series import islands

    dets = islands(one, ["run"], "frame", 60, tie="n").select("run", "frame", F.lit(0).cast("long").alias("det"), F.col("island").alias("tracklet"), "x", F.lit(0.0).alias("y"), (F.col("n") * 50.0).alias("size"), F.lit(None).cast("double").alias("extent"))
    return stitching.stitch(dets, fps=60.0, max_gap=1440, most=2.0, least=3)


def _frame_costs(spark, sf_dir):
    d = bridge.detections(spark, sf_dir)
    a, b = d.select("frame", F.col("det").alias("a"), "size", "conf"), d.select((F.col("frame") + 1).alias("frame"), F.col("det").alias("b"), F.col("size").alias("size_b"), F.col("conf").alias("conf_b"))
    return a.join(b, "frame").select("frame", "a", "b", (F.abs(F.col("size") - F.col("size_b")) / 10 + F.abs(F.col("conf") - F.col("conf_b"))).alias("cost"))


def frame_assignment(spark, sf_dir):
    """How many bodies of each frame continue one of the frame before, and at what cost."""
    got = tracking.frame_assignment(_frame_costs(spark, sf_dir), ["frame"], 1.0)
    return rounded(got.groupBy("frame").agg(F.count("*").alias("pairs"), F.sum("cost").alias("cost")), "cost", digits=5)


def cached_scan_types(spark, sf_dir):
    """The events, parsed file by file through a cache."""
    root, path = _folder(spark, "scan"), f"{sf_dir}/events.parquet"
    rows = cached_scan(spark, path, root, lambda files: spark.read.parquet(*files).select("event_type", "value", "_metadata.file_path", "_metadata"))
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=3)


def snapshot_view(spark, sf_dir):
    """Labels and scores of all sources, committed together: a first import, a second one of half the runs, a snapshot that is saved twice, and what one commit shows of them."""
    r, store = bridge.reviews(spark, sf_dir), Store(spark, _folder(spark, "registry"))
    labels = r.select("run", F.lit("s").alias("signature"), F.col("track").alias("track_id"), "label")
    store.import_reviews(labels)
    store.import_reviews(labels.where("conv(substr(sha2(run, 256), 1, 2), 16, 10) % 2 = 0").withColumn("label", 1 - F.col("label")).where("track_id % 3 <> 0"))
    tracks = r.select("run", F.col("track").alias("track_id"), "n_chars", (F.col("toxic") + F.col("n_chars") / 1000).alias("score"))
    names = [x["run"] for x in tracks.select("run").distinct().orderBy("run").collect()]  # the cohort: a name a run
    for tick in (1, 2):
        store.save_snapshot({"runs": names, "updated_at": tick}, {"predictions": tracks})
    now = store.view()
    got = store.snapshot(["predictions"])
    j = got["tables"]["predictions"].join(store.reviews(now), ["run", "track_id"], "left")
    # Scores are added in order of their tracks: a mean that ends in a five after four digits would else be rounded by how rows were dealt.
    order = Window.partitionBy("run").orderBy("track_id", "score")
    j = j.withColumns({"_n": F.row_number().over(order), "_sum": F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    score = F.max_by("_sum", "_n") / F.nullif(F.count("score"), F.lit(0))
    out = j.groupBy("run").agg(F.count("*").alias("tracks"), F.count("label").alias("labelled"), F.sum("label").alias("positive"), score.alias("score"))
    return rounded(out.withColumn("snapshot", F.lit(got["number"]).cast("long")), "score", digits=4)


def _features(spark, sf_dir, categories):
    wanted = [f["feature"] for f in inventory.catalogue() if f["category"] in categories]
    values = inventory.feature_values(bridge.pose(spark, sf_dir), wanted)
    return rounded(values.select("track", F.explode("values").alias("feature", "value")), "value", digits=4)


def feature_inventory(spark, sf_dir):
    """Every feature of every track."""
    return _features(spark, sf_dir, ("time", "frequency", "time-frequency", "biomechanics", "context"))


def feature_inventory_time(spark, sf_dir):
    """The features that need no spectrum."""
    return _features(spark, sf_dir, ("time", "biomechanics", "context"))


MODEL_ROWS = [("even", 0.45, 1, "n_chars", 0.2, 1500.0, 2000.0, 1500.0), ("even", 0.45, 2, "toxic", -0.3, 0.0, 0.1, 0.3), ("odd", 0.55, 1, "toxic", 0.1, 0.0, 0.2, 0.0)]


def predicted_runs(spark, sf_dir):
    """The reviewed documents scored with two versions of a model, a source with an even number of its hash with the one, others with the other."""
    r = bridge.reviews(spark, sf_dir)
    known = F.map_filter(F.create_map(F.lit("n_chars"), F.when(F.col("n_chars") % 7 != 0, F.col("n_chars").cast("double")), F.lit("toxic"), F.col("toxic").cast("double")), lambda k, v: v.isNotNull())
    values = r.select("run", "track", known.alias("values"))
    version = F.when(F.expr("conv(substr(sha2(run, 256), 1, 2), 16, 10) % 2 = 0"), "even").otherwise("odd")
    got = prediction.predict(values, r.select("run").distinct().withColumn("fingerprint", version), spark.createDataFrame(MODEL_ROWS, prediction.MODELS))
    p = F.col("predictors")
    return rounded(got.select("run", "track", "fingerprint", "score", "predicted", "method", F.size(p).cast("long").alias("n_predictors"), p[0]["contribution"].alias("first")), "score", "first")


def sequence_probability(spark, sf_dir):
    """A recurrent model trained on the users' sequences of window means, whether a user has bought more than the median one, and its probabilities."""
    s = bridge.signal(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    w = features.window_sequences(s, ["track"], "t", "value", 5.0, 9, 3.0, 0.25, 2)
    seq = w.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("step", ((F.col("mean") - 50) / 25).alias("v")))).alias("s"))
    seq = seq.select(F.lit("all").alias("run"), "track", F.transform("s", lambda x: F.array(F.coalesce(x["v"], F.lit(0.0)))).alias("xs"))
    bought = s.groupBy("track").agg(F.count_if(F.col("kind") == "purchase").alias("n"))
    usual = bought.agg(F.median("n").alias("m"))
    labels = bought.join(F.broadcast(usual)).select("track", (F.col("n") > F.col("m")).cast("int").alias("label"))  # one row
    theta, _ = prediction.train_temporal(seq.join(labels, "track"), 1, 8, epochs=5)
    model = prediction.temporal_model(spark, "all", theta, 1, 8)
    out = prediction.temporal(seq, seq.select("run").distinct().withColumn("fingerprint", F.lit("all")), model)
    return rounded(out.select("track", "probability"), "probability")


def descriptor_references(spark, sf_dir):
    """The reference of every label's vectors in order, of two regions of eight values each, one of which every fifth vector lacks."""
    e = bridge.table(spark, sf_dir, "embeddings").selectExpr("CAST(label AS BIGINT) AS track", "vec_id AS frame", "vec_id % 5 AS gone", "transform(embedding, v -> abs(CAST(v AS DOUBLE))) AS v")
    region = lambda k: F.when(F.col("gone") != k, F.transform(F.slice("v", 8 * k + 1, 8), lambda x: x / F.aggregate(F.slice("v", 8 * k + 1, 8), F.lit(0.0), lambda a, b: a + b)))
    d = e.select("track", "frame", F.array(region(0), region(1)).alias("d"))
    r = appearance.references(d, ["track"], "frame", "d").join(d, ["track", "frame"])
    weigh = lambda k: F.aggregate(F.arrays_zip(F.col("reference")[k].alias("x"), F.sequence(F.lit(1), F.lit(8)).alias("i")), F.lit(0.0), lambda s, z: s + z["x"] * z["i"])
    out = r.select("track", "frame", appearance.distance(F.col("before"), F.col("d")).alias("distance"), weigh(0).alias("first"), weigh(1).alias("second"))
    return rounded(out, "distance", "first", "second", digits=5)


QUERIES = {
    f.__name__: f for f in (descriptor_references, predicted_runs, sequence_probability, stable_tracks, cached_tracks, identity_layers, stitched_runs, frame_assignment, cached_scan_types, snapshot_view, feature_inventory, feature_inventory_time)
}

_DENSE = "CASE WHEN p IS NOT NULL THEN dense_rank() OVER (PARTITION BY run ORDER BY p NULLS LAST) - 1 END"
_N = "max({0}) OVER (PARTITION BY run)"
_TRACKS = with_views(
    "turns",
    "SELECT run, frame, base, CASE WHEN run % 4 = 1 THEN c WHEN run % 2 = 1 THEN a ELSE base END AS person FROM s3",
    b0="SELECT run, frame, dense_rank() OVER (PARTITION BY run ORDER BY person) - 1 AS q FROM turns",
    b1=f"SELECT run, frame, {_DENSE} AS base FROM (SELECT run, frame, CASE WHEN run % 6 = 0 AND q = 1 THEN 0 ELSE q END AS p FROM b0)",
    s1=f"SELECT run, frame, base, {_DENSE} AS a FROM (SELECT *, CASE WHEN base = 0 AND frame >= 2 THEN {_N.format('base')} + 1 ELSE base END AS p FROM b1)",
    s2=f"SELECT run, frame, base, a, {_DENSE} AS b FROM (SELECT *, CASE WHEN a = 0 AND frame >= 1 THEN {_N.format('a')} + 1 ELSE a END AS p FROM s1)",
    s3=f"SELECT run, frame, base, a, {_DENSE} AS c FROM (SELECT *, CASE WHEN NOT (b = 0 AND frame = 0) THEN b END AS p FROM s2)",
)


def _assignment_sql() -> str:
    """The best sets by dynamic programming over the bodies of a frame, one after the other, and the bodies before that are taken."""
    steps = [
        "d0 AS (SELECT frame, det AS a, size, conf FROM detections)",
        "c AS (SELECT x.frame, x.a, y.a AS b, abs(x.size - y.size) / 10 + abs(x.conf - y.conf) AS cost FROM d0 x JOIN d0 y ON y.frame + 1 = x.frame)",
        "k AS (SELECT * FROM c WHERE cost <= 1.0)",
        "t0 AS (SELECT DISTINCT frame, CAST(0 AS BIGINT) AS mask, CAST(0 AS DOUBLE) AS v FROM k)",
    ]
    for a in range(16):
        steps.append(
            f"t{a + 1} AS (SELECT frame, mask, min(v) AS v FROM (SELECT * FROM t{a} UNION ALL SELECT t.frame, t.mask | (CAST(1 AS BIGINT) << k.b) AS mask, t.v + k.cost - 1000 AS v FROM t{a} t JOIN k ON k.frame = t.frame AND k.a = {a} AND (t.mask >> k.b) & 1 = 0) GROUP BY frame, mask)"
        )
    return with_views("detections", "SELECT frame, CAST(ceil(-v / 1000) AS BIGINT) AS pairs, round(v + 1000 * ceil(-v / 1000), 5) AS cost FROM (SELECT frame, min(v) AS v FROM t16 GROUP BY frame)") .replace(
        "\nSELECT frame, CAST(ceil", ",\n" + ",\n".join(steps) + "\nSELECT frame, CAST(ceil", 1
    )


_CHAINS = ((5, 9), (6, 10), (11, 15), (12, 16))
_RATE = "(SELECT 1 / median(d) FROM (SELECT t - lag(t) OVER (ORDER BY frame) AS d FROM (SELECT frame, max(t) AS t FROM pose GROUP BY frame)))"
_FRAMES = "(SELECT count(DISTINCT frame) FROM pose)"


def _long(names: str, prefix: str, kept: str) -> str:
    """Columns of a row a track as rows (track, feature, value), nulls left out."""
    return " UNION ALL ".join(f"SELECT track, '{prefix}{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM {kept} WHERE {n} IS NOT NULL" for n in names.split())


_TIME_SHAPES = " UNION ALL ".join(
    f"SELECT track, 'time_{signal}_{name}' AS feature, CAST({name} AS DOUBLE) AS value FROM shapes WHERE signal = '{signal}'" for signal, names in inventory.TIME.items() for name in names
)
_INVENTORY_SQL = with_views(
    "pose",
    f"""SELECT track, feature, round(value, 4) + 0.0 AS value FROM ({_TIME_SHAPES} UNION ALL {_long(" ".join(inventory.PHYSICAL), "physical_", "phys")} UNION ALL {_long(" ".join(inventory.CONTEXT), "context_", "ctx")}) WHERE isfinite(value)""",
    l="SELECT *, CASE WHEN px IS NOT NULL AND lag(px) OVER w IS NOT NULL AND lag(frame) OVER w = frame - 1 THEN sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) END AS far FROM pose WINDOW w AS (PARTITION BY track, joint ORDER BY frame)",
    m=f"""SELECT track, frame, max(t) AS t, avg(far) AS pose_motion, avg(far) FILTER (joint IN (9, 10)) AS wrist_speed, avg(far) FILTER (joint IN (7, 8, 13, 14)) AS limb_motion, avg(CASE WHEN px IS NOT NULL THEN c END) AS confidence,
      max(py) - min(py) AS height, (max(px) + min(px)) / 2 AS bx, (max(py) + min(py)) / 2 AS bo, {_JOINTS_XY} FROM l GROUP BY track, frame""",
    b="SELECT *, (x11 + x12) / 2 AS hx, (y11 + y12) / 2 AS hy, sqrt(power((x5 + x6 - x11 - x12) / 2, 2) + power((y5 + y6 - y11 - y12) / 2, 2)) AS torso, nullif(sqrt(power((x5 + x6) / 2 - (x11 + x12) / 2, 2) + power((y5 + y6) / 2 - (y11 + y12) / 2, 2)), 0) AS s FROM m",
    near="SELECT track, frame, avg(sqrt(power(px - hx, 2) + power(py - hy, 2)) / s) AS compactness FROM pose JOIN b USING (track, frame) GROUP BY track, frame",
    sp="SELECT *, CASE WHEN lag(frame) OVER f = frame - 1 THEN t - lag(t) OVER f END AS dt, (torso + lag(torso) OVER f) / 2 AS sc FROM b JOIN near USING (track, frame) WINDOW f AS (PARTITION BY track ORDER BY frame)",
    u=" UNION ALL ".join(f"SELECT track, frame, '{n}' AS signal, {a} AS active, CASE WHEN dt > 0 AND sc > 0 THEN {n} / (dt * sc) END AS v FROM sp" for n, (_, a) in inventory.SPEEDS.items())
    + f" UNION ALL SELECT track, frame, 'limb_angle', 0, CASE WHEN s IS NOT NULL THEN list_avg([{', '.join(f'atan2(y{c} - y{a}, x{c} - x{a})' for a, c in _CHAINS)}]) END FROM sp",
    grid="SELECT k.track, f.frame, k.signal, k.active, u.v FROM (SELECT DISTINCT track, signal, active FROM u) k CROSS JOIN (SELECT DISTINCT frame FROM pose) f LEFT JOIN u ON u.track = k.track AND u.frame = f.frame AND u.signal = k.signal",
    ends="""SELECT *, count(v) OVER (PARTITION BY track, signal) AS n, last_value(v IGNORE NULLS) OVER lo AS lv, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER lo AS lf,
      first_value(v IGNORE NULLS) OVER hi AS hv, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER hi AS hf FROM grid
      WINDOW lo AS (PARTITION BY track, signal ORDER BY frame), hi AS (PARTITION BY track, signal ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    whole="SELECT track, signal, active, frame, coalesce(v, lv + (hv - lv) * (frame - lf) / nullif(hf - lf, 0), lv, hv) AS v FROM ends WHERE n >= 4",
    steps="SELECT *, v - avg(v) OVER (PARTITION BY track, signal) AS d, v - lag(v) OVER (PARTITION BY track, signal ORDER BY frame) AS dv FROM whole",
    turns_="SELECT *, lag(d) OVER o AS e, coalesce(dv - 2 * pi() * floor((dv + pi()) / (2 * pi())), 0) AS turn FROM steps WINDOW o AS (PARTITION BY track, signal ORDER BY frame)",
    shapes="""SELECT track, signal, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.95) AS p95, max(v) AS peak, avg(CASE WHEN v > active THEN 1.0 ELSE 0.0 END) AS active_fraction,
      regr_slope(v, frame) AS trend, coalesce(sum(d * e) / nullif(sum(d * d), 0), 0) AS autocorr_lag1, avg(CASE WHEN e IS NOT NULL THEN CASE WHEN (d < 0) <> (e < 0) THEN 1.0 ELSE 0.0 END END) AS zero_cross_rate FROM turns_ GROUP BY track, signal""",
    angles="SELECT track, max(a) - min(a) AS limb_angle_range_rad FROM (SELECT track, sum(turn) OVER (PARTITION BY track ORDER BY frame) AS a FROM turns_ WHERE signal = 'limb_angle') GROUP BY track",
    accel=f"SELECT track, sqrt(avg(power(dv * {_RATE}, 2))) AS wrist_acceleration_rms FROM steps WHERE signal = 'wrist_speed' GROUP BY track",
    phys="""SELECT * FROM (SELECT track, avg(wh) AS wrist_height_mean, stddev_pop(wh) AS wrist_height_std, avg(ext) AS limb_extension_mean, stddev_pop(ext) AS limb_extension_std, stddev_pop(hx / s) AS body_sway, stddev_pop(hy / s) AS vertical_bounce, avg(compactness) AS pose_compactness,
      avg(asym) AS wrist_height_asymmetry, avg(sqrt(power(x15 - x16, 2) + power(y15 - y16, 2)) / s) AS step_width, avg(CASE WHEN s IS NOT NULL THEN abs(degrees(atan2(y6 - y5, x6 - x5))) END) AS shoulder_tilt_abs_deg FROM (
      SELECT *, list_avg([(hy - y9) / s, (hy - y10) / s]) AS wh, abs((hy - y9) / s - (hy - y10) / s) AS asym, list_avg(["""
    + ", ".join(f"sqrt(power(x{a} - x{c}, 2) + power(y{a} - y{c}, 2)) / s" for a, c in _CHAINS)
    + "]) AS ext FROM sp) GROUP BY track) LEFT JOIN angles USING (track) LEFT JOIN accel USING (track)",
    ctx=f"""SELECT *, sqrt(power(median_x_fraction - 0.5, 2) + power(median_y_fraction - 0.5, 2)) / sqrt(0.5) AS center_distance FROM (SELECT track, count(*) AS frames_present, count(*) / {_RATE} AS track_duration_s, count(*) / {_FRAMES} AS visible_frame_fraction, avg(confidence) AS mean_pose_confidence,
      median(height) AS median_person_height_px, median(bx) / (SELECT max(px) FROM pose) AS median_x_fraction, median(bo) / (SELECT max(py) FROM pose) AS median_y_fraction FROM m GROUP BY track)""",
)

def _mixed(k: int) -> str:
    return f"CASE WHEN n.r{k} IS NULL THEN w.r{k} WHEN w.r{k} IS NULL THEN n.r{k} ELSE list_transform(range(1, 9), lambda i: (9 * w.r{k}[i] + n.r{k}[i]) / 10) END"


def _apart(k: int) -> str:
    return f"CASE WHEN w.r{k} IS NOT NULL AND n.r{k} IS NOT NULL THEN sqrt(greatest(1 - list_sum(list_transform(range(1, 9), lambda i: sqrt(w.r{k}[i] * n.r{k}[i]))), 0)) END"


_REGIONS = ", ".join(f"CASE WHEN gone <> {k} THEN list_transform(v[{8 * k + 1}:{8 * k + 8}], lambda x: x / list_sum(v[{8 * k + 1}:{8 * k + 8}])) END AS r{k}" for k in (0, 1))
ORACLE_SQL = {
    "descriptor_references": f"""WITH RECURSIVE e AS (SELECT CAST(label AS BIGINT) AS track, vec_id AS frame, vec_id % 5 AS gone, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS v FROM embeddings),
    n AS (SELECT track, frame, k, {_REGIONS} FROM e),
    walk AS (SELECT track, frame, k, r0, r1, CAST(NULL AS DOUBLE) AS d0, CAST(NULL AS DOUBLE) AS d1 FROM n WHERE k = 1 UNION ALL
      SELECT n.track, n.frame, n.k, {_mixed(0)}, {_mixed(1)}, {_apart(0)}, {_apart(1)} FROM walk w JOIN n ON n.track = w.track AND n.k = w.k + 1)
    SELECT track, frame, round(list_avg([d0, d1]), 5) + 0.0 AS distance, round(list_sum(list_transform(range(1, 9), lambda i: i * r0[i])), 5) AS first, round(list_sum(list_transform(range(1, 9), lambda i: i * r1[i])), 5) AS second FROM walk""",
    "predicted_runs": with_views(
        "reviews",
        """SELECT run, track, fingerprint, round(CASE WHEN fingerprint = 'even' THEN 0.45 + first + (toxic - 0.1) / 0.3 * -0.3 ELSE 0.55 + first END, 6) + 0.0 AS score,
        CAST(CASE WHEN fingerprint = 'even' THEN 0.45 + first + (toxic - 0.1) / 0.3 * -0.3 ELSE 0.55 + first END >= 0.5 AS INTEGER) AS predicted, 'linear' AS method, CAST(CASE WHEN fingerprint = 'even' THEN 2 ELSE 1 END AS BIGINT) AS n_predictors, round(first, 6) + 0.0 AS first
        FROM (SELECT *, CASE WHEN fingerprint = 'even' THEN (CASE WHEN n_chars % 7 <> 0 THEN n_chars ELSE 1500 END - CAST(2000 AS DOUBLE)) / 1500 * 0.2 ELSE (CAST(toxic AS DOUBLE) - 0.2) * 0.1 END AS first FROM v)""",
        v="SELECT *, CASE WHEN CAST('0x' || substr(sha256(run), 1, 2) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS fingerprint FROM reviews",
    ),
    "stable_tracks": _TRACKS,
    "feature_inventory_time": _INVENTORY_SQL,
    "cached_tracks": _TRACKS,
    "identity_layers": with_views(
        "turns",
        "SELECT CASE WHEN run % 3 <> 0 OR top < 2 THEN 'none' WHEN run % 2 = 0 THEN 'applied' ELSE 'stale' END AS learned, count(*) AS runs, count(*) AS stamps FROM r GROUP BY ALL",
        r="SELECT run, count(DISTINCT person) AS top FROM turns GROUP BY run",
    ),
    "frame_assignment": _assignment_sql(),
    "cached_scan_types": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type",
    "snapshot_view": with_views(
        "reviews",
        """SELECT run, count(*) AS tracks, count(kept) AS labelled, CAST(sum(kept) AS BIGINT) AS positive, round(avg(toxic + n_chars / 1000), 4) AS score, CAST(1 AS BIGINT) AS snapshot FROM (
        SELECT *, CASE WHEN CAST('0x' || substr(sha256(run), 1, 2) AS INTEGER) % 2 = 1 THEN label WHEN track % 3 <> 0 THEN 1 - label END AS kept FROM reviews) GROUP BY run""",
    ),
}
