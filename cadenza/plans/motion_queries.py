"""Queries of the pose operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import coaching, consensus, deviation, features, geometry, tracking
from cadenza.plans.oracle import with_views
from cadenza.schema import JOINTS
from cadenza.sources import bridge

D = 6


def rounded(df: DataFrame, *columns: str, digits: int = D) -> DataFrame:
    """The columns rounded, negative zero as zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def norm(spark, sf_dir: str, rotate: bool = False) -> DataFrame:
    return geometry.normalize(bridge.pose(spark, sf_dir), rotate)


def dev(spark, sf_dir: str) -> DataFrame:
    n = norm(spark, sf_dir)
    return deviation.joint_deviation(n, consensus.reference_of_track(n, 0), 0)


def pose_long(spark, sf_dir):
    return rounded(bridge.pose(spark, sf_dir).select("track", "frame", "t", "joint", "x", "y", "c"), "t", "x", "y", "c")


def visible_joint_counts(spark, sf_dir):
    return geometry.visible_counts(bridge.pose(spark, sf_dir)).select("track", "frame", "n_visible", "eligible")


def person_scale(spark, sf_dir):
    p = bridge.pose(spark, sf_dir).withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100})
    return rounded(geometry.person_scale(p).select("track", "frame", "scale", "strict_scale"), "scale", "strict_scale")


def person_center(spark, sf_dir):
    return rounded(geometry.person_center(bridge.pose(spark, sf_dir)).select("track", "frame", "cx", "cy"), "cx", "cy")


def limb_angles(spark, sf_dir):
    a = geometry.limb_angles(bridge.pose(spark, sf_dir)).select("track", "frame", "limb", "angle")
    return rounded(a, "angle")


def normalized_pose(spark, sf_dir):
    return rounded(norm(spark, sf_dir).select("track", "frame", "joint", "nx", "ny", "nc"), "nx", "ny", "nc")


def normalized_pose_rotated(spark, sf_dir):
    return rounded(norm(spark, sf_dir, True).select("track", "frame", "joint", "nx", "ny"), "nx", "ny")


def denormalize_roundtrip(spark, sf_dir):
    d = geometry.denormalize(norm(spark, sf_dir, True), True).where("nx IS NOT NULL")
    return rounded(d.select("track", "frame", "joint", "bx", "by"), "bx", "by")


def consensus_mean_and_counts(spark, sf_dir):
    return rounded(consensus.mean_and_counts(norm(spark, sf_dir)).select("frame", "joint", "n", "mx", "my"), "mx", "my")


def consensus_weiszfeld8(spark, sf_dir):
    return rounded(consensus.weiszfeld(norm(spark, sf_dir)).select("frame", "joint", "rx", "ry"), "rx", "ry", digits=4)


def consensus_median(spark, sf_dir):
    return rounded(consensus.median(norm(spark, sf_dir)).select("frame", "joint", "rx", "ry"), "rx", "ry")


def consensus_loo(spark, sf_dir):
    return rounded(consensus.leave_one_out(norm(spark, sf_dir)).select("track", "frame", "joint", "rx", "ry"), "rx", "ry")


def deviation_from_consensus(spark, sf_dir):
    n = norm(spark, sf_dir)
    frames = n.select("run", "frame").distinct()
    ref = consensus.smoothed(consensus.leave_one_out(n), frames, ["run", "track", "joint"])
    return rounded(deviation.frame_score(deviation.joint_deviation(n, ref)).select("track", "frame", "score"), "score")


def deviation_joint(spark, sf_dir):
    return rounded(dev(spark, sf_dir).select("track", "frame", "joint", "deviation"), "deviation")


def deviation_score(spark, sf_dir):
    s = deviation.frame_score(dev(spark, sf_dir))
    return rounded(s.select("track", "frame", "score", "head", "arms", "torso", "legs"), "score", "head", "arms", "torso", "legs")


def limb_angle_deviation(spark, sf_dir):
    n = norm(spark, sf_dir)
    d = deviation.limb_deviation(n, consensus.reference_of_track(n, 0))
    return rounded(d.select("track", "frame", "limb", "degrees"), "degrees")


def deviation_time_tolerance(spark, sf_dir):
    n = norm(spark, sf_dir)
    return rounded(deviation.within_tolerance(n, consensus.reference_of_track(n, 0), 3).select("track", "frame", "lag", "score"), "score")


def worst_moments(spark, sf_dir):
    s = rounded(deviation.frame_score(dev(spark, sf_dir)), "score")
    w = deviation.worst_moments(s.where("track <> 0"), 3, 0.2)
    return rounded(w.select("track", "rank", "t", "score"), "t")


def dancer_summary(spark, sf_dir):
    return rounded(deviation.track_summary(dev(spark, sf_dir)).select("track", "frames_present", "mean_dev", "worst_joint"), "mean_dev")


def deviation_csv_rows(spark, sf_dir):
    d = deviation.report_rows(dev(spark, sf_dir))
    return d.select("frame", "t", "dancer", "score", "nose", "left_hip", "right_ankle", "movement_similarity")


def coaching_summary(spark, sf_dir):
    s = coaching.summary(dev(spark, sf_dir), norm(spark, sf_dir))
    return rounded(s.select("track", "mean_dev", "score", "coverage", "closest", "furthest", "worst_joint", "worst_mean", "improve"), "mean_dev", "score", "coverage", "worst_mean")


def coaching_overall(spark, sf_dir):
    return rounded(coaching.overall(coaching.summary(dev(spark, sf_dir), norm(spark, sf_dir)), 0).select("overall"), "overall")


def feedback_moments(spark, sf_dir):
    f = coaching.feedback(dev(spark, sf_dir), norm(spark, sf_dir), 3, 0.2)
    return rounded(f.select("track", "rank", "t", "score", "joint", "text"), "t", "score")


def key_moments(spark, sf_dir):
    k = coaching.key_moments(norm(spark, sf_dir), 5, 0.05, 0.2)
    return rounded(k.select("rank", "a", "b", "start", "end", "peak", "mean", "region", "joint"), "start", "end", "peak", "mean")


def pairwise_pose_cost(spark, sf_dir):
    return rounded(tracking.pose_cost(bridge.pose(spark, sf_dir)).select("frame", "a", "b", "n", "cost"), "cost")


def dedupe_keep(spark, sf_dir):
    p = bridge.pose(spark, sf_dir)
    b = p.groupBy("run", "frame", "track").agg(F.count_if(F.col("c") >= 0.3).alias("n_visible"), F.avg("c").alias("confidence"))
    return tracking.keep_best(tracking.pose_cost(p), b).select("track", "frame", "kept")


def motion_speed(spark, sf_dir):
    return rounded(geometry.motion_speed(bridge.pose(spark, sf_dir)).select("track", "frame", "speed"), "speed")


def frame_biomechanics(spark, sf_dir):
    b = geometry.biomechanics(bridge.pose(spark, sf_dir))
    names = ["wrist_height", "wrist_asymmetry", "limb_extension", "limb_angle", "body_x", "body_y", "compactness", "step_width", "shoulder_tilt", "confidence"]
    return rounded(b.select("track", "frame", *names), *names)


def biomech_features(spark, sf_dir):
    b = geometry.biomechanics(bridge.pose(spark, sf_dir))
    s = geometry.motion_speed(bridge.pose(spark, sf_dir), (9, 10), "wrist")
    g = b.groupBy("track").agg(F.avg("wrist_height").alias("wrist_height_mean"), F.stddev_pop("wrist_height").alias("wrist_height_std"), F.avg("limb_extension").alias("limb_extension_mean"), F.stddev_pop("body_x").alias("body_sway"), F.stddev_pop("body_y").alias("vertical_bounce"), F.avg("step_width").alias("step_width"))
    w = s.groupBy("track").agg(F.avg("wrist").alias("wrist_speed_mean"), F.percentile("wrist", 0.95).alias("wrist_speed_p95"))
    out = g.join(w, "track")
    return rounded(out, *[c for c in out.columns if c != "track"])


def context_features(spark, sf_dir):
    c = features.context(bridge.pose(spark, sf_dir)).drop("run")
    return rounded(c, *[x for x in c.columns if x not in ("track", "frames_present")])


def histogram_distance(spark, sf_dir):
    from cadenza.functions.columns import hellinger

    h = geometry.visible_histogram(bridge.pose(spark, sf_dir)).where("histogram IS NOT NULL")
    j = h.select("frame", F.col("track").alias("a"), F.col("histogram").alias("ha")).join(h.select("frame", F.col("track").alias("b"), F.col("histogram").alias("hb")), "frame").where("a < b")
    return rounded(j.select("frame", "a", "b", hellinger(F.col("ha"), F.col("hb")).alias("distance")), "distance", digits=5)


def online_tracks(spark, sf_dir):
    return tracking.track(tracking.bodies(scaled(spark, sf_dir))).select("frame", "det", "tracklet")


def stitched_tracks(spark, sf_dir):
    b = tracking.bodies(scaled(spark, sf_dir))
    return tracking.stitch(tracking.track(b), b, least=5).select("frame", "det", "track")


def scaled(spark, sf_dir: str) -> DataFrame:
    """The pose bridge in picture units, each track in a place of its own."""
    p = bridge.pose(spark, sf_dir)
    return p.withColumns({"x": F.col("x") * 100 + F.col("track") * 400, "y": F.col("y") * 100 + 300})


def track_summary_best_frame(spark, sf_dir):
    p = bridge.pose(spark, sf_dir)
    b = p.groupBy("track", "frame").agg(F.avg("c").alias("conf"))
    best = b.groupBy("track").agg(F.count("*").alias("frames"), F.max_by("frame", F.struct("conf", -F.col("frame"))).alias("best_frame"))
    nose = p.where("joint = 0 AND c >= 0.3").groupBy("track").agg(F.count("*").alias("nose_frames"))
    return best.join(nose, "track", "left")


QUERIES = {
    f.__name__: f
    for f in (
        pose_long, visible_joint_counts, person_scale, person_center, limb_angles, normalized_pose, normalized_pose_rotated, denormalize_roundtrip,
        consensus_mean_and_counts, consensus_weiszfeld8, consensus_median, consensus_loo, deviation_from_consensus, deviation_joint, deviation_score,
        limb_angle_deviation, deviation_time_tolerance, worst_moments, dancer_summary, deviation_csv_rows, coaching_summary, coaching_overall,
        feedback_moments, key_moments, pairwise_pose_cost, dedupe_keep, motion_speed, frame_biomechanics, biomech_features, context_features,
        histogram_distance, online_tracks, stitched_tracks, track_summary_best_frame,
    )
}

_JOINTS_XY = ", ".join(f"max(CASE WHEN joint = {j} THEN px END) AS x{j}, max(CASE WHEN joint = {j} THEN py END) AS y{j}" for j in range(17))
_LIMBS = ((5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16))
_LIMB_ROWS = " UNION ALL ".join(f"SELECT track, frame, {k} AS limb, round(atan2(y{b} - y{a}, x{b} - x{a}), 6) + 0.0 AS angle FROM w" for k, (a, b) in enumerate(_LIMBS))
_LIMB_DEV = " UNION ALL ".join(
    f"SELECT n.track, n.frame, {k} AS limb, atan2(n.y{b} - n.y{a}, n.x{b} - n.x{a}) - atan2(r.y{b} - r.y{a}, r.x{b} - r.x{a}) AS d FROM nw n JOIN rw r USING (frame)" for k, (a, b) in enumerate(_LIMBS)
)
_SHARE = "(SELECT count(DISTINCT frame) FROM pose)"

ORACLE_SQL = {
    "pose_long": with_views("pose", "SELECT track, frame, round(t, 6) AS t, joint, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(c, 6) AS c FROM pose"),
    "visible_joint_counts": with_views("pose", "SELECT track, frame, count(px) AS n_visible, count(px) >= 6 AS eligible FROM pose GROUP BY track, frame"),
    "person_scale": with_views(
        "pose",
        f"""SELECT track, frame, round(greatest(coalesce(torso, CASE WHEN n >= 2 THEN box END, 1.0), 1.0), 6) AS scale, round(torso, 6) AS strict_scale FROM (
        SELECT track, frame, n, 40 * sqrt(dx * dx + dy * dy) AS box, 100 * sqrt(power((x5 + x6 - x11 - x12) / 2, 2) + power((y5 + y6 - y11 - y12) / 2, 2)) AS torso FROM (
        SELECT track, frame, count(px) AS n, max(px) - min(px) AS dx, max(py) - min(py) AS dy, {_JOINTS_XY} FROM pose GROUP BY track, frame))""",
    ),
    "person_center": with_views(
        "pose",
        "SELECT track, frame, round(coalesce(avg(px) FILTER (joint IN (11, 12)), avg(px)), 6) + 0.0 AS cx, round(coalesce(avg(py) FILTER (joint IN (11, 12)), avg(py)), 6) + 0.0 AS cy FROM pose GROUP BY track, frame",
    ),
    "limb_angles": with_views("pose", f"SELECT * FROM ({_LIMB_ROWS})", w=f"SELECT track, frame, {_JOINTS_XY} FROM pose GROUP BY track, frame"),
    "normalized_pose": with_views("norm", "SELECT track, frame, joint, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nc, 6) AS nc FROM norm"),
    "normalized_pose_rotated": with_views(
        "norm", "SELECT track, frame, joint, round(nx * cos(-rot) - ny * sin(-rot), 6) + 0.0 AS nx, round(nx * sin(-rot) + ny * cos(-rot), 6) + 0.0 AS ny FROM norm"
    ),
    "denormalize_roundtrip": with_views("norm", "SELECT track, frame, joint, round(px, 6) + 0.0 AS bx, round(py, 6) + 0.0 AS by FROM norm WHERE nx IS NOT NULL"),
    "consensus_mean_and_counts": with_views("norm", "SELECT frame, joint, count(DISTINCT track) AS n, round(sum(nx * nc) / sum(nc), 6) + 0.0 AS mx, round(sum(ny * nc) / sum(nc), 6) + 0.0 AS my FROM norm WHERE nx IS NOT NULL GROUP BY frame, joint"),
    "consensus_weiszfeld8": with_views(
        "norm",
        "SELECT w8.frame, w8.joint, round(CASE WHEN n <= 2 THEN ax ELSE x END, 4) + 0.0 AS rx, round(CASE WHEN n <= 2 THEN ay ELSE y END, 4) + 0.0 AS ry FROM w8 JOIN g USING (frame, joint)",
        v="SELECT track, frame, joint, nx, ny, nc FROM norm WHERE nx IS NOT NULL",
        g="SELECT frame, joint, count(*) AS n, avg(nx) AS ax, avg(ny) AS ay FROM v GROUP BY frame, joint",
        w0="SELECT frame, joint, sum(nx * nc) / sum(nc) AS x, sum(ny * nc) / sum(nc) AS y FROM v GROUP BY frame, joint",
        **{
            f"w{k}": f"SELECT frame, joint, sum(nx * w) / sum(w) AS x, sum(ny * w) / sum(w) AS y FROM (SELECT v.*, nc / greatest(sqrt(power(nx - x, 2) + power(ny - y, 2)), 1e-6) AS w FROM v JOIN w{k - 1} USING (frame, joint)) GROUP BY frame, joint"
            for k in range(1, 9)
        },
    ),
    "deviation_joint": with_views("dev", "SELECT track, frame, joint, round(deviation, 6) AS deviation FROM dev"),
    "deviation_score": with_views(
        "dev",
        """SELECT track, frame, round(avg(deviation), 6) AS score, round(avg(deviation) FILTER (joint <= 4), 6) AS head, round(avg(deviation) FILTER (joint BETWEEN 5 AND 10), 6) AS arms,
        round(avg(deviation) FILTER (joint IN (11, 12)), 6) AS torso, round(avg(deviation) FILTER (joint >= 13), 6) AS legs FROM dev GROUP BY track, frame""",
    ),
    "limb_angle_deviation": with_views(
        "dev",
        f"SELECT track, frame, limb, round(degrees(abs(atan2(sin(d), cos(d)))), 6) AS degrees FROM ({_LIMB_DEV})",
        nw="SELECT track, frame, " + ", ".join(f"max(CASE WHEN joint = {j} THEN n{k} END) AS {k}{j}" for j in range(5, 17) for k in "xy") + " FROM norm GROUP BY track, frame",
        rw="SELECT frame, " + ", ".join(f"max(CASE WHEN joint = {j} THEN r{k} END) AS {k}{j}" for j in range(5, 17) for k in "xy") + " FROM ref GROUP BY frame",
    ),
    "deviation_time_tolerance": with_views(
        "dev",
        "SELECT b.track, b.frame, coalesce(m.lag, 0) AS lag, round(m.score, 6) AS score FROM (SELECT DISTINCT track, frame FROM norm) b LEFT JOIN best m USING (track, frame)",
        s="""SELECT n.track, n.frame, CAST(r.frame - n.frame AS INTEGER) AS lag, avg(sqrt(power(nx - rx, 2) + power(ny - ry, 2))) AS score FROM norm n JOIN ref r ON n.joint = r.joint AND r.frame - n.frame BETWEEN -3 AND 3
        WHERE nx IS NOT NULL AND rx IS NOT NULL GROUP BY n.track, n.frame, r.frame""",
        best="SELECT track, frame, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY track, frame ORDER BY round(score, 9), abs(lag), lag) AS k FROM s) WHERE k = 1",
    ),
    "worst_moments": with_views(
        "dev",
        "SELECT track, CAST(k AS BIGINT) AS rank, round(t, 6) AS t, score FROM (SELECT track, k, unnest(ts[k:k]) AS t, unnest(ss[k:k]) AS score FROM walk)",
        s="SELECT track, max(t) AS t, round(avg(deviation), 6) AS score FROM dev WHERE track <> 0 GROUP BY track, frame HAVING avg(deviation) IS NOT NULL",
        o="SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, t) AS i FROM s",
        walk="""SELECT track, 1 AS k, [t] AS ts, [score] AS ss FROM o WHERE i = 1 UNION ALL
        SELECT w.track, w.k + 1, list_append(w.ts, n.t), list_append(w.ss, n.score) FROM walk w, LATERAL (
          SELECT t, score FROM o WHERE o.track = w.track AND len(list_filter(w.ts, lambda x: abs(x - o.t) < 0.2)) = 0 ORDER BY i LIMIT 1) n WHERE w.k < 3""",
    ),
    "dancer_summary": with_views(
        "dev",
        "SELECT f.track, frames_present, round(mean_dev, 6) AS mean_dev, w.joint AS worst_joint FROM f LEFT JOIN w ON f.track = w.track AND w.k = 1",
        f="SELECT track, count(score) AS frames_present, avg(score) AS mean_dev FROM (SELECT track, frame, avg(deviation) AS score FROM dev GROUP BY track, frame) GROUP BY track",
        w="SELECT track, joint, row_number() OVER (PARTITION BY track ORDER BY m DESC, joint) AS k FROM (SELECT track, joint, avg(deviation) AS m FROM dev GROUP BY track, joint HAVING avg(deviation) IS NOT NULL)",
    ),
    "deviation_csv_rows": with_views(
        "dev",
        """SELECT frame, round(max(t), 3) AS t, track + 1 AS dancer, round(avg(deviation), 4) AS score, round(max(deviation) FILTER (joint = 0), 4) AS nose, round(max(deviation) FILTER (joint = 11), 4) AS left_hip,
        round(max(deviation) FILTER (joint = 16), 4) AS right_ankle, round(100 / (1 + avg(deviation)), 4) AS movement_similarity FROM dev GROUP BY track, frame HAVING avg(deviation) IS NOT NULL""",
    ),
    "coaching_summary": with_views(
        "coach",
        f"""SELECT m.track, round(mean_dev, 6) AS mean_dev, round(100 / (1 + mean_dev), 6) AS score, round(n_valid / {_SHARE}, 6) AS coverage, c.region AS closest, f.region AS furthest, w.joint AS worst_joint, round(w.m, 6) AS worst_mean, w.m >= 0.15 AS improve
        FROM m JOIN rk c ON c.track = m.track AND c.lo = 1 JOIN rk f ON f.track = m.track AND f.hi = 1 JOIN w ON w.track = m.track AND w.k = 1""",
        m="SELECT track, avg(m) AS mean_dev, count(*) AS n_valid FROM (SELECT track, frame, avg(deviation) AS m FROM el GROUP BY track, frame) GROUP BY track",
        r="SELECT track, region, o, avg(deviation) AS m FROM el GROUP BY track, region, o",
        rk="SELECT *, row_number() OVER (PARTITION BY track ORDER BY m, o) AS lo, row_number() OVER (PARTITION BY track ORDER BY m DESC, o) AS hi FROM r",
        w="SELECT track, joint, m, row_number() OVER (PARTITION BY track ORDER BY m DESC, joint) AS k FROM (SELECT track, joint, avg(deviation) AS m FROM el GROUP BY track, joint)",
    ),
    "coaching_overall": with_views(
        "coach", "SELECT round(avg(100 / (1 + mean_dev)), 6) AS overall FROM m WHERE track <> 0", m="SELECT track, avg(m) AS mean_dev FROM (SELECT track, frame, avg(deviation) AS m FROM el GROUP BY track, frame) GROUP BY track"
    ),
    "pairwise_pose_cost": with_views(
        "pose",
        f"""SELECT j.frame, a, b, n, round(d / scale, 6) AS cost FROM (SELECT p.frame, p.track AS a, q.track AS b, count(*) AS n, avg(sqrt(power(p.px - q.px, 2) + power(p.py - q.py, 2))) AS d
        FROM pose p JOIN pose q ON p.frame = q.frame AND p.joint = q.joint AND p.track <> q.track WHERE p.px IS NOT NULL AND q.px IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) j JOIN s ON s.frame = j.frame AND s.track = a""",
        s=f"""SELECT track, frame, greatest(coalesce(sqrt(power((x5 + x6 - x11 - x12) / 2, 2) + power((y5 + y6 - y11 - y12) / 2, 2)), CASE WHEN n >= 2 THEN 0.4 * sqrt(dx * dx + dy * dy) END, 1.0), 1.0) AS scale FROM (
        SELECT track, frame, count(px) AS n, max(px) - min(px) AS dx, max(py) - min(py) AS dy, {_JOINTS_XY} FROM pose GROUP BY track, frame)""",
    ),
    "motion_speed": with_views(
        "pose",
        """SELECT track, frame, round(CASE WHEN dt > 0 AND sc > 0 THEN far / (dt * sc) END, 6) AS speed FROM (SELECT m.*, CASE WHEN lag(frame) OVER f = frame - 1 THEN t - lag(t) OVER f END AS dt, (torso + lag(torso) OVER f) / 2 AS sc FROM m WINDOW f AS (PARTITION BY track ORDER BY frame))""",
        l="SELECT *, CASE WHEN px IS NOT NULL AND lag(px) OVER w IS NOT NULL AND lag(frame) OVER w = frame - 1 THEN sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) END AS far FROM pose WINDOW w AS (PARTITION BY track, joint ORDER BY frame)",
        m=f"SELECT *, sqrt(power((x5 + x6 - x11 - x12) / 2, 2) + power((y5 + y6 - y11 - y12) / 2, 2)) AS torso FROM (SELECT track, frame, max(t) AS t, avg(far) AS far, {_JOINTS_XY} FROM l GROUP BY track, frame)",
    ),
    "frame_biomechanics": with_views(
        "pose",
        """SELECT track, frame, round(list_avg([(hy - y9) / s, (hy - y10) / s]), 6) + 0.0 AS wrist_height, round(abs((hy - y9) / s - (hy - y10) / s), 6) AS wrist_asymmetry,
        round(list_avg([sqrt(power(x5 - x9, 2) + power(y5 - y9, 2)) / s, sqrt(power(x6 - x10, 2) + power(y6 - y10, 2)) / s, sqrt(power(x11 - x15, 2) + power(y11 - y15, 2)) / s, sqrt(power(x12 - x16, 2) + power(y12 - y16, 2)) / s]), 6) AS limb_extension,
        round(CASE WHEN s IS NOT NULL THEN list_avg([atan2(y9 - y5, x9 - x5), atan2(y10 - y6, x10 - x6), atan2(y15 - y11, x15 - x11), atan2(y16 - y12, x16 - x12)]) END, 6) + 0.0 AS limb_angle, round(compactness, 6) AS compactness,
        round(hx / s, 6) + 0.0 AS body_x, round(hy / s, 6) + 0.0 AS body_y, round(sqrt(power(x15 - x16, 2) + power(y15 - y16, 2)) / s, 6) AS step_width,
        round(CASE WHEN s IS NOT NULL THEN abs(degrees(atan2(y6 - y5, x6 - x5))) END, 6) AS shoulder_tilt, round(confidence, 6) AS confidence FROM b LEFT JOIN near USING (track, frame)""",
        w=f"SELECT track, frame, avg(CASE WHEN px IS NOT NULL THEN c END) AS confidence, {_JOINTS_XY} FROM pose GROUP BY track, frame",
        h="SELECT *, (x11 + x12) / 2 AS hx, (y11 + y12) / 2 AS hy FROM w",
        b="SELECT *, nullif(sqrt(power((x5 + x6) / 2 - hx, 2) + power((y5 + y6) / 2 - hy, 2)), 0) AS s FROM h",
        near="SELECT track, frame, avg(sqrt(power(px - hx, 2) + power(py - hy, 2)) / s) AS compactness FROM pose JOIN b USING (track, frame) GROUP BY track, frame",
    ),
    "feedback_moments": with_views(
        "coach",
        """SELECT track, row_number() OVER (PARTITION BY track ORDER BY t) AS rank, round(t, 6) AS t, round(score, 6) AS score, joint, text FROM (SELECT track, unnest(rows) AS r FROM (SELECT track, rows, row_number() OVER (PARTITION BY track ORDER BY k DESC) AS last FROM walk) WHERE last = 1) JOIN o USING (track, r)""",
        per0="SELECT track, frame, t, deviation, joint, dx, dy, avg(deviation) OVER (PARTITION BY track, frame) AS score, row_number() OVER (PARTITION BY track, frame ORDER BY deviation DESC, joint) AS k FROM el",
        per=f"""SELECT track, t, score, joint, [{", ".join(f"'{j.replace('_', ' ')}'" for j in JOINTS)}][joint + 1] || CASE WHEN abs(dy) >= 0.15 AND abs(dy) >= 1.5 * abs(dx) THEN CASE WHEN dy > 0 THEN ': lower' ELSE ': higher' END ELSE ': differs' END AS text
        FROM per0 WHERE k = 1 AND deviation >= 0.15""",
        o="SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, t) AS r FROM per",
        walk="""SELECT track, 1 AS k, [r] AS rows, [t] AS ts FROM o WHERE r = 1 UNION ALL
        SELECT w.track, w.k + 1, list_append(w.rows, n.r), list_append(w.ts, n.t) FROM walk w, LATERAL (SELECT r, t FROM o WHERE o.track = w.track AND len(list_filter(w.ts, lambda x: abs(x - o.t) < 0.2)) = 0 ORDER BY r LIMIT 1) n WHERE w.k < 3""",
    ),
    "key_moments": with_views(
        "norm",
        """SELECT CAST(k AS BIGINT) AS rank, a, b, round("start", 6) AS "start", round("end", 6) AS "end", round(peak, 6) AS peak, round(mean, 6) AS mean, region, joint FROM walk JOIN o USING (r)""",
        v="SELECT frame, t, joint, track, nx, ny, CASE WHEN joint <= 4 THEN 'head' WHEN joint <= 10 THEN 'arms' WHEN joint <= 12 THEN 'torso' ELSE 'legs' END AS region, CASE WHEN joint <= 4 THEN 1 WHEN joint <= 10 THEN 2 WHEN joint <= 12 THEN 3 ELSE 4 END AS place FROM norm WHERE nx IS NOT NULL",
        j="SELECT p.track AS a, q.track AS b, p.frame, p.t, p.joint, p.region, p.place, sqrt(power(p.nx - q.nx, 2) + power(p.ny - q.ny, 2)) AS d FROM v p JOIN v q ON p.frame = q.frame AND p.joint = q.joint AND p.track < q.track",
        w0="SELECT *, row_number() OVER (PARTITION BY a, b, frame, region ORDER BY d DESC, joint) AS k FROM j",
        reg="SELECT a, b, frame, region, place, max(t) AS t, count(*) AS n, sum(d) AS s, max(d) AS most, max(joint) FILTER (k = 1) AS joint FROM w0 GROUP BY ALL",
        pf="""SELECT a, b, frame, t, n, s / n AS mean, most, region, joint FROM (SELECT a, b, frame, max(t) OVER f AS t, sum(n) OVER f AS n, sum(s) OVER f AS s, max(most) OVER f AS most, region, joint, row_number() OVER (PARTITION BY a, b, frame ORDER BY s / n DESC, place) AS k
        FROM reg WINDOW f AS (PARTITION BY a, b, frame)) WHERE k = 1""",
        times="SELECT DISTINCT frame, t FROM norm",
        pause="SELECT greatest(0.25, 2 * median(dt)) AS pause FROM (SELECT t - lag(t) OVER (ORDER BY frame) AS dt FROM times)",
        grid="SELECT p.a, p.b, x.frame, x.t, f.mean, f.region, f.joint, coalesce(f.n >= 6 AND f.most >= 0.15, FALSE) AS bad FROM (SELECT DISTINCT a, b FROM pf) p CROSS JOIN times x LEFT JOIN pf f ON f.a = p.a AND f.b = p.b AND f.frame = x.frame",
        isl0="SELECT *, CASE WHEN bad AND (NOT coalesce(lag(bad) OVER o, FALSE) OR t - lag(t) OVER o > (SELECT pause FROM pause)) THEN 1 ELSE 0 END AS begins FROM grid WINDOW o AS (PARTITION BY a, b ORDER BY frame)",
        isl="SELECT *, sum(begins) OVER (PARTITION BY a, b ORDER BY frame) AS island FROM isl0",
        e="""SELECT a, b, "start", "end", t AS peak, mean, region, joint FROM (SELECT *, min(t) OVER g AS "start", max(t) OVER g AS "end", row_number() OVER (PARTITION BY a, b, island ORDER BY mean DESC, t) AS k FROM isl WHERE bad WINDOW g AS (PARTITION BY a, b, island)) WHERE k = 1 AND "end" - "start" >= 0.05""",
        o="SELECT *, row_number() OVER (ORDER BY mean DESC, peak, a, b) AS r FROM e",
        walk="""SELECT 1 AS k, r, [peak] AS ts FROM o WHERE r = 1 UNION ALL
        SELECT w.k + 1, n.r, list_append(w.ts, n.peak) FROM walk w, LATERAL (SELECT r, peak FROM o WHERE len(list_filter(w.ts, lambda x: abs(x - o.peak) < 0.2)) = 0 ORDER BY r LIMIT 1) n WHERE w.k < 5""",
    ),
    "biomech_features": with_views(
        "pose",
        """SELECT track, round(avg(wh), 6) + 0.0 AS wrist_height_mean, round(stddev_pop(wh), 6) AS wrist_height_std, round(avg(ext), 6) AS limb_extension_mean, round(stddev_pop(hx / s), 6) AS body_sway, round(stddev_pop(hy / s), 6) AS vertical_bounce,
        round(avg(sqrt(power(x15 - x16, 2) + power(y15 - y16, 2)) / s), 6) AS step_width, round(avg(speed), 6) AS wrist_speed_mean, round(quantile_cont(speed, 0.95), 6) AS wrist_speed_p95 FROM (
        SELECT *, list_avg([(hy - y9) / s, (hy - y10) / s]) AS wh, CASE WHEN dt > 0 AND sc > 0 THEN wrist / (dt * sc) END AS speed,
        list_avg([sqrt(power(x5 - x9, 2) + power(y5 - y9, 2)) / s, sqrt(power(x6 - x10, 2) + power(y6 - y10, 2)) / s, sqrt(power(x11 - x15, 2) + power(y11 - y15, 2)) / s, sqrt(power(x12 - x16, 2) + power(y12 - y16, 2)) / s]) AS ext FROM sp) GROUP BY track""",
        l="SELECT *, CASE WHEN px IS NOT NULL AND lag(px) OVER w IS NOT NULL AND lag(frame) OVER w = frame - 1 THEN sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) END AS far FROM pose WINDOW w AS (PARTITION BY track, joint ORDER BY frame)",
        m=f"SELECT track, frame, max(t) AS t, avg(far) FILTER (joint IN (9, 10)) AS wrist, {_JOINTS_XY} FROM l GROUP BY track, frame",
        b="SELECT *, (x11 + x12) / 2 AS hx, (y11 + y12) / 2 AS hy, sqrt(power((x5 + x6 - x11 - x12) / 2, 2) + power((y5 + y6 - y11 - y12) / 2, 2)) AS torso FROM m",
        sp="SELECT *, nullif(torso, 0) AS s, CASE WHEN lag(frame) OVER f = frame - 1 THEN t - lag(t) OVER f END AS dt, (torso + lag(torso) OVER f) / 2 AS sc FROM b WINDOW f AS (PARTITION BY track ORDER BY frame)",
    ),
    "context_features": with_views(
        "pose",
        f"""SELECT track, count(*) AS frames_present, round(max(t) - min(t), 6) AS span_s, round(count(*) / {_SHARE}, 6) AS visible_fraction, round(avg(conf), 6) AS mean_confidence, round(median(height), 6) AS median_height,
        round(median(cx) / (SELECT max(edge) FROM b), 6) + 0.0 AS median_x_fraction, round(median(cy) / (SELECT max(edge) FROM b), 6) + 0.0 AS median_y_fraction FROM b GROUP BY track""",
        b="""SELECT track, frame, max(t) AS t, avg(CASE WHEN px IS NOT NULL THEN c END) AS conf, max(py) - min(py) AS height, max(greatest(abs(px), abs(py))) AS edge,
        coalesce(avg(px) FILTER (joint IN (11, 12)), avg(px)) AS cx, coalesce(avg(py) FILTER (joint IN (11, 12)), avg(py)) AS cy FROM pose GROUP BY track, frame""",
    ),
    "histogram_distance": with_views(
        "pose",
        "SELECT p.frame, p.track AS a, q.track AS b, round(sqrt(greatest(1 - sum(sqrt(p.f * q.f)), 0)), 5) AS distance FROM h p JOIN h q ON p.frame = q.frame AND p.bin = q.bin AND p.track < q.track GROUP BY ALL",
        v="SELECT track, frame, least(CAST(floor(c * 10) AS INTEGER), 9) AS bin FROM pose WHERE px IS NOT NULL",
        h="""SELECT b.track, b.frame, r.bin, coalesce(n, 0) / total AS f FROM (SELECT track, frame, count(*) AS total FROM v GROUP BY ALL) b CROSS JOIN (SELECT unnest(range(10)) AS bin) r
        LEFT JOIN (SELECT track, frame, bin, count(*) AS n FROM v GROUP BY ALL) c ON c.track = b.track AND c.frame = b.frame AND c.bin = r.bin""",
    ),
    "track_summary_best_frame": with_views(
        "pose",
        "SELECT b.track, count(*) AS frames, max(frame) FILTER (k = 1) AS best_frame, max(nose_frames) AS nose_frames FROM b LEFT JOIN (SELECT track, count(*) AS nose_frames FROM pose WHERE joint = 0 AND c >= 0.3 GROUP BY track) n USING (track) GROUP BY b.track",
        b="SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY avg(c) DESC, frame) AS k FROM pose GROUP BY track, frame",
    ),
}
