"""SQL of the bridge views, from which the queries' SQL is put together."""

from __future__ import annotations



def _smooth(axis: str) -> str:
    """Columns of a reference axis over a grid: filled over short gaps, then averaged."""
    return f"""
g{axis}0 AS (SELECT frame, joint, n{axis} AS v, count(n{axis}) OVER (PARTITION BY joint ORDER BY frame) AS k, count(n{axis}) OVER (PARTITION BY joint) AS n FROM grid),
g{axis}1 AS (SELECT *, CASE WHEN v IS NULL THEN count(*) FILTER (v IS NULL) OVER (PARTITION BY joint, k) ELSE 0 END AS gap,
  last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY joint ORDER BY frame) AS lf, last_value(v IGNORE NULLS) OVER (PARTITION BY joint ORDER BY frame) AS lv,
  first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY joint ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hf,
  first_value(v IGNORE NULLS) OVER (PARTITION BY joint ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hv FROM g{axis}0),
g{axis}2 AS (SELECT frame, joint, v, n, CASE WHEN v IS NOT NULL THEN v WHEN gap <= 8 AND n >= 2 THEN coalesce(lv + (hv - lv) * ((frame - lf) / CAST(nullif(hf - lf, 0) AS DOUBLE)), lv, hv) END AS f FROM g{axis}1),
r{axis} AS (SELECT frame, joint, CASE WHEN n < 2 THEN v WHEN f IS NOT NULL THEN avg(f) OVER (PARTITION BY joint ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS r{axis} FROM g{axis}2)"""


VIEWS = {
    "pose": """
pose0 AS (SELECT CAST(label AS BIGINT) AS track, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings),
pose1 AS (SELECT track, frame, CAST(frame AS DOUBLE) / 30 AS t, CAST(j AS INTEGER) AS joint, CAST(e[3 * j + 1] AS DOUBLE) AS x, CAST(e[3 * j + 2] AS DOUBLE) AS y, least(1.0::DOUBLE, abs(CAST(e[3 * j + 3] AS DOUBLE)) * 8) AS c
  FROM pose0, (SELECT unnest(range(17)) AS j)),
pose AS (SELECT *, CASE WHEN c >= 0.3 THEN x END AS px, CASE WHEN c >= 0.3 THEN y END AS py FROM pose1)""",
    "norm": """
body0 AS (SELECT track, frame, max(px) FILTER (joint = 5) AS x5, max(py) FILTER (joint = 5) AS y5, max(px) FILTER (joint = 6) AS x6, max(py) FILTER (joint = 6) AS y6,
  max(px) FILTER (joint = 11) AS x11, max(py) FILTER (joint = 11) AS y11, max(px) FILTER (joint = 12) AS x12, max(py) FILTER (joint = 12) AS y12 FROM pose GROUP BY track, frame),
body1 AS (SELECT track, frame, coalesce((x11 + x12) / 2, x11, x12) AS hx, coalesce((y11 + y12) / 2, y11, y12) AS hy, coalesce((x5 + x6) / 2, x5, x6) AS sx, coalesce((y5 + y6) / 2, y5, y6) AS sy FROM body0),
body2 AS (SELECT track, frame, avg(sqrt((sx - hx) * (sx - hx) + (sy - hy) * (sy - hy))) OVER w15 AS scale, avg(hx) OVER w3 AS ox, avg(hy) OVER w3 AS oy,
  atan2(avg(sin(atan2(sx - hx, hy - sy))) OVER w15, avg(cos(atan2(sx - hx, hy - sy))) OVER w15) AS rot FROM body1
  WINDOW w15 AS (PARTITION BY track ORDER BY frame RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING), w3 AS (PARTITION BY track ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
norm AS (SELECT p.*, rot, (px - ox) / nullif(scale, 0) AS nx, (py - oy) / nullif(scale, 0) AS ny, CASE WHEN (px - ox) / nullif(scale, 0) IS NOT NULL THEN c END AS nc FROM pose p JOIN body2 USING (track, frame))""",
    "dev": """
grid AS (SELECT f.frame, j.joint, n.nx, n.ny FROM (SELECT DISTINCT frame FROM norm) f CROSS JOIN (SELECT DISTINCT joint FROM norm WHERE track = 0) j LEFT JOIN norm n ON n.track = 0 AND n.frame = f.frame AND n.joint = j.joint),"""
    + _smooth("x")
    + ","
    + _smooth("y")
    + """,
ref AS (SELECT frame, joint, rx, ry FROM rx JOIN ry USING (frame, joint)),
dev AS (SELECT n.track, n.frame, n.t, n.joint, CASE WHEN n.track <> 0 THEN sqrt(power(nx - rx, 2) + power(ny - ry, 2)) END AS deviation, nx - rx AS dx, ny - ry AS dy FROM norm n LEFT JOIN ref USING (frame, joint))""",
    "coach": """
shown AS (SELECT *, count(nx) OVER (PARTITION BY frame, joint) AS peers FROM norm),
cmp AS (SELECT d.* FROM dev d JOIN shown s USING (track, frame, joint) WHERE deviation IS NOT NULL AND s.nx IS NOT NULL AND peers >= 2),
el0 AS (SELECT *, count(*) OVER (PARTITION BY track, frame) AS n FROM cmp),
el AS (SELECT *, CASE WHEN joint <= 4 THEN 'head' WHEN joint <= 10 THEN 'arms' WHEN joint <= 12 THEN 'torso' ELSE 'legs' END AS region, CASE WHEN joint <= 4 THEN 1 WHEN joint <= 10 THEN 2 WHEN joint <= 12 THEN 3 ELSE 4 END AS o FROM el0 WHERE n >= 6)""",
    "signal": """
signal AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN value END AS value, event_type AS kind, event_id FROM events)""",
    "tracklets": """
isl0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t, i) > 7200 THEN 1 ELSE 0 END AS b FROM signal),
isl AS (SELECT *, CAST(sum(b) OVER (PARTITION BY track ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tracklet FROM isl0),
tracklets AS (SELECT track, tracklet, min(t) AS t0, max(t) AS t1, count(*) AS n, avg(value) AS centre FROM isl GROUP BY track, tracklet)""",
    "detections": """
detections AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS det,
  l_discount * 10 AS conf, l_quantity AS size, CAST(l_linenumber AS BIGINT) AS id, l_suppkey % 7 AS person FROM lineitem)""",
    "reviews": """
reviews AS (SELECT source AS run, doc_id AS track, CAST(quality AS INTEGER) AS label, CAST(toxic AS INTEGER) AS toxic, n_chars, lang FROM documents JOIN labels USING (doc_id))""",
    "turns": """
turns AS (SELECT conv_id AS run, turn AS frame, CAST(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS BIGINT) AS person, CAST(length(text) AS BIGINT) AS size FROM conversations)""",
}
NEEDS = {"norm": ("pose",), "dev": ("pose", "norm"), "coach": ("pose", "norm", "dev"), "tracklets": ("signal",)}


def with_views(view: str, select: str, **more: str) -> str:
    """The select over a bridge view, the views that it needs, and further named ones."""
    parts = [VIEWS[v] for v in (*NEEDS.get(view, ()), view)] + [f"{name} AS ({sql})" for name, sql in more.items()]
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select
