"""Queries of the series, identity, learning and registry operators, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.columns import similarity as similarity_of
from cadenza.operators import features, identity, learning, registry, series, tracking
from cadenza.plans.motion_queries import rounded
from cadenza.plans.oracle import with_views
from cadenza.sources import bridge, records

TRACK = ["track"]
PAIR = {"weights": {"size": -0.8, "motion": -1.5, "gap": -0.4}, "bias": 0.6, "mean": {"size": 0.3, "motion": 0.4, "gap": 10000.0}, "std": {"size": 0.4, "motion": 0.3, "gap": 5000.0}}
SCORER = {"features": ["n_chars", "toxic"], "coefficients": [0.2, -0.1], "bias": 0.55, "medians": [1500.0, 0.0], "mean": [2000.0, 0.1], "std": [1500.0, 0.3]}


def json_props_scan(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.to_json(F.struct(F.col("event_type"), F.col("user_id"))).alias("doc"))


def label_synonyms(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events")
    said = F.when(F.col("event_type").isin("click", "view"), " Dancer ").when(F.col("event_type") == "purchase", "YES").when(F.col("event_type") == "signup", "bystander").otherwise("non-dancer")
    return e.withColumn("said", said).groupBy(records.label("said").alias("label")).agg(F.count("*").alias("n"))


def moving_mean(spark, sf_dir):
    return rounded(series.moving_mean(bridge.signal(spark, sf_dir), TRACK, "i", "value", 5, "mean").select("track", "i", "mean"), "mean")


def gap_lengths(spark, sf_dir):
    return series.gap_lengths(bridge.signal(spark, sf_dir), TRACK, "i", "value").select("track", "i", "gap")


def gap_fill_short(spark, sf_dir):
    return rounded(series.smooth_gaps(bridge.signal(spark, sf_dir), TRACK, "i", "value", "filled", 5, 2).select("track", "i", "filled"), "filled")


def interp_full(spark, sf_dir):
    return rounded(series.interpolate(bridge.signal(spark, sf_dir), TRACK, "i", "value", "filled", None, 4).select("track", "i", "filled"), "filled")


def visibility_segments(spark, sf_dir):
    s = series.islands(bridge.signal(spark, sf_dir), TRACK, "t", 7200.0, tie="i")
    return rounded(s.groupBy("track", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")), "t0", "t1", digits=3)


def low_info_spans(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).where("value IS NULL")
    s = s.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("track").orderBy("i")))
    return s.groupBy("track", "island").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("island")


def asof_nearest_both_sides(spark, sf_dir):
    s = bridge.signal(spark, sf_dir)
    left = s.where("kind = 'purchase'").select("track", "event_id", "t")
    right = s.where("kind = 'click' AND value IS NOT NULL").select("track", "t", "value")
    out = series.nearest(left, right, TRACK, "t", "value")
    return rounded(out.select("track", "event_id", "nearest_t", "nearest"), "nearest_t", "nearest", digits=3)


def asof_interpolate(spark, sf_dir):
    s = bridge.signal(spark, sf_dir)
    times = s.where("kind = 'purchase'").select("track", "event_id", "t")
    return rounded(series.resample(s.where("kind = 'click'"), times, TRACK, "t", "value", "resampled").select("track", "event_id", "resampled"), "resampled")


def time_bins(spark, sf_dir):
    return rounded(series.time_bins(bridge.signal(spark, sf_dir), TRACK, "i", "value", 20), "value")


def phase_unwrap(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).where("value IS NOT NULL").withColumn("angle", F.atan2(F.sin(F.col("value")), F.cos(F.col("value"))))
    return rounded(series.unwrap(s, TRACK, "i", "angle", "unwrapped").select("track", "i", "unwrapped"), "unwrapped")


def separated_peaks(spark, sf_dir):
    return rounded(series.separated_peaks(bridge.signal(spark, sf_dir), TRACK, "t", "value", ["i"], 3, 86400.0).select("track", "rank", "i", "value"), "value")


def link_candidates(spark, sf_dir):
    return rounded(tracking.link_candidates(bridge.tracklets(spark, sf_dir), TRACK, 20000.0, 0.4), "gap", "cost", digits=3)


def band_anti_overlap_pairs(spark, sf_dir):
    return rounded(identity.band_pairs(bridge.tracklets(spark, sf_dir), TRACK, 20000.0), "gap", "size", "motion", digits=5)


def pair_examples(spark, sf_dir):
    t = bridge.tracklets(spark, sf_dir)
    truth = t.select("track", "tracklet", (F.col("n") % 2).alias("person"))
    e = identity.examples(identity.band_pairs(t, TRACK, 20000.0), truth, TRACK)
    return e.groupBy("track", "same").agg(F.count("*").alias("n"))


def identity_probability(spark, sf_dir):
    p = identity.band_pairs(bridge.tracklets(spark, sf_dir), TRACK, 20000.0)
    return rounded(p.select("track", "a", "b", identity.probability(**PAIR).alias("p")), "p")


def identity_fit(spark, sf_dir):
    t = bridge.tracklets(spark, sf_dir)
    truth = t.select("track", "tracklet", (F.col("n") % 2).alias("person"))
    e = identity.examples(identity.band_pairs(t, TRACK, 20000.0), truth, TRACK).na.drop(subset=["size", "motion"])
    m = identity.fit(e, ["size", "motion", "gap"], "same")
    return spark.createDataFrame([(m["status"], m["rows"], *[float(m["weights"][f]) for f in ("size", "motion", "gap")])], "status string, rows long, w_size double, w_motion double, w_gap double")


def complete_linkage_groups(spark, sf_dir):
    p = identity.band_pairs(bridge.tracklets(spark, sf_dir), TRACK, 20000.0)
    return identity.complete_linkage(p.select("track", "a", "b", identity.probability(**PAIR).alias("p")).where("p >= 0.5"), TRACK, 0.6)


def merge_ids(spark, sf_dir):
    return _persons(identity.merge(_turns(spark, sf_dir), [[0, 2]]))


def edit_replay_split(spark, sf_dir):
    return _persons(identity.replay(_turns(spark, sf_dir), [{"op": "split", "person": 1, "frame": 2}]))


def edit_replay_swap(spark, sf_dir):
    return _persons(identity.replay(_turns(spark, sf_dir), [{"op": "swap", "people": [0, 1], "frames": [1, 3]}]))


def edit_replay_remove(spark, sf_dir):
    return _persons(identity.replay(_turns(spark, sf_dir), [{"op": "remove", "person": 0, "frames": [1, 2]}]))


def edit_replay_log(spark, sf_dir):
    log = [{"op": "split", "person": 1, "frame": 3}, {"op": "merge", "groups": [[0, 1]]}, {"op": "remove", "person": 0, "frames": [0, 0]}]
    return _persons(identity.replay(_turns(spark, sf_dir), log))


def _turns(spark, sf_dir):
    t = bridge.turns(spark, sf_dir).withColumn("det", F.lit(0).cast("long")).select("run", "frame", "det", "person", "size")
    return identity.one_each(identity.compact(t))


def _persons(df):
    return df.select("run", "frame", "person")


def track_identity(spark, sf_dir):
    base = _turns(spark, sf_dir)
    x = identity.cross_table(base, identity.apply_edit(base, {"op": "split", "person": 1, "frame": 2}))
    return x.select("run", "base", F.size("finals").cast("long").alias("n_finals"), "final")


def fragments_after(spark, sf_dir):
    base = _turns(spark, sf_dir)
    return identity.fragments(base, identity.merge(base, [[0, 1]]))


def best_duplicate(spark, sf_dir):
    b = tracking.best_duplicate(bridge.detections(spark, sf_dir), ["frame", "person"], "conf", "det")
    return b.select("frame", "det", "kept")


def dense_renumber(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    return tracking.source_tracks(t, ["run"], "frame", "person")


def time_features(spark, sf_dir):
    f = features.time_features(bridge.signal(spark, sf_dir), TRACK, "i", "value", 50.0)
    return rounded(f, *[c for c in f.columns if c not in ("track", "n")])


def power_spectrum(spark, sf_dir):
    return rounded(features.power_spectrum(bridge.signal(spark, sf_dir), TRACK, "i", "value", 30.0, 32).select("track", "w", "k", "freq", "power"), "freq", "power", digits=3)


def spectral_statistics(spark, sf_dir):
    p = features.power_spectrum(bridge.signal(spark, sf_dir), TRACK, "i", "value", 30.0, 32)
    s = features.spectrum_statistics(p, [*TRACK, "w"])
    return rounded(s, *[c for c in s.columns if c not in ("track", "w")], digits=5)


def spectral_features(spark, sf_dir):
    return features.spectral_features(bridge.signal(spark, sf_dir), TRACK, "i", "value", 30.0)


def stft_energy(spark, sf_dir):
    return rounded(features.window_energy(bridge.signal(spark, sf_dir), TRACK, "i", "value", 16, 8), "energy")


def window_sequences(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    return rounded(features.window_sequences(s, TRACK, "t", "value", 5.0, 9, 3.0, 0.25, 2), "mean")


def lstm_forward(spark, sf_dir):
    s = bridge.signal(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    w = features.window_sequences(s, TRACK, "t", "value", 5.0, 9, 3.0, 0.25, 2)
    seq = w.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("step", ((F.col("mean") - 50) / 25).alias("v")))).alias("s"))
    return learning.lstm_probability(seq.select("track", F.transform("s", lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("xs")), TRACK, "xs", learning.Recurrent(1))


def fps_estimates(spark, sf_dir):
    return rounded(features.rates(bridge.signal(spark, sf_dir), TRACK, "t"), "mean_rate", "median_rate", digits=9)


def similarity_map(spark, sf_dir):
    s = bridge.signal(spark, sf_dir)
    return rounded(s.select("event_id", similarity_of(F.col("value") / 100 - 0.2).alias("similarity")), "similarity")


def histogram_mean(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "embeddings").selectExpr("label", "posexplode(embedding) AS (k, v)")
    return rounded(e.groupBy("label", "k").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("mean")), "mean")


def impute_standardize(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).withColumn("length", F.when(F.col("toxic") == 0, F.col("n_chars")))
    return rounded(learning.impute_standardize(r.select("track", "length", "n_chars"), ["length", "n_chars"]).select("track", "z_length", "z_n_chars"), "z_length", "z_n_chars")


def gram_sufficient_stats(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).select("run", (F.col("n_chars") / 1000).alias("k"), "toxic", "label")
    return rounded(learning.gram(r, ["k", "toxic"], "label", ["run"]), "value", digits=4)


def grouped_cv_folds(spark, sf_dir):
    c = bridge.reviews(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"))
    return learning.folds(c, "run", "n")


def lasso_top5(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir)
    names = {"n_chars": F.col("n_chars") / 1000, "toxic": F.col("toxic"), "root": F.sqrt("n_chars"), "log": F.ln(F.col("n_chars") + 1), "place": F.col("track") % 97, "odd": F.col("track") % 2, "en": (F.col("lang") == "en").cast("int")}
    m = learning.fit_sparse(r.select("run", "label", *[c.cast("double").alias(n) for n, c in names.items()]), list(names), "label", "run")
    rows = list(zip(m.get("features", []), m.get("coefficients", []), strict=True))
    return spark.createDataFrame([(f, float(w)) for f, w in rows], "feature string, coefficient double")


def linear_score_contributions(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).select("track", "n_chars", "toxic")
    s = r.withColumns(learning.linear_score(SCORER)).select("track", "contribution_n_chars", "contribution_toxic", "score", "predicted")
    return rounded(s, "contribution_n_chars", "contribution_toxic", "score")


def review_current(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).withColumn("batch", F.col("track") % 3)
    pointer = r.groupBy("run").agg(F.max("batch").alias("batch"))
    return registry.current_reviews(r, pointer).select("run", "track", "batch", "label")


def label_corrections(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir)
    return registry.corrections(r.select("track", "label"), r.where("toxic = 0").select("track", (F.lit(1) - F.col("label") * (F.col("track") % 2)).cast("int").alias("label")), ["track"], "label")


def validation_status(spark, sf_dir):
    d, r = bridge.table(spark, sf_dir, "documents"), bridge.reviews(spark, sf_dir)
    j = d.join(r.select(F.col("track").alias("doc_id"), "label"), "doc_id", "left").withColumn("guess", F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") > 1500).cast("int")))
    return j.groupBy(registry.validation_status("label", "guess").alias("status")).agg(F.count("*").alias("n"))


def upsert_latest(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events")
    return registry.latest(e.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value"), ["user_id", "event_type"], ["us", "event_id"])


def insert_absent(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir)
    old = r.where("toxic = 1").select("track", F.lit("old").alias("origin"))
    return registry.insert_absent(old, r.select("track", F.lit("new").alias("origin")), ["track"])


def unpivot_values(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).select("run", "track", F.col("n_chars").cast("double").alias("n_chars"), F.when(F.col("toxic") == 1, 1.0).alias("toxic"))
    return registry.unpivot(r, ["run", "track"], ["n_chars", "toxic"])


def weight_history(spark, sf_dir):
    o = bridge.table(spark, sf_dir, "orders")
    snaps = o.select(F.col("o_orderkey").alias("snapshot"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created"))
    w = bridge.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("snapshot"), F.col("l_linenumber").cast("long").alias("rank")).agg(F.sum("l_quantity").alias("weight"))
    return registry.history(w, snaps)


def registry_integrity(spark, sf_dir):
    li, o = bridge.table(spark, sf_dir, "lineitem"), bridge.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0")
    return registry.violations(li, ["l_orderkey", "l_linenumber"], o, "l_orderkey", "o_orderkey", "l_discount BETWEEN 0 AND 0.08")


def cohort_enroll(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir).groupBy("run").agg(F.bool_or(F.col("toxic") == 1).alias("flagged"), F.count("*").alias("n"))
    return learning.cohort(r.withColumn("reviewed", F.col("n") >= 15), "reviewed", "run")


def usable_minus_candidate(spark, sf_dir):
    r = bridge.reviews(spark, sf_dir)
    return r.where("label = 1").select("run", "lang").distinct().exceptAll(r.where("toxic = 1").select("run", "lang").distinct())


def canonical_groups(spark, sf_dir):
    t = bridge.turns(spark, sf_dir).groupBy("run").agg(F.collect_list("person").alias("members"))
    g = identity.canonical_groups(t, [], "members")
    return g.select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def content_fingerprint(spark, sf_dir):
    d = bridge.table(spark, sf_dir, "documents")
    return d.select("doc_id", records.fingerprint(d, "text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        json_props_scan, label_synonyms, moving_mean, gap_lengths, gap_fill_short, interp_full, visibility_segments, low_info_spans, asof_nearest_both_sides,
        asof_interpolate, time_bins, phase_unwrap, separated_peaks, link_candidates, band_anti_overlap_pairs, pair_examples, identity_probability, identity_fit,
        complete_linkage_groups, merge_ids, edit_replay_split, edit_replay_swap, edit_replay_remove, edit_replay_log, track_identity, fragments_after,
        best_duplicate, dense_renumber, time_features, power_spectrum, spectral_statistics, spectral_features, stft_energy, window_sequences, lstm_forward,
        fps_estimates, similarity_map, histogram_mean, impute_standardize, gram_sufficient_stats, grouped_cv_folds, lasso_top5, linear_score_contributions,
        review_current, label_corrections, validation_status, upsert_latest, insert_absent, unpivot_values, weight_history, registry_integrity, cohort_enroll,
        usable_minus_candidate, canonical_groups, content_fingerprint,
    )
}


def _interpolated(most: str, least: int, tail: str) -> str:
    """SQL of a filled signal; ``tail`` selects from f: track, i, value, n, filled."""
    return with_views(
        "signal",
        tail,
        k="SELECT *, count(value) OVER (PARTITION BY track ORDER BY i) AS k, count(value) OVER (PARTITION BY track) AS n FROM signal",
        e="""SELECT *, CASE WHEN value IS NULL THEN count(*) FILTER (value IS NULL) OVER (PARTITION BY track, k) ELSE 0 END AS gap,
        last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY track ORDER BY i) AS li, last_value(value IGNORE NULLS) OVER (PARTITION BY track ORDER BY i) AS lv,
        first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w AS hi, first_value(value IGNORE NULLS) OVER w AS hv FROM k WINDOW w AS (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        f=f"SELECT track, i, value, n, gap, CASE WHEN value IS NOT NULL THEN value WHEN {most} AND n >= {least} THEN coalesce(lv + (hv - lv) * ((i - li) / CAST(nullif(hi - li, 0) AS DOUBLE)), lv, hv) END AS filled FROM e",
    )


_BAND = "SELECT x.track, x.tracklet AS a, y.tracklet AS b, y.t0 - x.t1 AS gap, abs(ln(x.n / y.n)) AS size, abs(x.centre - y.centre) / 100 AS motion FROM tracklets x JOIN tracklets y ON x.track = y.track AND y.t0 - x.t1 BETWEEN 0 AND 20000.0 AND x.tracklet <> y.tracklet"
_BASE = """SELECT run, frame, dense_rank() OVER (PARTITION BY run ORDER BY person) - 1 AS person FROM turns"""
_DENSE = "CASE WHEN p IS NOT NULL THEN dense_rank() OVER (PARTITION BY run ORDER BY p NULLS LAST) - 1 END"
_POWER = {
    "v": "SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS i FROM signal WHERE value IS NOT NULL",
    "u": "SELECT track, value, i // 32 AS w, i % 32 AS i, avg(value) OVER (PARTITION BY track, i // 32) AS m, count(*) OVER (PARTITION BY track, i // 32) AS n FROM v",
    "y": f"SELECT track, w, i, (value - m) * (0.5 - 0.5 * cos(2 * {math.pi} * i / 31)) AS y FROM u WHERE n = 32",
    "ps": f"SELECT track, w, CAST(k AS INTEGER) AS k, CAST(k AS DOUBLE) * 30.0 / 32 AS freq, power(sum(y * cos(2 * {math.pi} * k * i / 32)), 2) + power(sum(y * sin(2 * {math.pi} * k * i / 32)), 2) AS power FROM y, (SELECT unnest(range(1, 17)) AS k) GROUP BY track, w, k",
}
_GRAM = [("k", "k"), ("k", "toxic"), ("k", "label"), ("k", "o"), ("toxic", "toxic"), ("toxic", "label"), ("toxic", "o"), ("label", "label"), ("label", "o"), ("o", "o")]
_AT = {"k": 0, "toxic": 1, "label": 2, "o": 3}

ORACLE_SQL = {
    "json_props_scan": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS doc FROM events""",
    "label_synonyms": "SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS label, count(*) AS n FROM events GROUP BY 1",
    "moving_mean": with_views("signal", "SELECT track, i, round(avg(value) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM signal"),
    "gap_lengths": _interpolated("true", 2, "SELECT track, i, gap FROM f"),
    "gap_fill_short": _interpolated("gap <= 2", 2, "SELECT track, i, round(CASE WHEN n < 2 THEN value WHEN filled IS NOT NULL THEN avg(filled) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS filled FROM f"),
    "interp_full": _interpolated("true", 4, "SELECT track, i, round(filled, 6) AS filled FROM f"),
    "visibility_segments": with_views("tracklets", "SELECT track, tracklet AS island, round(t0, 3) AS t0, round(t1, 3) AS t1, n FROM tracklets"),
    "low_info_spans": with_views("signal", "SELECT track, min(i) AS first, max(i) AS last FROM (SELECT track, i, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM signal WHERE value IS NULL) GROUP BY track, g"),
    "asof_nearest_both_sides": with_views(
        "signal",
        "SELECT track, event_id, round(nt, 3) AS nearest_t, round(nv, 3) AS nearest FROM (SELECT l.track, l.event_id, r.t AS nt, r.value AS nv, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t, r.value) AS k FROM l LEFT JOIN r ON r.track = l.track) WHERE k = 1",
        l="SELECT track, event_id, t FROM signal WHERE kind = 'purchase'",
        r="SELECT track, t, value FROM signal WHERE kind = 'click' AND value IS NOT NULL",
    ),
    "asof_interpolate": with_views(
        "signal",
        """SELECT l.track, l.event_id, round(v0 + (v1 - v0) * least(greatest((l.t - t0) / greatest(t1 - t0, 1e-9), 0), 1), 6) + 0.0 AS resampled
        FROM l LEFT JOIN s ON s.track = l.track AND l.t > s.t0 AND l.t <= s.t1""",
        l="SELECT track, event_id, t FROM signal WHERE kind = 'purchase'",
        s="SELECT track, lag(t) OVER (PARTITION BY track ORDER BY t) AS t0, lag(value) OVER (PARTITION BY track ORDER BY t) AS v0, t AS t1, value AS v1 FROM signal WHERE kind = 'click'",
    ),
    "time_bins": with_views("signal", "SELECT track, CAST(floor(i / ceil(n / 20.0)) AS BIGINT) AS bin, round(avg(value), 6) AS value, count(*) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM signal) GROUP BY 1, 2"),
    "phase_unwrap": with_views(
        "signal",
        f"""SELECT track, i, round(a + sum(CASE WHEN abs(d) > {math.pi} THEN -2 * {math.pi} * floor((d + {math.pi}) / (2 * {math.pi})) ELSE 0 END) OVER (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS unwrapped
        FROM (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY track ORDER BY i), 0) AS d FROM (SELECT track, i, atan2(sin(value), cos(value)) AS a FROM signal WHERE value IS NOT NULL))""",
    ),
    "separated_peaks": with_views(
        "signal",
        "SELECT track, CAST(k AS BIGINT) AS rank, unnest(js[k:k]) AS i, round(unnest(ss[k:k]), 6) AS value FROM walk",
        o="SELECT *, row_number() OVER (PARTITION BY track ORDER BY value DESC, t, i) AS r FROM signal WHERE value IS NOT NULL",
        walk="""SELECT track, 1 AS k, [t] AS ts, [value] AS ss, [i] AS js FROM o WHERE r = 1 UNION ALL
        SELECT w.track, w.k + 1, list_append(w.ts, n.t), list_append(w.ss, n.value), list_append(w.js, n.i) FROM walk w, LATERAL (
          SELECT t, value, i FROM o WHERE o.track = w.track AND len(list_filter(w.ts, lambda x: abs(x - o.t) < 86400)) = 0 ORDER BY r LIMIT 1) n WHERE w.k < 3""",
    ),
    "link_candidates": with_views(
        "tracklets",
        "SELECT * FROM (SELECT track, a, b, round(gap, 3) AS gap, round(c, 3) AS cost FROM (SELECT x.track, x.tracklet AS a, y.tracklet AS b, y.t0 - x.t1 AS gap, abs(x.centre - y.centre) / 100 + 0.1 * (y.t0 - x.t1) / 20000 AS c FROM tracklets x JOIN tracklets y ON x.track = y.track AND y.t0 - x.t1 > 0 AND y.t0 - x.t1 <= 20000) WHERE c <= 0.4)",
    ),
    "band_anti_overlap_pairs": with_views("tracklets", f"SELECT track, a, b, round(gap, 5) AS gap, round(size, 5) AS size, round(motion, 5) AS motion FROM ({_BAND})"),
    "pair_examples": with_views("tracklets", f"SELECT p.track, CAST(x.n % 2 = y.n % 2 AS INTEGER) AS same, count(*) AS n FROM ({_BAND}) p JOIN tracklets x ON x.track = p.track AND x.tracklet = a JOIN tracklets y ON y.track = p.track AND y.tracklet = b GROUP BY ALL"),
    "identity_probability": with_views(
        "tracklets", f"SELECT track, a, b, round(1 / (1 + exp(-greatest(-30, least(30, 0.6 - 0.8 * (size - 0.3) / 0.4 - 1.5 * (motion - 0.4) / 0.3 - 0.4 * (gap - 10000) / 5000)))), 6) AS p FROM ({_BAND})"
    ),
    "merge_ids": with_views("turns", f"SELECT run, frame, {_DENSE} AS person FROM (SELECT run, frame, CASE WHEN person = 2 THEN 0 ELSE person END AS p FROM base)", base=_BASE),
    "edit_replay_split": with_views("turns", f"SELECT run, frame, {_DENSE} AS person FROM (SELECT run, frame, CASE WHEN person = 1 AND frame >= 2 THEN max(person) OVER (PARTITION BY run) + 1 ELSE person END AS p FROM base)", base=_BASE),
    "edit_replay_swap": with_views("turns", f"SELECT run, frame, {_DENSE} AS person FROM (SELECT run, frame, CASE WHEN frame BETWEEN 1 AND 3 AND person <= 1 THEN 1 - person ELSE person END AS p FROM base)", base=_BASE),
    "edit_replay_remove": with_views("turns", f"SELECT run, frame, {_DENSE} AS person FROM (SELECT run, frame, CASE WHEN NOT (frame BETWEEN 1 AND 2 AND person = 0) THEN person END AS p FROM base)", base=_BASE),
    "edit_replay_log": with_views(
        "turns",
        f"SELECT run, frame, {_DENSE} AS person FROM (SELECT run, frame, CASE WHEN NOT (q = 0 AND frame = 0) THEN q END AS p FROM m)",
        base=_BASE,
        s=f"SELECT run, frame, {_DENSE} AS q FROM (SELECT run, frame, CASE WHEN person = 1 AND frame >= 3 THEN max(person) OVER (PARTITION BY run) + 1 ELSE person END AS p FROM base)",
        m=f"SELECT run, frame, {_DENSE} AS q FROM (SELECT run, frame, CASE WHEN q = 1 THEN 0 ELSE q END AS p FROM s)",
    ),
    "track_identity": with_views(
        "turns",
        "SELECT run, base, count(DISTINCT final) AS n_finals, CASE WHEN count(DISTINCT final) = 1 THEN min(final) END AS final FROM (SELECT run, frame, person AS base, dense_rank() OVER (PARTITION BY run ORDER BY p) - 1 AS final FROM s) GROUP BY run, base",
        base=_BASE,
        s="SELECT *, CASE WHEN person = 1 AND frame >= 2 THEN max(person) OVER (PARTITION BY run) + 1 ELSE person END AS p FROM base",
    ),
    "fragments_after": with_views(
        "turns",
        "SELECT run, person, count(DISTINCT base) AS fragments FROM (SELECT run, base, dense_rank() OVER (PARTITION BY run ORDER BY p) - 1 AS person FROM (SELECT run, person AS base, CASE WHEN person = 1 THEN 0 ELSE person END AS p FROM base)) GROUP BY run, person",
        base=_BASE,
    ),
    "best_duplicate": with_views("detections", "SELECT frame, det, row_number() OVER (PARTITION BY frame, person ORDER BY conf DESC, det) = 1 AS kept FROM detections"),
    "dense_renumber": with_views("turns", "SELECT run, person, row_number() OVER (PARTITION BY run ORDER BY min(frame), person) - 1 AS track FROM turns GROUP BY run, person"),
    "time_features": with_views(
        "signal",
        """SELECT track, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
        round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS peak, round(avg(CAST(value > 50 AS INTEGER)), 6) AS active_fraction, round(coalesce(regr_slope(value, k), 0), 6) + 0.0 AS trend,
        round(coalesce(sum(d * l) / nullif(sum(d * d), 0), 0), 6) + 0.0 AS autocorr_lag1, round(coalesce(avg(CASE WHEN l IS NOT NULL THEN CAST((d < 0) <> (l < 0) AS INTEGER) END), 0), 6) AS zero_cross_rate
        FROM (SELECT *, lag(d) OVER (PARTITION BY track ORDER BY i) AS l FROM v) GROUP BY track""",
        v="SELECT track, i, value, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS k, value - avg(value) OVER (PARTITION BY track) AS d FROM signal WHERE value IS NOT NULL",
    ),
    "power_spectrum": with_views("signal", "SELECT track, w, k, round(freq, 3) AS freq, round(power, 3) AS power FROM ps", **_POWER),
    "spectral_statistics": with_views(
        "signal",
        """SELECT track, w, round(arg_max(freq, power), 5) AS dominant_hz, round(max(c), 5) AS centroid_hz, round(sqrt(sum(power(freq - c, 2) * p)), 5) AS bandwidth_hz, round(-sum(p * ln(p + 1e-12)) / ln(count(*)), 5) AS entropy,
        round(exp(avg(ln(power + 1e-12))) / avg(power), 5) AS flatness, round(coalesce(sum(p) FILTER (freq >= 0.25 AND freq < 1.5), 0), 5) AS low_band_ratio, round(coalesce(sum(p) FILTER (freq >= 1.5 AND freq <= 6), 0), 5) AS high_band_ratio
        FROM (SELECT *, sum(freq * p) OVER (PARTITION BY track, w) AS c FROM q) GROUP BY track, w""",
        **_POWER,
        q="SELECT *, power / sum(power) OVER (PARTITION BY track, w) AS p FROM ps",
    ),
    "stft_energy": with_views(
        "signal",
        "SELECT track, w, round(sqrt(avg(value * value)), 6) AS energy FROM v JOIN (SELECT CAST(unnest(range(0, 100000)) AS BIGINT) AS w) g ON v.k BETWEEN 8 * w AND 8 * w + 15 GROUP BY track, w HAVING count(*) = 16",
        v="SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS k FROM signal WHERE value IS NOT NULL",
    ),
    "window_sequences": with_views(
        "signal",
        """SELECT g.track, CAST(g.step AS INTEGER) AS step, count(v.value) AS n, round(CASE WHEN count(v.value) >= 2 THEN avg(v.value) END, 6) AS mean FROM g
        LEFT JOIN v ON v.track = g.track AND d - first >= g.step * 0.25 - 1e-6 AND d - first < g.step * 0.25 + 3 - 1e-6 AND d - first >= -1e-6 GROUP BY g.track, g.step""",
        v="SELECT track, t / 86400 AS d, value FROM signal",
        g="SELECT track, first, unnest(range(9)) AS step FROM (SELECT track, min(d) + (max(d) - min(d) - 5) / 2 AS first FROM v GROUP BY track HAVING max(d) - min(d) >= 5)",
    ),
    "fps_estimates": with_views(
        "signal",
        "SELECT track, round(coalesce((count(*) - 1) / nullif(max(t) - min(t), 0), 30), 9) AS mean_rate, round(1 / nullif(median(d), 0), 9) AS median_rate FROM (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS d FROM signal) GROUP BY track",
    ),
    "similarity_map": with_views("signal", "SELECT event_id, round(CASE WHEN value / 100 - 0.2 >= 0 THEN 100 / (1 + (value / 100 - 0.2)) END, 6) AS similarity FROM signal"),
    "histogram_mean": "SELECT label, CAST(k - 1 AS INTEGER) AS k, round(avg(abs(CAST(v AS DOUBLE))), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY ALL",
    "impute_standardize": with_views(
        "reviews",
        """SELECT track, round((f - avg(f) OVER ()) / CASE WHEN stddev_pop(f) OVER () <= 1e-12 THEN 1 ELSE stddev_pop(f) OVER () END, 6) + 0.0 AS z_length,
        round((n_chars - avg(n_chars) OVER ()) / CASE WHEN stddev_pop(n_chars) OVER () <= 1e-12 THEN 1 ELSE stddev_pop(n_chars) OVER () END, 6) + 0.0 AS z_n_chars
        FROM (SELECT track, n_chars, CAST(coalesce(CASE WHEN toxic = 0 THEN n_chars END, (SELECT median(n_chars) FROM reviews WHERE toxic = 0)) AS DOUBLE) AS f FROM reviews)""",
    ),
    "gram_sufficient_stats": with_views(
        "reviews",
        "SELECT run, n, i, j, round(value, 4) AS value FROM (" + " UNION ALL ".join(f"SELECT run, count(*) AS n, {_AT[a]} AS i, {_AT[b]} AS j, CAST(sum({a} * {b}) AS DOUBLE) AS value FROM x GROUP BY run" for a, b in _GRAM) + ")",
        x="SELECT run, n_chars / 1000 AS k, toxic, label, 1.0::DOUBLE AS o FROM reviews",
    ),
    "linear_score_contributions": with_views(
        "reviews",
        """SELECT track, round(a, 6) + 0.0 AS contribution_n_chars, round(b, 6) + 0.0 AS contribution_toxic, round(0.55 + a + b, 6) AS score, CAST(0.55 + a + b >= 0.5 AS INTEGER) AS predicted
        FROM (SELECT track, (CAST(n_chars AS DOUBLE) - 2000.0) / 1500.0 * 0.2 AS a, (CAST(toxic AS DOUBLE) - 0.1) / 0.3 * -0.1 AS b FROM reviews)""",
    ),
    "review_current": with_views("reviews", "SELECT r.run, track, track % 3 AS batch, label FROM reviews r JOIN (SELECT run, max(track % 3) AS batch FROM reviews GROUP BY run) p ON p.run = r.run AND track % 3 = p.batch"),
    "label_corrections": with_views(
        "reviews",
        "SELECT track, label AS shown, CASE WHEN toxic = 0 THEN CAST(1 - label * (track % 2) AS INTEGER) END AS saved FROM reviews WHERE label IS DISTINCT FROM CASE WHEN toxic = 0 THEN 1 - label * (track % 2) END",
    ),
    "validation_status": """SELECT CASE WHEN quality IS NULL THEN 'Unreviewed' WHEN guess IS NULL THEN 'Reviewed without prediction' WHEN quality = guess THEN 'Validated correct' ELSE 'Corrected' END AS status, count(*) AS n
        FROM (SELECT l.quality, CASE WHEN d.doc_id % 5 <> 0 THEN CAST(n_chars > 1500 AS INTEGER) END AS guess FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""",
    "upsert_latest": "SELECT user_id, event_type, event_id, epoch_us(ts) AS us, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "grouped_cv_folds": with_views(
        "reviews",
        "SELECT run, fold FROM walk WHERE r > 0",
        o="SELECT run, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, run) AS r FROM reviews GROUP BY run",
        walk="""SELECT 0::BIGINT AS r, [0::BIGINT FOR k IN range(least(5, (SELECT count(*) FROM o)))] AS sizes, NULL::VARCHAR AS run, NULL::BIGINT AS fold
        UNION ALL SELECT o.r, [sizes[k] + CASE WHEN k = list_position(sizes, list_min(sizes)) THEN o.n ELSE 0 END FOR k IN range(1, len(sizes) + 1)], o.run, CAST(list_position(sizes, list_min(sizes)) - 1 AS BIGINT) FROM walk JOIN o ON o.r = walk.r + 1""",
    ),
    "insert_absent": with_views("reviews", "SELECT track, CASE WHEN toxic = 1 THEN 'old' ELSE 'new' END AS origin FROM reviews"),
    "unpivot_values": with_views("reviews", "SELECT run, track, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value FROM reviews UNION ALL SELECT run, track, 'toxic', 1.0::DOUBLE FROM reviews WHERE toxic = 1"),
    "weight_history": """SELECT snapshot, created, rank, weight, row_number() OVER (ORDER BY created, snapshot, rank) AS place FROM (
        SELECT l_orderkey AS snapshot, epoch_us(o_orderdate) AS created, CAST(l_linenumber AS BIGINT) AS rank, sum(l_quantity) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)""",
    "registry_integrity": """SELECT 'primary key' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        UNION ALL SELECT 'check', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08)
        UNION ALL SELECT 'foreign key', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)""",
    "cohort_enroll": with_views("reviews", "SELECT run, row_number() OVER (ORDER BY run) AS place FROM (SELECT run FROM reviews GROUP BY run HAVING count(*) >= 15 ORDER BY run LIMIT 15)"),
    "usable_minus_candidate": with_views("reviews", "SELECT DISTINCT run, lang FROM reviews WHERE label = 1 EXCEPT SELECT run, lang FROM reviews WHERE toxic = 1"),
    "canonical_groups": with_views("turns", "SELECT DISTINCT array_to_string(g, ',') AS members FROM (SELECT list_sort(list_distinct(list(person))) AS g FROM turns GROUP BY run) WHERE len(g) >= 2"),
    "content_fingerprint": "SELECT doc_id, sha256(text) AS digest FROM documents",
}
