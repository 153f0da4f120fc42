"""Metrics, calibration, A/B statistics and robust statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import metrics, sequence
from timeloom.queries.base import FRAMES, frames, rounded, table
from timeloom.queries.joining import RESULTS, results

KEY = ["user_id"]


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(frames(spark, d), "gt", "pred", 5)


def class_metrics(spark, d):
    return rounded(metrics.class_metrics(confusion_matrix(spark, d)), "precision", "recall", "f1")


def f1_scores(spark, d):
    return rounded(metrics.f1_scores(metrics.class_metrics(confusion_matrix(spark, d))), "f1_macro", "f1_weighted")


def label_confusion(spark, d):
    """Document labels: quality as truth, toxicity as prediction."""
    return metrics.confusion_matrix(table(spark, d, "labels"), "quality", "toxic", 2)


def accuracy_report(spark, d):
    return rounded(metrics.accuracy_report(frames(spark, d), "gt", "pred", KEY), "accuracy")


def class_accuracy(spark, d):
    return metrics.class_accuracy(frames(spark, d), "gt", "pred")


def conditional_accuracy(spark, d):
    return rounded(metrics.conditional_accuracy(frames(spark, d), "gt", "pred", 4), "transition_accuracy", "skill_accuracy")


def pooled_accuracy(spark, d):
    return rounded(metrics.pooled_accuracy(frames(spark, d), "user_id", "gt", "pred"), "accuracy")


def pooled_edit_score(spark, d):
    """Edit score over all users as one sequence."""
    return rounded(metrics.pooled_edit_score(frames(spark, d), ["user_id"], "frame", "pred", "cls").withColumn("all", F.lit(0)), "edit_score")


def class_weights(spark, d):
    return rounded(metrics.class_weights(frames(spark, d), "gt", 6, "sqrt_inverse"), "weight")


def confidences(spark, d):
    p = F.round(F.col("value") / 500, 6)
    f = frames(spark, d).select("user_id", "frame", "cls", (F.col("cls") == 2).cast("int").alias("y"), p.alias("p"))
    return f.withColumns({"probabilities": F.array(1 - F.col("p"), F.col("p")), "correct": F.col("y") == 1})


PROB = f"{FRAMES}, c AS (SELECT user_id, frame, round(value / 500, 6) AS p, CASE WHEN cls = 2 THEN 1 ELSE 0 END AS y FROM f)"


def calibration_right(spark, d):
    return rounded(metrics.calibration_bins(confidences(spark, d), "p", "correct"), "confidence", "accuracy")


def calibration_left(spark, d):
    return rounded(metrics.calibration_bins(confidences(spark, d), "p", "correct", right_closed=False), "confidence", "accuracy")


def expected_calibration_error(spark, d):
    return rounded(metrics.expected_calibration_error(metrics.calibration_bins(confidences(spark, d), "p", "correct")), "ece")


def brier_score(spark, d):
    return rounded(metrics.brier_score(confidences(spark, d), "probabilities", "y"), "brier")


def log_loss(spark, d):
    return rounded(metrics.log_loss(confidences(spark, d), "probabilities", "y", 1e-6), "log_loss")


def ensemble_sweep(spark, d):
    f = confidences(spark, d).withColumn("other", F.array(F.lit(0.3), F.lit(0.7)))
    return rounded(metrics.ensemble_sweep(f, "probabilities", "other", "y"), "alpha", "accuracy", "f1_macro")


def best_weight(spark, d):
    f = confidences(spark, d).withColumn("other", F.array(F.lit(0.3), F.lit(0.7)))
    return rounded(metrics.best_weight(metrics.ensemble_sweep(f, "probabilities", "other", "y")), "alpha")


def seed_summary(spark, d):
    return rounded(metrics.seed_summary(results(spark, d), ["variant", "fold"], "metric"), "mean", "std", "min", "max")


def holdout_summary(spark, d):
    return rounded(metrics.holdout_summary(results(spark, d), "variant", "metric"), "mean", "std")


def class_holdout(spark, d):
    per = F.map_from_entries(F.collect_list(F.struct(F.col("fold"), F.struct(F.col("n").alias("support"), F.col("metric").alias("accuracy")))))
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("fold"))
    r = li.agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("metric"), F.count(F.lit(1)).alias("n"))
    return rounded(metrics.class_holdout(r.groupBy("variant", "seed").agg(per.alias("per_class")), "variant", "per_class"), "recall")


def fold_mean(spark, d):
    return rounded(metrics.fold_mean(results(spark, d), ["variant", "seed"], "fold", "metric", "support"), "mean")


def finite_summary(spark, d):
    return rounded(metrics.finite_summary(frames(spark, d).withColumn("v", F.when(F.col("frame") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), ["event_type"], "v"), "mean", "median", "p05", "p95", "min", "max", "finite_fraction")


def validity_contingency(spark, d):
    f = frames(spark, d).select("event_type", (F.col("value") > 50).alias("a"), (F.col("frame") % 3 > 0).alias("b"))
    return rounded(metrics.validity_contingency(f, ["event_type"], "a", "b"), "agreement")


def masks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x > 0.1).alias("a"), F.transform("embedding", lambda x: x > 0.12).alias("b"))


def mask_ab(spark, d):
    out = metrics.mask_ab(masks(spark, d), "a", "b").select("vec_id", "iou", "active_iou", "equal", "both_empty", "flip_rate", "count_delta")
    return rounded(out, "iou", "active_iou", "flip_rate")


def sparse(spark, d, low):
    """Pixels from embeddings: a vector is a frame, its 8 x 8 entries the image. The threshold is a float as the entries are: one just at it isn't above."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), (F.col("vec_id") % 50).alias("frame"), F.posexplode("embedding").alias("i", "v"))
    return e.where(F.col("v") > F.lit(low).cast("float")).select("recording", "frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "v")


PIXELS = "px AS (SELECT vec_id // 50 AS recording, vec_id % 50 AS frame, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def mask_diff(spark, d):
    return rounded(metrics.mask_diff(sparse(spark, d, 0.1), sparse(spark, d, 0.12).where("x < 7"), ["recording"], ["y", "x"]), "jaccard")


def pixel_error(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("r_a"), (F.col("l_linenumber") * 7).alias("r_b"), (F.col("l_partkey") % 50).alias("g_a"), (F.col("l_suppkey") % 50).alias("g_b"), (F.col("l_orderkey") % 2 == 0).alias("in_support"))
    return rounded(metrics.pixel_error(li, ["l_returnflag"], ["r", "g"], "in_support"), "abs_sum", "mean_abs", "changed_ratio", "max_abs")


def track_confidence(spark, d):
    f = frames(spark, d)
    e = f.select(F.lit(0).alias("recording"), F.col("user_id").alias("track"), F.col("frame"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 2).alias("handedness"))
    spine = f.select(F.lit(0).alias("recording"), "frame").distinct()
    return rounded(metrics.track_confidence(e, spine, 1), "confidence")


def policy_error(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("episode"), F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("p"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("a"))
    return rounded(metrics.policy_error(e, "episode", "p", "a"), "mse", "mae")


def robust_location(spark, d):
    return rounded(metrics.robust_location(frames(spark, d).select("user_id", "value"), KEY, "value", 1.0, 300.0, 20), "location")


def mad_threshold(spark, d):
    return rounded(metrics.mad_threshold(frames(spark, d).select("event_type", "value"), ["event_type"], "value", 10.0), "threshold")


def drop_worst(spark, d):
    return metrics.drop_worst(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", 50.0, 8)


def top_fraction_mean(spark, d):
    return rounded(metrics.top_fraction_mean(table(spark, d, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")), ["l_suppkey"], "cents", 0.05, 10), "score", places=4)


def group_mean_max(spark, d):
    return rounded(metrics.group_mean_max(frames(spark, d).select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents")), ["user_id", "event_type"], "cents"), "mean", "max")


def zbuffer_min(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    p = e.select("recording", (F.col("x") * 20).alias("u"), (F.col("y") * 20).alias("v"), (F.col("z") + 0.3).alias("z"))
    return rounded(metrics.zbuffer_min(p, ["recording"], "u", "v", "z"), "depth")


def cluster_table(spark, d):
    return metrics.contingency(frames(spark, d).withColumn("c", F.least(F.floor(F.col("value") / 25), F.lit(6))), "c", "cls")


def cluster_metrics(spark, d):
    return rounded(metrics.cluster_metrics(cluster_table(spark, d)), "purity", "ari", "homogeneity", "completeness", "v_measure")


def centroid_similarity(spark, d):
    return rounded(metrics.centroid_similarity(table(spark, d, "embeddings"), "embedding", "label"), "cosine")


def bbox_from_points(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), (F.col("label") < 8).alias("valid"), (F.col("embedding")[0].cast("double") * 200 + 320).alias("u"), (F.col("embedding")[1].cast("double") * 200 + 240).alias("v"))
    return rounded(metrics.bbox_from_points(e, ["recording"], 640, 480), "x0", "y0", "x1", "y1", "cx", "cy", "edge_distance")


def estimated_fps(spark, d):
    f = frames(spark, d).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rounded(metrics.estimated_fps(f, KEY, "us"), "median_step", "min_step", "max_step", places=3).withColumn("fps", F.round(F.col("fps") * 1e9, 3))


def histogram(spark, d):
    f = frames(spark, d).select("event_type", "value")
    low, high = metrics.value_range(f, "value")
    return metrics.histogram(f, ["event_type"], "value", low, high, 12)


def daily(spark, d, kind):
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.lit(0).alias("g"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("v"))


def lag_correlation(spark, d):
    return rounded(metrics.lag_correlation(daily(spark, d, "click"), daily(spark, d, "view"), ["g"], "day", "v", 5), "correlation")


def estimate_offset(spark, d):
    lags = metrics.lag_correlation(daily(spark, d, "click"), daily(spark, d, "view"), ["g"], "day", "v", 5)
    return rounded(metrics.estimate_offset(lags, ["g"], 0.3, 0.1), "peak", "refined_lag", "zero_lag", "prominence").withColumn("reasons", F.array_join("reasons", ","))


def fit_line(spark, d):
    return rounded(metrics.fit_line(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", "l_quantity"), "slope", "intercept", places=2)


def rigid_fit(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("ax", "ay", "az"))])
    p = e.select("recording", "ax", "ay", "az", (-F.col("ay") + 1).alias("bx"), (F.col("ax") + 2).alias("by"), (F.col("az") + 3).alias("bz"))
    out = metrics.rigid_fit(p, ["recording"])
    return rounded(out.select("recording", *[F.col("rotation")[i].alias(f"r{i}") for i in range(9)], *[F.col("translation")[i].alias(f"t{i}") for i in range(3)]), *[f"r{i}" for i in range(9)], "t0", "t1", "t2")


def visible_fraction(spark, d):
    m = sparse(spark, d, 0.05).select("recording", "frame", "y", "x")
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), (F.col("vec_id") % 50).alias("frame"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("point"))
    p = e.withColumns({"u": (F.col("point") * 5 % 8).cast("double"), "v": (F.col("point") * 3 % 8).cast("double")})
    return rounded(metrics.visible_fraction(p, m, ["recording", "frame"], 1, 0.4, 3), "visible")


def reliable_frames(spark, d):
    f = frames(spark, d).select("user_id", "frame", F.floor(F.col("frame") / 20).alias("segment"), (F.col("value") * 4).alias("area"))
    return metrics.reliable_frames(f, ["user_id", "segment"], "area", 0.5, 1.5).select("user_id", "frame", "reliable")


def occupancy(spark, d):
    return metrics.occupancy(sparse(spark, d, 0.1), ["recording", "frame"], 4)


def motion_energy(spark, d):
    return rounded(metrics.motion_energy(sparse(spark, d, -9.0).withColumn("v", F.col("v").cast("double")), ["recording"], "v"), "energy")


def motion_energy_top(spark, d):
    return rounded(metrics.motion_energy(sparse(spark, d, -9.0).withColumn("v", F.col("v").cast("double")), ["recording"], "v", top=0.05), "energy")


def background_plate(spark, d):
    p = sparse(spark, d, -9.0).select("recording", "frame", "y", "x", F.col("v").cast("double").alias("v"), (F.col("frame") % 3 > 0).alias("valid"))
    return rounded(metrics.background_plate(p, ["recording"], ["v"], "valid", 40), "v")


def cleanest_plate(spark, d):
    p = sparse(spark, d, -9.0).select("recording", "frame", "y", "x", F.col("v").cast("double").alias("r"), (F.col("v").cast("double") / 2).alias("g"), (F.col("x") / 16).alias("b"), (F.col("frame") % 3 > 0).alias("valid"))
    return rounded(metrics.cleanest_plate(p, ["recording"], "valid"), "r", "g", "b")


QUERIES = {
    f.__name__: f
    for f in (confusion_matrix, class_metrics, f1_scores, label_confusion, accuracy_report, class_accuracy, conditional_accuracy, pooled_accuracy, pooled_edit_score, class_weights, calibration_right, calibration_left,
              expected_calibration_error, brier_score, log_loss, ensemble_sweep, best_weight, seed_summary, holdout_summary, class_holdout, fold_mean, finite_summary, validity_contingency, mask_ab, mask_diff, pixel_error,
              track_confidence, policy_error, robust_location, mad_threshold, drop_worst, top_fraction_mean, group_mean_max, zbuffer_min, cluster_table, cluster_metrics, centroid_similarity, bbox_from_points, estimated_fps,
              histogram, lag_correlation, estimate_offset, fit_line, rigid_fit, visible_fraction, reliable_frames, occupancy, motion_energy, motion_energy_top, background_plate, cleanest_plate)
}

CONF = f"{FRAMES}, g AS (SELECT a.range AS target, b.range AS prediction FROM range(5) a, range(5) b), m AS (SELECT target, prediction, count(f.gt) AS n FROM g LEFT JOIN f ON gt = target AND pred = prediction GROUP BY ALL)"
CLS = f"""{CONF}, c AS (SELECT target AS class, sum(n) AS support, sum(n) FILTER (target = prediction) AS hit FROM m GROUP BY target), q AS (SELECT prediction AS class, sum(n) AS predicted FROM m GROUP BY prediction),
s AS (SELECT class, coalesce(hit / nullif(predicted, 0), 0.0) AS p, coalesce(hit / nullif(support, 0), 0.0) AS r, CAST(support AS BIGINT) AS support FROM c JOIN q USING (class)), fs AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM s)"""
BIN = lambda op: f"{PROB}, b AS (SELECT p, y, " + " + ".join(f"CAST(p {op} {k} / 10 AS INTEGER)" for k in range(1, 10)) + " AS bin FROM c), h AS (SELECT a.range AS bin, count(p) AS n, avg(p) AS confidence, avg(CAST(y AS DOUBLE)) AS accuracy FROM range(10) a LEFT JOIN b ON a.range = bin GROUP BY a.range)"
ENS = f"""{PROB}, a AS (SELECT range AS k, range / 20 AS alpha FROM range(21)), x AS (SELECT alpha, y, CASE WHEN (1 - alpha) * (1 - p) + alpha * CAST(0.3 AS DOUBLE) >= (1 - alpha) * p + alpha * CAST(0.7 AS DOUBLE) THEN 0 ELSE 1 END AS z FROM c, a),
n AS (SELECT alpha, count(*) FILTER (y = 0 AND z = 0) AS a, count(*) FILTER (y = 0 AND z = 1) AS b, count(*) FILTER (y = 1 AND z = 0) AS c, count(*) FILTER (y = 1 AND z = 1) AS d FROM x GROUP BY alpha),
w AS (SELECT alpha, (a + d) / (a + b + c + d) AS accuracy, (2 * a / (2 * a + b + c) + 2 * d / (2 * d + b + c)) / 2 AS f1_macro FROM n)"""
ROBUST = f"""{FRAMES}, g AS (SELECT user_id, value AS v FROM f WHERE value BETWEEN 1 AND 300), q AS (SELECT user_id, count(*) AS n, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 1 - 0.1) AS hi FROM g GROUP BY user_id),
k AS (SELECT g.* FROM g JOIN q USING (user_id) WHERE n >= 20 AND v BETWEEN lo AND hi), m AS (SELECT user_id, quantile_cont(v, 0.5) AS m, count(*) AS n FROM k GROUP BY user_id), c AS (SELECT k.user_id, v, m, abs(v - m) AS dd FROM k JOIN m USING (user_id) WHERE n >= 20),
e AS (SELECT user_id, quantile_cont(dd, 0.5) AS mad FROM c GROUP BY user_id), i AS (SELECT user_id, quantile_cont(v, 0.5) AS location, count(*) AS n_inlier FROM c JOIN e USING (user_id) WHERE dd <= greatest(3.5 * 1.4826 * mad, 1e-12) GROUP BY user_id)"""
SQL = {
    "confusion_matrix": f"WITH {CONF} SELECT * FROM m",
    "class_metrics": f"WITH {CLS} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM fs",
    "f1_scores": f"WITH {CLS} SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM fs",
    "label_confusion": "SELECT a.range AS target, b.range AS prediction, count(doc_id) AS n FROM range(2) a CROSS JOIN range(2) b LEFT JOIN labels ON quality = a.range AND toxic = b.range GROUP BY ALL",
    "accuracy_report": f"WITH {FRAMES} SELECT user_id, count(*) FILTER (gt >= 0) AS evaluated, count(*) FILTER (gt < 0) AS skipped, count(*) FILTER (gt >= 0 AND gt = pred) AS correct, round(count(*) FILTER (gt >= 0 AND gt = pred) / nullif(count(*) FILTER (gt >= 0), 0), 6) AS accuracy FROM f GROUP BY user_id",
    "class_accuracy": f"WITH {FRAMES} SELECT gt AS class, count(*) FILTER (gt = pred) AS correct, count(*) AS total FROM f WHERE gt >= 0 GROUP BY gt",
    "conditional_accuracy": f"WITH {FRAMES} SELECT round(count(*) FILTER (gt = 4 AND pred = 4) / count(*) FILTER (gt = 4), 6) AS transition_accuracy, round(count(*) FILTER (gt >= 0 AND gt <> 4 AND pred = gt) / count(*) FILTER (gt >= 0 AND gt <> 4), 6) AS skill_accuracy FROM f",
    "pooled_accuracy": f"WITH {FRAMES} SELECT user_id, count(*) FILTER (gt >= 0) AS evaluated, count(*) FILTER (gt >= 0 AND gt = pred) AS correct, round(count(*) FILTER (gt >= 0 AND gt = pred) / nullif(count(*) FILTER (gt >= 0), 0), 6) AS accuracy FROM f GROUP BY ROLLUP (user_id)",
    "pooled_edit_score": f"""WITH {FRAMES}, s AS (SELECT cls, pred, row_number() OVER (ORDER BY user_id, frame) AS p FROM f), a AS (SELECT pred AS x, CASE WHEN pred = lag(pred) OVER (ORDER BY p) THEN 0 ELSE 1 END AS n, p FROM s), b AS (SELECT cls AS x, CASE WHEN cls = lag(cls) OVER (ORDER BY p) THEN 0 ELSE 1 END AS n, p FROM s),
t AS (SELECT (SELECT string_agg(chr(CAST(x + 65 AS INTEGER)), '' ORDER BY p) FROM a WHERE n = 1) AS a, (SELECT string_agg(chr(CAST(x + 65 AS INTEGER)), '' ORDER BY p) FROM b WHERE n = 1) AS b)
SELECT 0 AS "all", length(a) AS runs_a, length(b) AS runs_b, round(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1)), 6) AS edit_score FROM t""",
    "class_weights": f"WITH {FRAMES}, n AS (SELECT range AS class, count(gt) AS n FROM range(6) LEFT JOIN f ON gt = range GROUP BY range) SELECT class, round(sqrt(sum(n) OVER () / (6 * greatest(n, 1))), 6) AS weight FROM n",
    "calibration_right": f"WITH {BIN('>')} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM h",
    "calibration_left": f"WITH {BIN('>=')} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM h",
    "expected_calibration_error": f"WITH {BIN('>')} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM h",
    "brier_score": f"WITH {PROB} SELECT round(avg(pow(1 - p - (1 - y), 2) + pow(p - y, 2)), 6) AS brier FROM c",
    "log_loss": f"WITH {PROB} SELECT round(avg(-ln(greatest((CASE WHEN y = 1 THEN p ELSE 1 - p END) / ((1 - p) + p), 1e-6))), 6) AS log_loss FROM c",
    "ensemble_sweep": f"WITH {ENS} SELECT round(alpha, 6) AS alpha, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM w",
    "best_weight": f"WITH {ENS} SELECT 'accuracy' AS \"by\", round((SELECT alpha FROM w ORDER BY accuracy DESC, f1_macro DESC, alpha LIMIT 1), 6) AS alpha UNION ALL SELECT 'f1_macro', round((SELECT alpha FROM w ORDER BY f1_macro DESC, accuracy DESC, alpha LIMIT 1), 6)",
    "seed_summary": f"WITH {RESULTS} SELECT variant, fold, count(*) AS n, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std, round(min(metric), 6) AS min, round(max(metric), 6) AS max FROM res GROUP BY variant, fold",
    "holdout_summary": f"WITH {RESULTS} SELECT variant, count(*) AS n, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std FROM res GROUP BY variant",
    "class_holdout": "WITH r AS (SELECT l_returnflag AS variant, l_linestatus AS class, l_linenumber, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS m, count(*) AS n FROM lineitem GROUP BY ALL) SELECT variant, class, CAST(sum(n) AS BIGINT) AS support, round(sum(m * n) / sum(n), 6) AS recall FROM r GROUP BY variant, class",
    "fold_mean": f"WITH {RESULTS} SELECT variant, seed, count(*) AS folds, round(avg(metric), 6) AS mean, CAST(sum(support) AS BIGINT) AS support FROM res GROUP BY variant, seed",
    "finite_summary": f"WITH {FRAMES}, x AS (SELECT event_type, CASE WHEN frame % 7 > 0 THEN value END AS v FROM f) SELECT event_type, count(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(min(v), 6) AS min, round(max(v), 6) AS max, round(count(v) / count(*), 6) AS finite_fraction FROM x GROUP BY event_type",
    "validity_contingency": f"WITH {FRAMES}, x AS (SELECT event_type, value > 50 AS a, frame % 3 > 0 AS b FROM f) SELECT event_type, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither, round(count(*) FILTER (a = b) / count(*), 6) AS agreement FROM x GROUP BY event_type",
    "mask_ab": "WITH m AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1)) AS na, len(list_filter(embedding, lambda x: x > 0.12)) AS nb FROM embeddings) SELECT vec_id, round(coalesce(nb / nullif(na, 0), 1.0), 6) AS iou, round(nb / nullif(na, 0), 6) AS active_iou, na = nb AS equal, na = 0 AS both_empty, round((na - nb) / 64, 6) AS flip_rate, na - nb AS count_delta FROM m",
    "mask_diff": f"WITH {PIXELS}, d AS (SELECT recording, frame, v > 0.1 AS a, v > 0.12 AND x < 7 AS b FROM px) SELECT recording, 0 AS added, count(*) FILTER (a AND NOT b) AS removed, count(DISTINCT frame) FILTER (a AND NOT b) AS changed_frames, count(*) FILTER (a AND b) AS intersection, count(*) FILTER (a AND NOT b) AS changed, count(*) FILTER (a) AS \"union\", round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) AS jaccard, count(*) FILTER (a AND NOT b) = 0 AS first_in_second, count(*) FILTER (a AND NOT b) = 0 AS equal FROM d GROUP BY recording",
    "pixel_error": "WITH x AS (SELECT l_returnflag, abs(l_quantity - l_linenumber * 7) AS r, abs(CAST(l_partkey % 50 AS DOUBLE) - l_suppkey % 50) AS g FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l_returnflag, count(*) AS pixels, sum(r + g) AS abs_sum, round(avg(CASE WHEN r + g > 0 THEN 1.0 ELSE 0.0 END), 6) AS changed_ratio, max(greatest(r, g)) AS max_abs, round(sum(r + g) / (2 * count(*)), 6) AS mean_abs FROM x GROUP BY l_returnflag",
    "track_confidence": f"WITH {FRAMES}, t AS (SELECT user_id FROM f GROUP BY user_id HAVING avg(event_id % 2) >= 0.5) SELECT 0 AS recording, frame, round(coalesce(max(least(greatest(value / 100, 0.0), 1.0)) FILTER (user_id IN (SELECT user_id FROM t)), 0.0), 6) AS confidence FROM f GROUP BY frame",
    "policy_error": "WITH e AS (SELECT vec_id // 50 AS episode, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) - CAST(embedding[i + 32] AS DOUBLE) AS d FROM (SELECT *, unnest(range(1, 33)) AS i FROM embeddings)) SELECT dim, episode, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae FROM e GROUP BY GROUPING SETS ((dim), (episode), ())",
    "robust_location": f"WITH {ROBUST} SELECT u.user_id, round(CASE WHEN n_inlier >= 20 THEN location END, 6) AS location, coalesce(q.n, 0) AS n_valid, coalesce(n_inlier, 0) AS n_inlier FROM (SELECT DISTINCT user_id FROM f) u LEFT JOIN q USING (user_id) LEFT JOIN i USING (user_id)",
    "mad_threshold": f"WITH {FRAMES}, m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM f GROUP BY event_type) SELECT event_type, round(greatest(10.0, any_value(m) + 3.5 * 1.4826 * quantile_cont(abs(value - m), 0.5)), 6) AS threshold FROM f JOIN m USING (event_type) GROUP BY event_type",
    "drop_worst": f"""WITH {FRAMES}, v AS (SELECT user_id, list(value ORDER BY value, frame DESC) AS v, list(frame ORDER BY value, frame DESC) AS t FROM f GROUP BY user_id), m AS (SELECT *, unnest(range(1, len(v) + 1)) AS m FROM v), c AS (SELECT *, list_median(v[1:m]) AS mid FROM m),
s AS (SELECT user_id, any_value(t) AS t, any_value(v) AS v, max(m) AS m FROM c WHERE m <= 8 OR v[m] <= greatest(50.0, mid + 3.5 * 1.4826 * list_median(list_transform(v[1:m], lambda x: abs(x - mid)))) GROUP BY user_id)
SELECT user_id, t[k] AS frame, v[k] AS value FROM (SELECT *, unnest(range(1, m + 1)) AS k FROM s)""",
    "top_fraction_mean": "WITH r AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, max(n) AS n, round(CASE WHEN max(n) >= 10 THEN avg(c) FILTER (k <= greatest(10, ceil(n * 0.05))) ELSE 0.0 END, 4) AS score FROM r GROUP BY l_suppkey",
    "group_mean_max": f"WITH {FRAMES} SELECT user_id, event_type, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS mean, CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS max FROM f GROUP BY user_id, event_type",
    "zbuffer_min": "SELECT vec_id // 50 AS recording, CAST(round_even(CAST(embedding[1] AS DOUBLE) * 20, 0) AS BIGINT) AS px, CAST(round_even(CAST(embedding[2] AS DOUBLE) * 20, 0) AS BIGINT) AS py, round(min(CAST(embedding[3] AS DOUBLE) + 0.3), 6) AS depth FROM embeddings WHERE CAST(embedding[3] AS DOUBLE) + 0.3 > 0 GROUP BY ALL",
    "cluster_table": f"WITH {FRAMES} SELECT least(CAST(floor(value / 25) AS BIGINT), 6) AS cluster, cls AS label, count(*) AS n FROM f GROUP BY ALL",
    "cluster_metrics": f"""WITH {FRAMES}, t AS (SELECT least(CAST(floor(value / 25) AS BIGINT), 6) AS c, cls AS l, count(*) AS n FROM f GROUP BY ALL), z AS (SELECT CAST(sum(n) AS DOUBLE) AS nn FROM t),
a AS (SELECT sum(n * (n - 1) / 2) AS s, sum(-(n / nn) * ln(n / nn)) AS h, any_value(nn) AS nn FROM t, z), cc AS (SELECT c, sum(n) AS n, max(n) AS top FROM t GROUP BY c), ll AS (SELECT l, sum(n) AS n FROM t GROUP BY l),
b AS (SELECT sum(n * (n - 1) / 2) AS cs, sum(-(n / nn) * ln(n / nn)) AS ch, sum(top) AS ctop FROM cc, z), e AS (SELECT sum(n * (n - 1) / 2) AS ls, sum(-(n / nn) * ln(n / nn)) AS lh FROM ll, z),
r AS (SELECT ctop / nn AS purity, (s - cs * ls / (nn * (nn - 1) / 2)) / ((cs + ls) / 2 - cs * ls / (nn * (nn - 1) / 2)) AS ari, 1 - (h - ch) / lh AS hom, 1 - (h - lh) / ch AS com FROM a, b, e)
SELECT round(purity, 6) AS purity, round(ari, 6) AS ari, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure FROM r""",
    "centroid_similarity": """WITH u AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i),
n AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m) SELECT a.label AS label_a, b.label AS label_b, round(sum(a.x * b.x), 6) AS cosine FROM n a JOIN n b USING (i) GROUP BY ALL""",
    "bbox_from_points": """WITH p AS (SELECT vec_id // 50 AS recording, CAST(embedding[1] AS DOUBLE) * 200 + 320 AS u, CAST(embedding[2] AS DOUBLE) * 200 + 240 AS v FROM embeddings WHERE label < 8), b AS (SELECT recording, min(u) AS a, min(v) AS b, max(u) AS c, max(v) AS d, avg(u) AS cx, avg(v) AS cy FROM p GROUP BY recording),
h AS (SELECT *, greatest(c - a, d - b) / 2 * 1.2 AS half, (a + c) / 2 AS mx, (b + d) / 2 AS my FROM b), q AS (SELECT recording, cx, cy, least(greatest(mx - half, 0), 640) AS x0, least(greatest(my - half, 0), 480) AS y0, least(greatest(mx + half, 0), 640) AS x1, least(greatest(my + half, 0), 480) AS y1 FROM h)
SELECT recording, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(cx, 6) AS cx, round(cy, 6) AS cy, round(least(x0, y0, 640 - x1, 480 - y1), 6) AS edge_distance FROM q""",
    "estimated_fps": f"WITH {FRAMES}, s AS (SELECT user_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS DOUBLE) AS d FROM f) SELECT user_id, round(quantile_cont(d, 0.5), 3) AS median_step, round(min(d), 3) AS min_step, round(max(d), 3) AS max_step, round(1.0 / quantile_cont(d, 0.5) * 1e9, 3) AS fps FROM s WHERE d IS NOT NULL GROUP BY user_id",
    "histogram": "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events) SELECT event_type, CAST(least(floor((value - a) / (b - a) * 12), 11) AS INTEGER) AS bin, count(*) AS n FROM events, q WHERE value BETWEEN a AND b GROUP BY ALL",
    "lag_correlation": """WITH s AS (SELECT event_type AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS v FROM events GROUP BY ALL), l AS (SELECT range - 5 AS lag FROM range(11))
SELECT 0 AS g, lag, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a.v, b.v) END, 6) AS correlation FROM s a, l, s b WHERE a.k = 'click' AND b.k = 'view' AND b.day = a.day + lag GROUP BY lag""",
    "estimate_offset": """WITH s AS (SELECT event_type AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS v FROM events GROUP BY ALL), l AS (SELECT range - 5 AS lag FROM range(11)),
c AS (SELECT lag, corr(a.v, b.v) AS c FROM s a, l, s b WHERE a.k = 'click' AND b.k = 'view' AND b.day = a.day + lag GROUP BY lag), w AS (SELECT *, lag(c) OVER (ORDER BY lag) AS l, lead(c) OVER (ORDER BY lag) AS r FROM c),
b AS (SELECT * FROM w ORDER BY c DESC, abs(lag), lag DESC LIMIT 1), x AS (SELECT b.*, (SELECT c FROM c WHERE lag = 0) AS z, coalesce((SELECT max(c.c) FROM c WHERE abs(c.lag - b.lag) > 1), -1.0) AS second FROM b),
y AS (SELECT *, c - second AS prom, (CASE WHEN c < 0.3 THEN 1 ELSE 0 END) AS low, (CASE WHEN c - second < 0.1 THEN 1 ELSE 0 END) AS amb FROM x)
SELECT 0 AS g, lag AS best_lag, round(c, 6) AS peak, round(lag + coalesce(CASE WHEN l - 2 * c + r < 0 THEN 0.5 * (l - r) / (l - 2 * c + r) END, 0.0), 6) AS refined_lag, round(z, 6) AS zero_lag, round(prom, 6) AS prominence,
concat_ws(',', CASE WHEN low = 1 THEN 'low_correlation' END, CASE WHEN amb = 1 THEN 'ambiguous_fail_open' END) AS reasons, low + amb = 0 AS accepted, CASE WHEN low + amb = 0 THEN lag ELSE 0 END AS "offset" FROM y""",
    "fit_line": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_returnflag",
    "visible_fraction": f"""WITH {PIXELS}, m AS (SELECT recording, frame, y, x FROM px WHERE v > 0.05), p AS (SELECT vec_id // 50 AS recording, vec_id % 50 AS frame, k AS point, k * 5 % 8 AS u, k * 3 % 8 AS w FROM (SELECT vec_id, unnest(range(1, 7)) AS k FROM embeddings)),
n AS (SELECT p.*, u + dx AS x, w + dy AS y FROM p, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS k(dx, dy)), h AS (SELECT n.recording, n.frame, point, count(m.x) / 5 >= 0.4 AS ok FROM n LEFT JOIN m ON n.recording = m.recording AND n.frame = m.frame AND n.x = m.x AND n.y = m.y GROUP BY ALL)
SELECT recording, frame, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS visible FROM h GROUP BY recording, frame""",
    "reliable_frames": f"WITH {FRAMES}, a AS (SELECT user_id, frame, frame // 20 AS s, value * 4 AS area FROM f), m AS (SELECT user_id, s, quantile_cont(area, 0.5) AS m, quantile_cont(area, 0.5) FILTER (area > 0) AS p FROM a GROUP BY user_id, s) SELECT user_id, frame, area BETWEEN 0.5 * (CASE WHEN m > 100 THEN m ELSE p END) AND 1.5 * (CASE WHEN m > 100 THEN m ELSE p END) AS reliable FROM a JOIN m USING (user_id, s)",
    "occupancy": f"WITH {PIXELS} SELECT recording, frame, y // 4 AS py, x // 4 AS px, count(*) / 16 AS occupancy FROM px WHERE v > 0.1 GROUP BY ALL",
    "motion_energy": f"WITH {PIXELS}, d AS (SELECT recording, frame, abs(CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY recording, y, x ORDER BY frame)) AS d FROM px) SELECT recording, frame, round(avg(d), 6) AS energy FROM d WHERE d IS NOT NULL GROUP BY recording, frame",
    "motion_energy_top": f"WITH {PIXELS}, d AS (SELECT recording, frame, y, x, abs(CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY recording, y, x ORDER BY frame)) AS d FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY d DESC, y, x) AS k FROM d WHERE d IS NOT NULL) SELECT recording, frame, round(avg(d), 6) AS energy FROM k WHERE k <= 4 GROUP BY recording, frame",
    "background_plate": f"WITH {PIXELS} SELECT recording, y, x, round(coalesce(quantile_cont(CAST(v AS DOUBLE), 0.5) FILTER (frame % 3 > 0), quantile_cont(CAST(v AS DOUBLE), 0.5)), 6) + 0.0 AS v, count(*) FILTER (frame % 3 > 0) AS support, count(*) FILTER (frame % 3 > 0) < 40 AS weak FROM px GROUP BY recording, y, x",
    "cleanest_plate": f"""WITH {PIXELS}, c AS (SELECT recording, frame, y, x, CAST(v AS DOUBLE) AS r, CAST(v AS DOUBLE) / 2 AS g, x / 16 AS b FROM px WHERE frame % 3 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY recording, y, x ORDER BY 0.299 * r + 0.587 * g + 0.114 * b - 1.25 * (greatest(r, g, b) - least(r, g, b)) DESC, frame) AS k FROM c) SELECT recording, y, x, round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(b, 6) AS b FROM k WHERE k = 1""",
}
QUERIES["drop_worst_all"], SQL["drop_worst_all"] = QUERIES["drop_worst"], SQL["drop_worst"]
