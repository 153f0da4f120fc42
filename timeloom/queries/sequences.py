"""Smoothing, gaps in values, windows of vectors, and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import metrics, sequence
from timeloom.queries.base import FRAMES, TOKENS, frames, rounded, tokens

KEY = ["user_id"]


def values(spark, d):
    """value with gaps where it is under 60."""
    return frames(spark, d).select("user_id", "frame", F.when(F.col("value") >= 60, F.col("value")).alias("value"), F.floor(F.col("frame") / 20).alias("track"))


GAPS = f"{FRAMES}, v AS (SELECT user_id, frame, CASE WHEN value >= 60 THEN value END AS value, frame // 20 AS track FROM f)"
NEAR = f"""{GAPS}, p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS pt, last_value(value IGNORE NULLS) OVER a AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS nt, first_value(value IGNORE NULLS) OVER b AS nv, count(value) OVER (PARTITION BY user_id) AS n
  FROM v WINDOW a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN pt IS NOT NULL AND nt IS NOT NULL AND nt - pt - 1 <= 2 THEN pv + (nv - pv) * (frame - pt) / (nt - pt) END AS short FROM p)"""


def moving_average(spark, d):
    return rounded(sequence.centered_moving_average(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", ["value"], 5), "value_smooth").select("user_id", "frame", "value_smooth")


def interpolate_linear(spark, d):
    return rounded(sequence.interpolate_linear(values(spark, d), KEY, "frame", "value"), "value").select("user_id", "frame", "value")


def interpolate_bounded(spark, d):
    return rounded(sequence.interpolate_bounded(values(spark, d), KEY, "frame", "value", 2, 5), "value").select("user_id", "frame", "value")


def hold_last_valid(spark, d):
    return sequence.hold_last_valid(values(spark, d), KEY, "frame", "value").select("user_id", "frame", "value")


def nearest_donor(spark, d):
    f = values(spark, d).withColumns({"valid": F.col("value").isNotNull(), "plate": F.lit(-1.0)})
    return sequence.nearest_clean_donor(f, KEY, "frame", "value", "valid", "plate").select("user_id", "frame", "donor", "donor_at")


def centered_median(spark, d):
    return rounded(sequence.centered_median(values(spark, d), KEY, "frame", "value", 4, "median"), "median").select("user_id", "frame", "median")


def same_track_median(spark, d):
    return rounded(sequence.same_track_median(values(spark, d), KEY, "frame", "value", "track", 3, "median"), "median").select("user_id", "frame", "median")


def centered_prior(spark, d):
    return rounded(sequence.centered_prior(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", 5), "prior").select("user_id", "frame", "prior")


def scale_clip(spark, d):
    return rounded(sequence.scale_clip(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", 5), "value_scaled").select("user_id", "frame", "value_scaled")


def first_difference(spark, d):
    f = sequence.first_difference(tokens(spark, d), ["recording"], "token_index", "vec")
    return rounded(f.select("recording", "token_index", F.posexplode("delta").alias("dim", "delta")), "delta")


def trailing_window(spark, d):
    w = sequence.trailing_window(tokens(spark, d), ["recording"], "token_index", "vec", 8, 64)
    pooled = sequence.window_pool(w, "window", 8).withColumn("flat", F.flatten("window"))
    return rounded(pooled.select("recording", "token_index", F.col("pooled")[0].alias("mean_0"), F.col("pooled")[63].alias("mean_63"), F.col("flat")[0].alias("oldest_0"), F.size("flat").alias("size")), "mean_0", "mean_63", "oldest_0")


def quaternion_unwrap(spark, d):
    q = tokens(spark, d).select("recording", "token_index", F.transform(F.slice("vec", 1, 4), lambda x: x.cast("double")).alias("q"))
    q = sequence.quaternion_unwrap(q, ["recording"], "token_index", "q")
    return rounded(q.select("recording", "token_index", *[F.col("q")[i].alias(f"q{i}") for i in range(4)]), "q0", "q1", "q2", "q3")


def hysteresis(spark, d):
    f = frames(spark, d).select("user_id", "frame", (F.col("value") / 500).alias("x"))
    return sequence.hysteresis(f, KEY, "frame", "x", 0.15, 0.08, 2, 1)


def ema_dual_threshold(spark, d):
    f = frames(spark, d).select("user_id", "frame", (F.col("value") / 200).alias("x"))
    return rounded(sequence.ema_dual_threshold(f, KEY, "frame", "x"), "ema")


def rate_limit(spark, d):
    return rounded(sequence.rate_limit(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", 20.0, 5.0, 200.0), "limited")


def best_epoch(spark, d):
    return sequence.best_epoch(frames(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", patience=5, min_delta=1.0, min_epochs=8)


def boundary_ambiguous(spark, d):
    return sequence.boundary_ambiguous(frames(spark, d), KEY, "frame", "gt", 1).select("user_id", "frame", "ambiguous")


def tolerant_correct(spark, d):
    return sequence.tolerant_correct(frames(spark, d), KEY, "frame", "gt", "pred", 2).select("user_id", "frame", "correct")


def tolerance_sweep(spark, d):
    return rounded(metrics.tolerance_sweep(frames(spark, d), KEY, "frame", "gt", "pred", (0, 1, 2, 4)), "tolerant_accuracy", "core_accuracy", "core_coverage")


def savgol_smooth(spark, d):
    return rounded(sequence.median_then_savgol(values(spark, d).select("user_id", "frame", "value"), KEY, "frame", "value", 7, 2, 3), "value_smooth").select("user_id", "frame", "value_smooth")


def find_episodes(spark, d):
    f = frames(spark, d).select("user_id", "frame", "value")
    return sequence.find_episodes(f, KEY, "frame", "value", sigma=2.0, distance=5, prominence=5.0)


QUERIES = {
    f.__name__: f
    for f in (moving_average, interpolate_linear, interpolate_bounded, hold_last_valid, nearest_donor, centered_median, same_track_median, centered_prior, scale_clip, first_difference, trailing_window,
              quaternion_unwrap, hysteresis, ema_dual_threshold, rate_limit, best_epoch, boundary_ambiguous, tolerant_correct, tolerance_sweep, savgol_smooth, find_episodes)
}
SWEEP = " UNION ALL ".join(
    f"SELECT {r} AS radius, user_id, frame, gt, pred, gt >= 0 AND coalesce(min(CASE WHEN gt >= 0 THEN gt END) OVER w <> max(CASE WHEN gt >= 0 THEN gt END) OVER w, false) AS amb, gt >= 0 AND list_contains(list(gt) FILTER (gt >= 0) OVER w, pred) AS ok FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    for r in (0, 1, 2, 4)
)
FITS = ", ".join(f"({n}, {i}, {j}, {float(w)!r})" for n in (5, 7) for i, row in enumerate(sequence.savgol_weights(n, 2)) for j, w in enumerate(row))
SQL = {
    "savgol_smooth": f"""WITH {NEAR}, g AS (SELECT user_id, frame, n, CASE WHEN value IS NOT NULL THEN value WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (frame - pt) / (nt - pt) ELSE coalesce(pv, nv) END AS v, count(*) OVER (PARTITION BY user_id) AS rows FROM p),
m AS (SELECT user_id, frame, rows, CASE WHEN v IS NOT NULL THEN list_sort([coalesce(lag(v) OVER w, 0), v, coalesce(lead(v) OVER w, 0)])[2] END AS v, CASE WHEN rows >= 7 THEN 7 WHEN rows >= 5 THEN 5 ELSE 1 END AS size FROM g WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
s AS (SELECT *, least(greatest(frame - size // 2, 0), rows - size) AS first FROM m), fits(size, i, j, w) AS (VALUES {FITS})
SELECT s.user_id, s.frame, round(coalesce(sum(fits.w * b.v), any_value(s.v)), 6) AS value_smooth FROM s LEFT JOIN fits ON fits.size = s.size AND fits.i = s.frame - s.first LEFT JOIN m b ON b.user_id = s.user_id AND b.frame = s.first + fits.j GROUP BY s.user_id, s.frame""",
    "moving_average": f"""WITH {FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY frame) AS fv,
  first_value(value) OVER (PARTITION BY user_id ORDER BY frame DESC) AS lv FROM f)
SELECT user_id, frame, round((sum(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - frame) * fv + greatest(0, 2 - (n - 1 - frame)) * lv) / 5, 6) AS value_smooth FROM c""",
    "interpolate_linear": f"WITH {NEAR} SELECT user_id, frame, round(CASE WHEN n < 2 THEN value WHEN value IS NOT NULL THEN value WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (frame - pt) / (nt - pt) ELSE coalesce(pv, nv) END, 6) AS value FROM p",
    "interpolate_bounded": f"WITH {NEAR}, e AS (SELECT *, CASE WHEN n < 2 THEN value ELSE short END AS s FROM l) SELECT user_id, frame, round(CASE WHEN s IS NOT NULL THEN quantile_cont(s, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS value FROM e",
    "hold_last_valid": f"WITH {NEAR} SELECT user_id, frame, coalesce(pv, 0.0) AS value FROM p",
    "nearest_donor": f"WITH {NEAR} SELECT user_id, frame, coalesce(CASE WHEN nt IS NULL OR frame - pt <= nt - frame THEN pv ELSE nv END, -1.0) AS donor, CASE WHEN nt IS NULL OR frame - pt <= nt - frame THEN pt ELSE nt END AS donor_at FROM p",
    "centered_median": f"WITH {GAPS} SELECT user_id, frame, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS median FROM v",
    "same_track_median": f"WITH {GAPS} SELECT a.user_id, a.frame, round(quantile_cont(b.value, 0.5), 6) AS median FROM v a JOIN v b ON a.user_id = b.user_id AND a.track = b.track AND b.frame BETWEEN a.frame - 3 AND a.frame + 3 GROUP BY a.user_id, a.frame",
    "centered_prior": f"WITH {FRAMES} SELECT user_id, frame, round(0.7 * quantile_cont(value, 0.5) OVER w + 0.3 * quantile_cont(value, 0.7) OVER w, 6) AS prior FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "scale_clip": f"WITH {FRAMES}, q AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS g, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM f) SELECT user_id, frame, round(least(greatest(m, 0.5 * g), 2 * g), 6) AS value_scaled FROM q",
    "first_difference": f"WITH {TOKENS}, x AS (SELECT recording, token_index, unnest(range(0, 64)) AS dim, vec FROM t) SELECT recording, token_index, CAST(dim AS INTEGER) AS dim, round(coalesce(CAST(vec[dim + 1] - lag(vec[dim + 1]) OVER (PARTITION BY recording, dim ORDER BY token_index) AS DOUBLE), 0.0), 6) + 0.0 AS delta FROM x",
    "trailing_window": f"""WITH {TOKENS} SELECT recording, token_index, round(sum(CAST(vec[1] AS DOUBLE)) OVER w / 8, 6) AS mean_0, round(sum(CAST(vec[64] AS DOUBLE)) OVER w / 8, 6) AS mean_63,
  round(CASE WHEN count(*) OVER w < 8 THEN 0.0 ELSE CAST(first_value(vec[1]) OVER w AS DOUBLE) END, 6) AS oldest_0, 512 AS size FROM t WINDOW w AS (PARTITION BY recording ORDER BY token_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "quaternion_unwrap": f"""WITH {TOKENS}, q AS (SELECT recording, token_index, list_transform(vec[1:4], lambda x: CAST(x AS DOUBLE)) AS q FROM t),
d AS (SELECT *, coalesce(list_dot_product(q, lag(q) OVER (PARTITION BY recording ORDER BY token_index)), 0.0) AS dot FROM q),
p AS (SELECT *, sum(CASE WHEN dot = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY token_index) AS part FROM d),
s AS (SELECT *, CASE WHEN sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, part ORDER BY token_index) % 2 = 1 THEN -1.0 ELSE 1.0 END AS sign, sqrt(list_dot_product(q, q)) AS size FROM p)
SELECT recording, token_index, round(sign * q[1] / size, 6) + 0.0 AS q0, round(sign * q[2] / size, 6) + 0.0 AS q1, round(sign * q[3] / size, 6) + 0.0 AS q2, round(sign * q[4] / size, 6) + 0.0 AS q3 FROM s""",
    "hysteresis": f"""WITH RECURSIVE {FRAMES}, h AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS frame, false AS active, 0 AS above, 0 AS below, false AS begins FROM f GROUP BY user_id
  UNION ALL SELECT n.user_id, n.frame, begins OR stays, CASE WHEN begins OR stays THEN 0 ELSE a END, CASE WHEN begins THEN 0 ELSE b END, begins FROM (
    SELECT m.*, NOT active AND a >= 2 AS begins, active AND b <= 1 AS stays FROM (
      SELECT f.user_id, f.frame, h.active, CASE WHEN f.value / 500 >= 0.15 THEN h.above + 1 ELSE 0 END AS a, CASE WHEN f.value / 500 < 0.08 THEN h.below + 1 ELSE 0 END AS b FROM h JOIN f ON f.user_id = h.user_id AND f.frame = h.frame + 1) m) n)
SELECT user_id, frame, active OR coalesce(lead(begins) OVER (PARTITION BY user_id ORDER BY frame), false) AS active FROM h WHERE frame >= 0""",
    "ema_dual_threshold": f"""WITH RECURSIVE {FRAMES}, h AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS frame, CAST(0.0 AS DOUBLE) AS ema, false AS active FROM f GROUP BY user_id
  UNION ALL SELECT user_id, frame, e, e >= CASE WHEN active THEN 0.28 ELSE 0.40 END FROM (SELECT f.user_id, f.frame, h.active, CAST(0.65 AS DOUBLE) * (f.value / 200) + CAST(0.35 AS DOUBLE) * h.ema AS e FROM h JOIN f ON f.user_id = h.user_id AND f.frame = h.frame + 1) m)
SELECT user_id, frame, round(ema, 6) AS ema, active FROM h WHERE frame >= 0""",
    "rate_limit": f"""WITH RECURSIVE {FRAMES}, h AS (
  SELECT user_id, frame, value AS x FROM f WHERE frame = 0
  UNION ALL SELECT f.user_id, f.frame, least(greatest(least(greatest(f.value, h.x - 20.0), h.x + 20.0), 5.0), 200.0) FROM h JOIN f ON f.user_id = h.user_id AND f.frame = h.frame + 1)
SELECT user_id, frame, round(x, 6) AS limited FROM h""",
    "best_epoch": f"""WITH {FRAMES}, b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
s AS (SELECT *, frame - max(CASE WHEN before IS NULL OR value > before + 1 THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS since FROM b)
SELECT user_id, arg_min(frame, struct_pack(v := -value, f := frame)) AS best_epoch, max(value) AS best_score, min(frame) FILTER (since >= 5 AND frame >= 8) AS stop_epoch FROM s GROUP BY user_id""",
    "boundary_ambiguous": f"WITH {FRAMES} SELECT user_id, frame, gt >= 0 AND coalesce(min(CASE WHEN gt >= 0 THEN gt END) OVER w <> max(CASE WHEN gt >= 0 THEN gt END) OVER w, false) AS ambiguous FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "tolerant_correct": f"WITH {FRAMES} SELECT user_id, frame, gt >= 0 AND list_contains(list(gt) FILTER (gt >= 0) OVER w, pred) AS correct FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "tolerance_sweep": f"""WITH {FRAMES}, s AS ({SWEEP}), g AS (SELECT radius, count(*) FILTER (gt >= 0) AS labelled, count(*) FILTER (ok) AS tolerant_correct, count(*) FILTER (amb) AS ambiguous, count(*) FILTER (gt >= 0 AND NOT amb AND gt = pred) AS core_correct FROM s GROUP BY radius)
SELECT *, round(tolerant_correct / labelled, 6) AS tolerant_accuracy, round(core_correct / nullif(labelled - ambiguous, 0), 6) AS core_accuracy, round((labelled - ambiguous) / labelled, 6) AS core_coverage FROM g""",
}
