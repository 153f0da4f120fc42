"""Runs and gaps of events per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.functions.scalars import frames_to_ranges
from timeloom.operators import metrics, sequence
from timeloom.queries.base import FRAMES, frames, table

KEY = ["user_id"]


def flagged(spark, d):
    return frames(spark, d).withColumn("on", F.col("event_type").isin("click", "purchase")).select("user_id", "frame", "on")


ON = f"{FRAMES}, o AS (SELECT user_id, frame, event_type IN ('click', 'purchase') AS on_ FROM f)"
RUNS = f"{ON}, k AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM o WHERE on_), r AS (SELECT user_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length FROM k GROUP BY user_id, g)"
MERGED = f"""{RUNS}, m AS (SELECT *, CASE WHEN start_frame - lag(end_frame) OVER (PARTITION BY user_id ORDER BY start_frame) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_frame) AS i FROM m)"""


def segments_rle(spark, d):
    return sequence.run_length_segments(frames(spark, d), KEY, "frame", "event_type")


def label_frame_counts(spark, d):
    return metrics.label_frame_counts(segments_rle(spark, d))


def label_sets(spark, d):
    return metrics.label_sets(segments_rle(spark, d), KEY).select("user_id", F.array_join("labels", ",").alias("labels"))


def true_runs(spark, d):
    return sequence.true_runs(flagged(spark, d), KEY, "frame", "on")


def merge_runs(spark, d):
    return sequence.merge_runs(true_runs(spark, d), KEY, bridge=2, min_frames=4)


def suppress_short_runs(spark, d):
    return sequence.suppress_short_runs(flagged(spark, d), KEY, "frame", "on", 2).withColumnRenamed("on", "kept")


def fill_short_gaps(spark, d):
    return sequence.fill_short_gaps(flagged(spark, d), KEY, "frame", "on", 2).withColumnRenamed("on", "filled")


def run_stats(spark, d):
    return metrics.run_stats(true_runs(spark, d), KEY)


def dialog_segments(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return sequence.run_length_segments(rows, ["conv_id"], "turn", "role", half_open=True)


def expand_bad_runs(spark, d):
    f = frames(spark, d).select("user_id", "frame", (F.col("value") < 5).alias("bad"), (F.col("value") / 100).alias("ratio"), F.floor(F.col("frame") / 20).alias("track"))
    return sequence.expand_bad_runs(f, KEY, "frame", "bad", "ratio", 0.4, "track").select("user_id", "frame", "bad")


def frame_ranges(spark, d):
    f = flagged(spark, d).where("on").groupBy("user_id").agg(F.collect_list("frame").alias("x"))
    return f.select("user_id", frames_to_ranges(F.col("x")).alias("ranges"))


def temporal_majority(spark, d):
    return sequence.temporal_majority(flagged(spark, d), KEY, "frame", "on", 2).withColumnRenamed("on", "majority")


QUERIES = {f.__name__: f for f in (segments_rle, label_frame_counts, label_sets, true_runs, merge_runs, suppress_short_runs, fill_short_gaps, run_stats, dialog_segments, expand_bad_runs, frame_ranges, temporal_majority)}
RLE = f"""{FRAMES}, n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) - 1 AS run FROM n),
s AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(frame) AS start_frame, max(frame) AS end_frame, any_value(event_type) AS label, count(*) AS length FROM r GROUP BY user_id, run)"""
SQL = {
    "segments_rle": f"WITH {RLE} SELECT * FROM s",
    "label_frame_counts": f"WITH {RLE} SELECT label, CAST(sum(length) AS BIGINT) AS frames, count(*) AS segments FROM s GROUP BY label",
    "label_sets": f"WITH {RLE} SELECT user_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s GROUP BY user_id",
    "true_runs": f"WITH {RUNS} SELECT * FROM r",
    "merge_runs": f"WITH {MERGED} SELECT user_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, max(end_frame) - min(start_frame) + 1 AS length FROM g GROUP BY user_id, i HAVING max(end_frame) - min(start_frame) + 1 >= 4",
    "suppress_short_runs": f"WITH {RUNS} SELECT o.user_id, o.frame, o.on_ AND r.length >= 2 AS kept FROM o LEFT JOIN r ON o.user_id = r.user_id AND o.frame BETWEEN r.start_frame AND r.end_frame",
    "fill_short_gaps": f"""WITH {ON}, p AS (SELECT *, max(CASE WHEN on_ THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS a, min(CASE WHEN on_ THEN frame END) OVER (PARTITION BY user_id ORDER BY frame DESC) AS b FROM o)
SELECT user_id, frame, on_ OR coalesce(b - a - 1 <= 2, false) AS filled FROM p""",
    "run_stats": f"WITH {RUNS} SELECT user_id, CAST(sum(length) AS BIGINT) AS frames, count(*) AS run_count, quantile_cont(length, 0.5) AS median_run, max(length) AS max_run, count(*) FILTER (length = 1) AS single_frame_runs FROM r GROUP BY user_id",
    "dialog_segments": """WITH n AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM n)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS start_frame, max(turn) + 1 AS end_frame, any_value(role) AS label, count(*) AS length FROM r GROUP BY conv_id, run""",
    "expand_bad_runs": f"""WITH {FRAMES}, b AS (SELECT user_id, frame, value < 5 AS bad, value / 100 < 0.4 OR value < 5 AS low, frame // 20 AS track FROM f),
n AS (SELECT *, CASE WHEN low AND lag(low) OVER w AND track = lag(track) OVER w THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM n)
SELECT user_id, frame, low AND bool_or(bad) OVER (PARTITION BY user_id, run) AS bad FROM i""",
    "frame_ranges": f"""WITH {RUNS}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT user_id, string_agg(CASE WHEN start_frame = end_frame THEN CAST(start_frame AS VARCHAR) ELSE start_frame || '-' || end_frame END, ', ' ORDER BY start_frame) FILTER (i <= 10) || CASE WHEN any_value(n) > 10 THEN ', ... (+' || (any_value(n) - 10) || ' more)' ELSE '' END AS ranges FROM c GROUP BY user_id""",
    "temporal_majority": f"WITH {ON} SELECT user_id, frame, 2 * count(*) FILTER (on_) OVER w > count(*) OVER w AS majority FROM o WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
}
