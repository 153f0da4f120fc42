"""Streaming twins: the events table as a file stream, run until it is used up; results come from the sink's files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators.sequence import frame_index
from timeloom.plans.scratch import scratch_dir
from timeloom.queries.base import FRAMES, TOKENS
from timeloom.queries.sequences import SQL as BATCH
from timeloom.streaming import streams


def source(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files as a stream; a single file is taken from its folder."""
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def drain(df: DataFrame) -> DataFrame:
    """All that the stream gives for the files that are there now, through a file sink in the shared folder."""
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def events(spark, d):
    return source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def numbered(spark, d):
    """Frames are numbered in batch (row numbers need the whole key), written, and read as a stream."""
    f = frame_index(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "frame", "value")
    path = f"{scratch_dir(spark)}/frames-{uuid.uuid4().hex}"
    f.write.parquet(path)
    return source(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_pairs(spark, d):
    e = events(spark, d).select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    pick = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    out = drain(streams.pair_streams(pick("click"), pick("view"), "user_id", "ts", "6 hours", "10 minutes"))
    return out.select("user_id", "left_id", "right_id")


def stream_nearest(spark, d):
    e = events(spark, d).select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    pick = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    out = drain(streams.stream_nearest_pairs(pick("click"), pick("view"), "user_id", "ts", "6 hours", "10 minutes"))
    return out.select("user_id", F.col("left_id").alias("a"), F.col("right_id").alias("b"), "reason")


def stream_hysteresis(spark, d):
    f = numbered(spark, d).withColumn("x", F.col("value") / 500)
    return drain(streams.stream_hysteresis(f, "user_id", "ts", "x", 0.15, 0.08, 2, 1, "1 hour", ["frame"], "60 days")).drop("ts")


def stream_ema(spark, d):
    out = drain(streams.stream_ema_switch(numbered(spark, d).withColumn("x", F.col("value") / 200), "user_id", "ts", "x", "1 hour", carry=["frame"], ttl="60 days"))
    return out.withColumn("ema", F.round("ema", 6)).drop("ts")


def stream_rate_limit(spark, d):
    out = drain(streams.stream_rate_limit(numbered(spark, d), "user_id", "ts", "value", 20.0, 5.0, 200.0, "1 hour", ["frame"], "60 days"))
    return out.withColumn("limited", F.round("limited", 6)).drop("ts")


def stream_windows(spark, d):
    """The token number, from 1, stands for seconds."""
    e = source(spark, f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).alias("recording"), (F.col("vec_id") % 50).alias("token_index"), F.col("embedding").alias("vec"))
    out = drain(streams.stream_trailing_window(e.withColumn("t", F.timestamp_seconds(F.col("token_index") + 1)), "recording", "t", "vec", 3, 64, "2 seconds", ["token_index"]))
    row = F.arrays_zip(*[F.slice("window", 64 * i + 1, 64).alias(n) for i, n in enumerate(("oldest", "middle", "newest"))])
    out = out.select("recording", "token_index", F.posexplode(row).alias("dim", "x"))
    return out.select("recording", "token_index", "dim", *[F.round(F.col("x")[n], 6).alias(n) for n in ("oldest", "middle", "newest")])


def stream_sessions(spark, d):
    e = events(spark, d).withColumn("on", F.col("event_type").isin("click", "purchase"))
    out = drain(streams.stream_episodes(e, "user_id", "ts", "on", "12 hours", "1 hour", 3))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def stream_stats(spark, d):
    e = events(spark, d).withColumn("valid", F.col("value") > 20)
    out = drain(streams.stream_window_stats(e, "ts", "value", "valid", "1 day", None, "1 hour"))
    return out.select(F.unix_micros("start").alias("start"), "rows", "count", F.round("mean", 6).alias("mean"), "max", F.round("valid_rate", 6).alias("valid_rate"))


def stream_dedup(spark, d):
    seen = spark.read.parquet(f"{d}/events.parquet").where("event_id < 20").select("user_id").distinct()
    return drain(streams.stream_ingest_dedup(events(spark, d).select("user_id", "ts"), "user_id", "ts", "40 days", seen)).select("user_id")


QUERIES = {f.__name__: f for f in (stream_pairs, stream_nearest, stream_hysteresis, stream_ema, stream_rate_limit, stream_windows, stream_sessions, stream_stats, stream_dedup)}
PAIR = "p AS (SELECT a.user_id, a.event_id AS left_id, a.ts AS lt, b.event_id AS right_id, b.ts AS rt FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR)"
#: What the watermark, an hour behind the last row, has passed.
PASSED = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events QUALIFY epoch_us(ts) <= (SELECT max(epoch_ms(ts)) FROM events) * 1000 - 3600000000)"
passed = lambda sql, names: f"WITH b AS ({sql}), {PASSED} SELECT {names} FROM b JOIN p USING (user_id, frame)"
#: A row that isn't active but at the threshold stays open while no row after it has passed.
OPEN = BATCH["hysteresis"].replace("SELECT user_id, frame, active OR", "SELECT user_id, frame, NOT active AND above > 0 AS waits, active OR")
SQL = {
    "stream_hysteresis": f"WITH b AS ({OPEN}), {PASSED}, j AS (SELECT *, frame = max(frame) OVER (PARTITION BY user_id) AS last FROM b JOIN p USING (user_id, frame)) SELECT user_id, frame, active FROM j WHERE NOT (waits AND last)",
    "stream_pairs": f"WITH {PAIR} SELECT user_id, left_id, right_id FROM p",
    "stream_nearest": """WITH n AS (SELECT a.user_id, a.event_id AS a, a.ts AS lt, b.event_id AS b, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id) AS k
  FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type = 'click'),
q AS (SELECT *, coalesce(gap, 1e18) > 21600000000 AS far, row_number() OVER (PARTITION BY user_id, b, coalesce(gap, 1e18) > 21600000000 ORDER BY lt, a) AS j FROM n WHERE k = 1),
w AS (SELECT least(max(epoch_ms(ts)) FILTER (event_type = 'click'), max(epoch_ms(ts)) FILTER (event_type = 'view')) * 1000 - 600000000 AS w FROM events)
SELECT user_id, a, CASE WHEN NOT far AND j = 1 THEN b END AS b, CASE WHEN far THEN 'right_delta' WHEN j > 1 THEN 'right_non_unique' END AS reason FROM q, w WHERE epoch_us(lt) + 21600000000 <= w""",
    "stream_ema": passed(BATCH["ema_dual_threshold"], "user_id, frame, ema, active"),
    "stream_rate_limit": passed(BATCH["rate_limit"], "user_id, frame, limited"),
    "stream_windows": f"WITH {TOKENS}, x AS (SELECT recording, token_index, dim, CAST(vec[dim + 1] AS DOUBLE) AS v FROM t, range(0, 64) AS r(dim)) SELECT recording, token_index, CAST(dim AS INTEGER) AS dim, round(coalesce(lag(v, 2) OVER w, 0.0), 6) AS oldest, round(coalesce(lag(v) OVER w, 0.0), 6) AS middle, round(v, 6) AS newest FROM x WINDOW w AS (PARTITION BY recording, dim ORDER BY token_index) QUALIFY token_index <= (SELECT max(token_index) FROM t) - 2",
    "stream_sessions": f"""WITH {FRAMES}, o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM f WHERE event_type IN ('click', 'purchase')), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o),
g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, epoch_us(a) AS start, epoch_us(b) AS "end", n FROM g WHERE n >= 3 AND b + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_stats": """WITH w AS (SELECT date_trunc('day', ts) AS s, count(*) AS rows, count(value) AS count, avg(value) AS mean, max(value) AS max, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS valid_rate FROM events GROUP BY 1)
SELECT epoch_us(s) AS start, rows, count, round(mean, 6) AS mean, max, round(valid_rate, 6) AS valid_rate FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_dedup": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 20)",
}
