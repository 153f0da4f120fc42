"""Streams against their batch twins: rows in any order within the delay, odd values, late rows, silent keys."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeloom.operators import joins, kernels, sequence
from timeloom.streaming import streams

NAN, INF = float("nan"), float("inf")
ODD = [None, NAN, INF, -INF]
KIND = "k string, n long, x double"


def run_stream(spark, tmp_path, batches, kind, make):
    """Every batch is a file, and a micro-batch; n becomes seconds."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.parquet(f"{src}/{i:03}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    q = make(stream.withColumn("ts", F.timestamp_seconds(F.col("n") + 1000))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def shuffled(rng, rows, size, reach):
    """Rows no more than `reach` seconds out of order, in batches, with a last one far on that lets all others out."""
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, reach))
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    return [*batches, [("end", 10_000, 0.0)], [("end", 20_000, 0.0)]]


def odd_rows(rng, n=30):
    return [(k, i, rng.choice(ODD) if rng.random() < 0.15 else round(rng.random(), 3)) for k in ("a", "b") for i in range(n)]


def same_number(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9)


def compare(got, want, names):
    mine, theirs = ({(r["k"], r["n"]): [r[n] for n in names] for r in df.where("k <> 'end'").select("k", "n", *names).collect()} for df in (got, want))
    assert mine.keys() == theirs.keys()
    assert all(same_number(x, y) for key in mine for x, y in zip(mine[key], theirs[key], strict=True))


TWINS = {
    "ema": (lambda s: streams.stream_ema_switch(s, "k", "ts", "x", "15 seconds", 0.5, 0.6, 0.4, ["n"]), lambda f: sequence.ema_dual_threshold(f, ["k"], "n", "x", 0.5, 0.6, 0.4), ["ema", "active"]),
    "rate": (lambda s: streams.stream_rate_limit(s, "k", "ts", "x", 0.1, 0.2, 0.8, "15 seconds", ["n"]), lambda f: sequence.rate_limit(f, ["k"], "n", "x", 0.1, 0.2, 0.8), ["limited"]),
    "hysteresis": (lambda s: streams.stream_hysteresis(s, "k", "ts", "x", 0.6, 0.4, 3, 2, "15 seconds", ["n"]), lambda f: sequence.hysteresis(f, ["k"], "n", "x", 0.6, 0.4, 3, 2), ["active"]),
}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_shuffled_batches_give_the_batch_twins_rows(spark, tmp_path, name):
    stream, batch, names = TWINS[name]
    rng = random.Random(len(name))
    rows = [*odd_rows(rng), ("a", 30, 0.0), ("b", 30, 0.0)]  # a low last row leaves nothing open
    got = run_stream(spark, tmp_path, shuffled(rng, rows, 25, 10), KIND, stream)
    compare(got, batch(spark.createDataFrame(rows, KIND)), names)


def test_rows_later_than_the_delay_are_dropped(spark, tmp_path):
    rows = [[("a", i, 1.0) for i in range(30)], [("a", 40, 1.0)], [("a", 3, 5.0), ("a", 41, 2.0)], [("end", 900, 0.0)], [("end", 901, 0.0)]]
    got = run_stream(spark, tmp_path, rows, KIND, lambda s: streams.stream_rate_limit(s, "k", "ts", "x", 0.5, 0.0, 9.0, "5 seconds", ["n"])).where("k = 'a'")
    assert [(r["n"], r["limited"]) for r in got.orderBy("n").collect()] == [*[(i, 1.0) for i in range(30)], (40, 1.0), (41, 1.5)]


def test_a_silent_key_starts_anew(spark, tmp_path):
    rows = [[("a", 0, 8.0), ("a", 1, 8.0)], [("b", 500, 1.0)], [("a", 501, 1.0), ("a", 502, 1.0)], [("end", 900, 0.0)], [("end", 901, 0.0)]]
    got = run_stream(spark, tmp_path, rows, KIND, lambda s: streams.stream_ema_switch(s, "k", "ts", "x", "5 seconds", 0.5, 9.0, 9.0, ["n"], ttl="60 seconds")).where("k = 'a'")
    assert [(r["n"], r["ema"]) for r in got.orderBy("n").collect()] == [(0, 4.0), (1, 6.0), (501, 0.5), (502, 0.75)]


def test_windows_leave_out_null_vectors(spark, tmp_path):
    rows = [("a", i, None if i == 2 else [float(i)]) for i in range(6)]
    batches = [[rows[3], rows[0]], [rows[1], rows[2], rows[4]], [rows[5]], [("end", 900, [0.0])], [("end", 901, [0.0])]]
    got = run_stream(spark, tmp_path, batches, "k string, n long, v array<double>", lambda s: streams.stream_trailing_window(s, "k", "ts", "v", 3, 1, "10 seconds", ["n"])).where("k = 'a'").orderBy("n")
    batch = sequence.trailing_window(spark.createDataFrame(rows, "k string, n long, v array<double>"), ["k"], "n", "v", 3, 1).orderBy("n")
    assert [r["window"] for r in got.collect()] == [[x for v in r["window"] for x in v] for r in batch.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_pairs_in_any_order_equal_the_batch_join(spark, tmp_path, seed):
    rng = random.Random(seed)
    times = rng.sample(range(250), 80)
    rows = [(rng.choice("ab"), t, float(rng.random() < 0.5)) for t in times]
    make = lambda s: streams.stream_nearest_pairs(*[s.where(f"x = {side}").select("k", F.col("n").alias("id"), "ts") for side in (0, 1)], "k", "ts", "4 seconds", "20 seconds")
    batches = shuffled(rng, rows, 30, 12)
    batches[-2:] = [[("end", 10_000 + i, float(i)) for i in (0, 1)], [("end", 20_000 + i, float(i)) for i in (0, 1)]]
    out = run_stream(spark, tmp_path, batches, KIND, make).where("k <> 'end'").collect()
    assert sorted(r["left_id"] for r in out) == sorted(t for _, t, x in rows if x == 0)  # each left row once
    df = spark.createDataFrame(rows, KIND).withColumn("t", F.col("n"))
    left, right = (df.where(f"x = {side}").select("k", "t", F.col("n").alias(name)) for side, name in ((0, "a"), (1, "b")))
    want = {(r["a"], r["b"]) for r in joins.pair_nearest(left, right, ["k"], "t", "a", "b", 4).collect()}
    assert {(r["left_id"], r["right_id"]) for r in out if r["reason"] is None} == want
    for r in out:
        gaps = [abs(t - r["left_id"]) for k, t, x in rows if x == 1 and k == r["k"]]
        assert r["reason"] in (("right_delta",) if min(gaps, default=INF) > 4 else (None, "right_non_unique"))
        assert (r["right_id"] is None) == (r["reason"] is not None)


def test_decide_takes_the_earlier_of_two_and_the_least_of_equal_times():
    rights = [(0, 9, False), (10, 4, False), (10, 5, False), (20, 1, False)]
    assert [(i, r, why) for i, _, r, _, why in streams.decide([(5, 1), (9, 2), (12, 3), (40, 4)], rights, 8)] == [(1, 9, None), (2, 4, None), (3, None, "right_non_unique"), (4, None, "right_delta")]


def nearest(s, key="k", **more):
    return streams.stream_nearest_pairs(*[s.where(f"x = {side}").select(key, F.col("n").alias("id"), "ts") for side in (0, 1)], key, "ts", "4 seconds", "5 seconds", **more)


STATEFUL = {"rate": lambda s, **more: streams.stream_rate_limit(s, "k", "ts", "x", 0.5, 0.0, 9.0, "5 seconds", ["n"], **more), "nearest": nearest}


@pytest.mark.parametrize("name", sorted(STATEFUL))
def test_state_is_held_by_slices_not_by_keys(spark, tmp_path, name):
    rows = [(f"k{i % 300}", i // 300, float(i // 300 % 2)) for i in range(1200)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(KIND).parquet(src).withColumn("ts", F.timestamp_seconds(F.col("n") + 1000))
    q = STATEFUL[name](stream, slices=4).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert 0 < max(held) <= 3 * 4  # a slice's value and its timer, by key and by time


@pytest.mark.parametrize("name", sorted(STATEFUL))
def test_keys_beyond_doubles_beside_null_in_another_time_zone(spark, tmp_path, name):
    keys, kind = [2**60, 2**60 + 1, None], "k long, n long, x double"
    batches = [[(k, n, float(n % 2)) for k in keys for n in range(b, b + 6)] for b in (0, 6)] + [[(7, 900 + i + j, float(i)) for i in (0, 1)] for j in (0, 10)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = run_stream(spark, tmp_path, batches, kind, lambda s: STATEFUL[name](s, slices=1)).where("k IS NULL OR k <> 7").collect()
        when = {"rate": "ts", "nearest": "left_time"}[name]
        times = {(r["k"], r["n" if name == "rate" else "left_id"], r[when].timestamp()) for r in got}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    step = 1 if name == "rate" else 2
    assert times == {(k, n, 1000.0 + n) for k in keys for n in range(0, 12, step)} and len(got) == len(times)
    if name == "rate":
        assert {r["limited"] for r in got if r["n"] % 2} == {0.5}
    else:
        assert {(r["k"], r["left_id"]): (r["right_id"], r["reason"]) for r in got} == {(k, n): (n - 1 if n else 1, None) if n != 2 else (None, "right_non_unique") for k in keys for n in range(0, 12, 2)}


# Kernels


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.3, 0.5, 0.9, NAN, INF]), st.booleans()), max_size=40), st.floats(0, 1), st.booleans(), st.sampled_from([(0.6, 0.2), (0.3, 0.3), (0.2, 0.6)]))
def test_ema_and_switch_equal_the_loop(rows, before, active, limits):
    on, off = limits
    x, new = np.array([v for v, _ in rows]), np.array([n for _, n in rows], bool)
    ema, state, want = before, active, []
    for v, fresh in rows:
        if fresh:
            ema, state = 0.0, False
        ema = 0.25 * (v if math.isfinite(v) else 0.0) + 0.75 * ema
        state = ema >= (off if state else on)
        want.append((ema, state))
    got = kernels.ema_switch_run(x, new, 0.25, on, off, before, active)
    assert all(abs(a - b[0]) < 1e-12 for a, b in zip(got[0].tolist(), want, strict=True))
    firm = [abs(e - on) > 1e-9 and abs(e - off) > 1e-9 for e, _ in want]
    if all(firm):
        assert got[1].tolist() == [s for _, s in want]


def test_one_hot_key_is_spread_and_equals_the_loop(spark, small_ranges):
    rng = random.Random(2)
    rows = [("hot", i, rng.random()) for i in range(6000)] + [(k, i, rng.random()) for k in ("a", None, "z") for i in range(50)]
    df = spark.createDataFrame(rows, KIND).repartition(6)
    out = sequence.ema_dual_threshold(df, ["k"], "n", "x", 0.05, 0.52, 0.48)
    got = {(r["k"], r["n"]): (r["ema"], r["active"]) for r in out.collect()}
    state = {}
    for k, i, x in rows:
        ema, active = state.get(k, (0.0, False))
        ema = 0.05 * x + 0.95 * ema
        state[k] = ema, ema >= (0.48 if active else 0.52)
        assert abs(got[k, i][0] - state[k][0]) < 1e-9 and got[k, i][1] == state[k][1]
    placed = sequence.in_ranges(df, ["k"], ["n"])
    assert placed.where("k = 'hot'").select("__part").distinct().count() > 1
