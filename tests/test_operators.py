"""Hand-made cases of the operators: exact expectations, faults that must be found, and twins that must agree."""

import math
import random

import pytest
from pyspark.sql import functions as F

from timeloom.functions import scalars as S
from timeloom.operators import filters, graph, joins, metrics, ml, rules, sampling, sequence


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def track(spark, values, name="x", kind="double"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"k string, t long, {name} {kind}")


def test_hysteresis_backfills_holds_and_rejects_spikes(spark):
    f = track(spark, [0.0, 0.9, 0.1, 0.8, 0.9, 0.2, 0.9, 0.1, 0.1, 0.1, float("nan"), None, 0.9])
    got = [r[1] for r in rows(sequence.hysteresis(f, ["k"], "t", "x", 0.5, 0.3, 2, 1), "t", "active")]
    assert got == [False, False, False, True, True, True, True, True, False, False, False, False, False]


def test_short_runs_go_and_short_gaps_fill(spark):
    flags = [True, False, True, True, True, False, False, False, True]
    f = track(spark, flags, "on", "boolean")
    assert [r[1] for r in rows(sequence.suppress_short_runs(f, ["k"], "t", "on", 2), "t", "on")] == [False, False, True, True, True, False, False, False, False]
    assert [r[1] for r in rows(sequence.fill_short_gaps(f, ["k"], "t", "on", 1), "t", "on")] == [True, True, True, True, True, False, False, False, True]


def test_bounded_interpolation_leaves_long_gaps_and_edges(spark):
    f = track(spark, [None, 1.0, None, 3.0, None, None, None, 7.0, None])
    got = [r[1] for r in rows(sequence.interpolate_bounded(f, ["k"], "t", "x", 2, 1), "t", "x")]
    assert got == [None, 1.0, 2.0, 3.0, None, None, None, 7.0, None]
    full = [r[1] for r in rows(sequence.interpolate_linear(f, ["k"], "t", "x"), "t", "x")]
    assert full == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 7.0]


def test_rate_limit_keeps_both_bounds(spark):
    out = [r[1] for r in rows(sequence.rate_limit(track(spark, [0.0, 10.0, 10.0, -10.0]), ["k"], "t", "x", 3.0, -1.0, 5.0), "t", "limited")]
    assert out == [0.0, 3.0, 5.0, 2.0]


def test_segments_to_frames_and_back(spark):
    f = track(spark, ["a", "a", "b", None, None, "a"], "label", "string")
    seg = sequence.run_length_segments(f, ["k"], "t", "label")
    assert rows(seg.na.fill("-"), "run", "start_frame", "end_frame", "label") == [(0, 0, 1, "a"), (1, 2, 2, "b"), (2, 3, 4, "-"), (3, 5, 5, "a")]
    back = joins.interval_labels(f.select("k", "t"), seg, ["k"], "t", "start_frame", "end_frame", "label")
    assert [r["label"] for r in back.orderBy("t").collect()] == ["a", "a", "b", None, None, "a"]


def test_tolerance_edit_and_ambiguity(spark):
    f = spark.createDataFrame([("r", i, g, p) for i, (g, p) in enumerate(zip([3, 3, 3, 8, 8, 8], [3, 8, 8, 3, 8, 5], strict=True))], "k string, t long, gt int, pred int")
    assert [r[1] for r in rows(sequence.tolerant_correct(f, ["k"], "t", "gt", "pred", 0), "t", "correct")] == [True, False, False, False, True, False]
    assert [r[1] for r in rows(sequence.tolerant_correct(f, ["k"], "t", "gt", "pred", 1), "t", "correct")] == [True, False, True, True, True, False]
    assert [r[1] for r in rows(sequence.boundary_ambiguous(f, ["k"], "t", "gt", 1), "t", "ambiguous")] == [False, False, True, True, False, False]
    e = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(zip([7, 4, 4, 7, 7, 9, 9], [7, 7, 4, 9, 9, 9, 2], strict=True))], "k string, t long, a int, b int")
    assert metrics.edit_score(e, ["k"], "t", "a", "b").first()["edit_score"] == 50  # 7 4 7 9 and 7 4 9 2
    s = spark.createDataFrame([("r", i, g, p) for i, (g, p) in enumerate(zip([5, 5, 6, 6, 6, 6, 5, 5], [5, 6, 6, 6, 5, 6, 5, 6], strict=True))], "k string, t long, gt int, pred int")
    assert metrics.tolerance_sweep(s, ["k"], "t", "gt", "pred", (0,)).first()["tolerant_accuracy"] == 0.625


def test_segment_f1_claims_each_truth_once(spark):
    t = spark.createDataFrame([("r", 0, 10, 1)], "k string, start_frame long, end_frame long, label int")
    p = spark.createDataFrame([("r", 0, 5, 1), ("r", 5, 10, 1), ("r", 10, 12, 2)], "k string, start_frame long, end_frame long, label int")
    m = joins.segment_matches(p, t, ["k"], 0.5)
    assert rows(m, "start_frame", "iou", "hit") == [(0, 0.5, True), (5, 0.5, False), (10, 0.0, False)]
    r = metrics.segment_f1(m, t, ["k"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 2, 0, 50.0)


def greedy_pairs(left, right, most):
    out, last = [], -1
    for t in left:
        k = min(range(len(right)), key=lambda i: (abs(right[i] - t), right[i]))
        if abs(right[k] - t) <= most and k > last:
            out.append((t, right[k]))
            last = k
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nearest_pairs_equal_the_greedy_scan(spark, seed):
    import random

    rng = random.Random(seed)
    left, right = sorted(rng.sample(range(60), 14)), sorted(rng.sample(range(60), 11))
    a = spark.createDataFrame([("r", t, t) for t in left], "k string, t long, a long")
    b = spark.createDataFrame([("r", t, t) for t in right], "k string, t long, b long")
    assert rows(joins.pair_nearest(a, b, ["k"], "t", "a", "b", 4), "a", "b") == greedy_pairs(left, right, 4)
    _, bad = joins.pair_nearest_strict(a, b, ["k"], "t", "a", "b", 4)
    assert {r["a"] for r in bad.collect()} == set(left) - {x for x, _ in greedy_pairs(left, right, 4)}


def four_way(spark, times, d1, d2, most):
    pairs = spark.createDataFrame([("r", i, t, t) for i, t in enumerate(times)], "k string, output_index long, t1 double, t2 double")

    def side(d):
        q = pairs.select("k", "output_index", F.col("t1").alias("t"))
        s = spark.createDataFrame([("r", i, t) for i, t in enumerate(d)], "k string, depth_id long, t double")
        return joins.nearest_candidates(q, s, ["k"], "t", "output_index", "depth_id").withColumnRenamed("right_time", "depth_time")

    return joins.pair_four_way(pairs, side(d1), side(d2), ["k"], most).orderBy("output_index").collect()


def test_four_way_pairs_reject_with_reasons(spark):
    got = four_way(spark, [10.0, 20.0, 30.0, 40.0], [11.0, 19.0, 30.5, 41.0], [10.0, 23.5, 29.5, 55.0], 2.0)
    assert [(r["accepted"], r["reasons"]) for r in got] == [(True, []), (False, ["camera_2_depth_delta"]), (True, []), (False, ["camera_2_depth_delta"])]
    got = four_way(spark, [1.0, 2.0, 3.0, 7.0], [1.5, 7.5], [1.0, 2.2, 3.1, 7.0], 2.0)
    assert [r["reasons"] for r in got] == [[], ["camera_1_depth_non_unique"], ["camera_1_depth_non_unique"], []]


def test_four_way_fold_equals_a_loop_on_events(spark):
    from timeloom.queries.joining import asof_four_way

    last: dict = {}
    for r in asof_four_way(spark, "/root/testdata/sf0.001").orderBy("user_id", "output_index").collect():
        a, b = last.get(r["user_id"], (-1, -1))
        again = {x for x, d, m in (("camera_1_depth_non_unique", r["depth_1"], a), ("camera_2_depth_non_unique", r["depth_2"], b)) if d is not None and d <= m}
        said = set(filter(None, r["reasons"].split(",")))
        far = {x for x in said if x.endswith("delta")}
        assert said - far == {x for x in again if x.replace("non_unique", "delta") not in far}
        if r["accepted"]:
            last[r["user_id"]] = (r["depth_1"], r["depth_2"])


def test_token_sampling_keeps_the_tail(spark):
    r = spark.createDataFrame([("a", 500, 30.0), ("b", 1, 30.0)], "k string, num_frames int, fps double")
    t = filters.sample_tokens(r, ["k"], 4.0)
    assert {x["k"]: x["n"] for x in t.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 34, "b": 1}
    assert t.where("k = 'b'").first()["frames"] == [0, 0]
    assert filters.sample_tokens(r, ["k"], 4.0, pad=False).where("k = 'b'").count() == 0


def test_frame_expansion(spark):
    m = spark.createDataFrame([("r", i, t) for i, t in enumerate([0, 1, 1, 1, 1, 2, 3, 3])], "k string, frame long, token_index long")
    p = spark.createDataFrame([("r", i, c) for i, c in enumerate([9, 6, 9, 3])], "k string, token_index long, cls int")
    assert [r[1] for r in rows(joins.expand_tokens(p, m, ["k"]), "frame", "cls")] == [9, 6, 6, 6, 6, 9, 3, 3]


def test_offset_join_fills_the_ends(spark):
    f = track(spark, [1.0, 2.0, 3.0])
    for off, want in ((-1, [0.0, 1.0, 2.0]), (1, [2.0, 3.0, 0.0])):
        o = spark.createDataFrame([("a", off)], "k string, offset int")
        assert [r[1] for r in rows(joins.offset_join(f.select("k", "t"), f, o, ["k"], "t", "x", "y", fill=0.0), "t", "y")] == want


def test_a_turn_and_the_turn_back_around_it_are_one_rotation(spark):
    """Around (0.6, 0.8, 0) by w, and around the opposite axis by 2 pi - w: the first two columns of Rodrigues' matrix."""
    w = 2.5
    s, c = math.sin(w), math.cos(w)
    want = [c + 0.36 * (1 - c), 0.48 * (1 - c), -0.8 * s, 0.48 * (1 - c), c + 0.64 * (1 - c), 0.6 * s]
    turns = [(0.6 * w, 0.8 * w, 0.0), (-0.6 * (2 * math.pi - w), -0.8 * (2 * math.pi - w), 0.0)]
    df = spark.createDataFrame(turns, "x double, y double, z double")
    for r in df.select(S.axis_angle_to_rot6d(F.col("x"), F.col("y"), F.col("z"), F.lit(True)).alias("m")).collect():
        assert all(abs(p - q) < 1e-9 for p, q in zip(sorted(r["m"]), sorted(want), strict=True))


def test_robust_location_by_hand(spark):
    """Of 1 to 11 the quantiles at a tenth are 2 and 10; the middle of what is left is 6, MAD 2, and nothing lies beyond 3.5 * 1.4826 * 2. 90 is out of range."""
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 12)] + [("g", 90.0), ("g", None), ("few", 3.0), ("few", 4.0)], "k string, v double")
    got = {r["k"]: (r["location"], r["n_valid"], r["n_inlier"]) for r in metrics.robust_location(df, ["k"], "v", 0.0, 50.0, 4).collect()}
    assert got == {"g": (6.0, 11, 9), "few": (None, 2, 0)}


def test_fused_scores(spark):
    df = spark.createDataFrame([(0.2, float("nan")), (None, None), (1.4, 0.1)], "a double, b double")
    assert [r[0] for r in df.select(S.fuse_max(F.col("a"), F.col("b"))).collect()] == [0.2, 0.0, 1.0]
    votes = spark.createDataFrame([(True, None, True), (True, None, False), (None, None, True)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in votes.select(S.vote_2of3(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False]


def test_boxes(spark):
    d = spark.createDataFrame([(1, "cup", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "mug", 0.8, 0.0, 0.0, 10.0, 9.9), (1, "cup", 0.7, 0.0, 0.0, 10.0, 10.0), (1, "pan", 0.5, 50.0, 0.0, 60.0, 9.0)], "f int, name string, score double, x0 double, y0 double, x1 double, y1 double")
    assert rows(joins.suppress_duplicate_boxes(d, ["f"]), "name", "score") == [("cup", 0.7), ("cup", 0.9), ("pan", 0.5)]
    p = spark.createDataFrame([("a red milk carton",), ("Milk",), ("xyz",), ("",)], "phrase string")
    dim = spark.createDataFrame([("milk", "milk"), ("carton", "red milk carton")], "name string, prompt string")
    assert {r["phrase"]: r["name"] for r in joins.match_names(p, dim).collect()} == {"a red milk carton": "carton", "Milk": "milk", "xyz": None, "": None}


def test_small_components_go(spark):
    line = lambda f, n: [(f, i, i + 1) for i in range(n - 1)]
    edges = spark.createDataFrame(line(0, 19) + line(1, 20), "f int, a long, b long")
    flags = spark.createDataFrame([(0, i) for i in range(19)] + [(1, i) for i in range(20)], "f int, node long")
    assert {r["f"] for r in graph.small_component_filter(flags, edges, ["f"], 20).collect()} == {1}


def test_offset_estimate_fails_open(spark):
    wave = [math.sin(i / 2) + math.sin(i * i) for i in range(40)]
    a = spark.createDataFrame([("r", i, wave[i]) for i in range(40)], "k string, t long, v double")
    b = spark.createDataFrame([("r", i, wave[i - 2] if i > 1 else 0.0) for i in range(40)], "k string, t long, v double")
    flat = spark.createDataFrame([("r", i, 0.0) for i in range(40)], "k string, t long, v double")
    good = metrics.estimate_offset(metrics.lag_correlation(a, b, ["k"], "t", "v", 5), ["k"], 0.3, 0.1).first()
    assert good["accepted"] and good["offset"] == 2
    lags = metrics.lag_correlation(a, flat, ["k"], "t", "v", 5)
    assert lags.where("correlation is not null").count() == 0


def test_rules_find_planted_faults_only(spark):
    rec = spark.createDataFrame([("r", 10), ("s", 4)], "k string, num_frames int")
    dim = filters.vocabulary(["a", "b"], spark)
    clean = spark.createDataFrame([("r", 0, 4, "a"), ("r", 5, 9, "b"), ("s", 0, 3, "a")], "k string, start_frame long, end_frame long, label string")
    assert rules.check_segments(clean, rec, dim, ["k"]).count() == 0 and rules.check_coverage(clean, rec, ["k"]).count() == 0
    dirty = spark.createDataFrame([("r", 0, 4, "a"), ("r", 4, 12, "c")], "k string, start_frame long, end_frame long, label string")
    assert {r["reason"] for r in rules.check_segments(dirty, rec, dim, ["k"]).collect()} == {"overlap", "unknown_label", "end_beyond_recording"}
    assert {(r["k"], r["from_frame"], r["to_frame"], r["reason"]) for r in rules.check_coverage(dirty, rec, ["k"]).collect()} == {("r", 4, 4, "duplicate"), ("s", 0, 3, "missing")}
    with pytest.raises(rules.RuleViolation, match="unknown_label"):
        rules.enforce(rules.check_segments(dirty, rec, dim, ["k"]).where("reason = 'unknown_label'"), "segments")
    with pytest.raises(ValueError):
        filters.vocabulary(["a", "a"], spark)


def test_allocation_is_whole_and_fair(spark):
    def take(counts, most, least=1):
        df = spark.createDataFrame(list(counts.items()), "k string, n long")
        return {r["k"]: r["take"] for r in sampling.stratified_allocation(df, "k", most, least).collect()}

    def by_hand(counts, most, least):
        own = {k: min(least, n) for k, n in counts.items()}
        rest, room = max(0, most - sum(own.values())), {k: n - own[k] for k, n in counts.items()}
        total = sum(room.values())
        if total <= rest:
            return counts
        out = {k: own[k] + rest * room[k] // total for k in counts}
        short = most - sum(out.values())
        for k in sorted((k for k in counts if rest * room[k] % total), key=lambda k: (-(rest * room[k] % total), k))[: max(0, short)]:
            out[k] += 1
        return out

    got = take({"a": 100, "b": 10, "c": 1}, 20)
    assert sum(got.values()) == 20 and got["c"] == 1 and got["a"] > got["b"]
    assert take({"a": 2, "b": 3}, 50) == {"a": 2, "b": 3}
    many = {f"s{i:02}": 1 + i * i % 37 for i in range(40)}
    assert take(many, 133, 2) == by_hand(many, 133, 2)
    assert take(many, 10, 2) == by_hand(many, 10, 2)  # `least` of each is more than there is room for
    out = sampling.stratified_cap(spark.createDataFrame([(k, i) for k, n in (("a", 9), (None, 4)) for i in range(n)], "k string, i int"), "k", "i", 6)
    assert sorted((str(r["k"]), r["i"]) for r in out.collect()) == [("None", 0), ("None", 3), ("a", 0), ("a", 3), ("a", 6), ("a", 8)]


def test_results_dont_depend_on_partitions(spark):
    from timeloom.queries.base import frames

    f = frames(spark, "/root/testdata/sf0.001").select("user_id", "frame", "value")
    one = sequence.ema_dual_threshold(f.repartition(1), ["user_id"], "frame", "value", on=90.0, off=50.0)
    many = sequence.ema_dual_threshold(f.repartition(13, "frame"), ["user_id"], "frame", "value", on=90.0, off=50.0)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_masked_pool_gate(spark):
    p = spark.createDataFrame([("r", i, [float(i), 1.0]) for i in range(3)], "k string, patch long, vec array<double>")
    m = spark.createDataFrame([("r", "cup", i, float(i == 2)) for i in range(3)] + [("r", "pan", i, 0.0) for i in range(3)], "k string, object string, patch long, occupancy double")
    got = {r["object"]: r["pooled"] for r in ml.masked_pool(p, m, ["k"], "vec").collect()}
    assert got == {"cup": [2.0, 1.0], "pan": [0.0, 0.0]}
    gate = spark.createDataFrame([("r", "cup", False), ("r", "pan", True)], "k string, object string, present boolean")
    assert {r["object"]: r["pooled"] for r in ml.masked_pool(p, m, ["k"], "vec", gate).collect()}["cup"] == [0.0, 0.0]


def test_worst_views_are_dropped_one_by_one(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 1.1, 0.9, 1.0, 50.0, 9.0])] + [("d", i, 1.0) for i in range(3)], "k string, view int, err double")
    assert sorted(r["view"] for r in metrics.drop_worst(df, ["k"], "view", "err", 2.0, 3).where("k = 'c'").collect()) == [0, 1, 2, 3]


def test_savgol_keeps_a_parabola(spark):
    f = track(spark, [float(i * i) for i in range(15)])
    got = [r[1] for r in rows(sequence.median_then_savgol(f, ["k"], "t", "x", 7, 2), "t", "x_smooth")]
    assert all(abs(a - i * i) < 1e-6 for i, a in enumerate(got))
    short = sequence.median_then_savgol(track(spark, [3.0, 5.0]), ["k"], "t", "x", 7, 2)
    assert [r[1] for r in rows(short, "t", "x_smooth")] == [3.0, 5.0]


def test_episodes_have_their_peaks(spark):
    bump = lambda i, c: math.exp(-((i - c) ** 2) / 20)
    f = track(spark, [bump(i, 20) + bump(i, 60) for i in range(80)])
    got = rows(sequence.find_episodes(f, ["k"], "t", "x", 2.0, 5, 0.3), "episode", "start_frame", "end_frame", "peak")
    assert got == [(0, 0, 40, 20), (1, 41, 79, 60)]


def test_exact_silhouette_over_blocks_and_over_all_rows(spark):
    import numpy as np
    from timeloom import queries

    def brute(x, c):
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        total = 0.0
        for i in range(len(x)):
            mean = {k: d[i, (c == k) & (np.arange(len(x)) != i)].mean() for k in set(c.tolist()) if ((c == k) & (np.arange(len(x)) != i)).any()}
            a, b = mean.pop(int(c[i]), None), min(mean.values())
            total += (b - a) / max(a, b) if a is not None and max(a, b) else 0.0
        return total / len(x)

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(90, 3)) + 100, np.append(rng.integers(0, 4, 89), 9)
    x[:20] = x[0]
    df = spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), c, strict=True))], "id long, v array<double>, c int")
    assert abs(ml.exact_silhouette(df, "id", "v", "c", block_rows=17).first()[0] - brute(x, c)) < 1e-9
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    assert len(rows) > 300
    want = brute(np.array(rows["embedding"].tolist(), float), rows["label"].to_numpy())
    assert abs(queries.queries()["exact_silhouette_all"](spark, "/root/testdata/sf0.001").first()[0] - want) < 1e-5


def test_drop_worst_of_a_long_key_and_whole_recordings(spark):
    import random
    from statistics import median

    from timeloom import queries

    def kept(rows, floor, least):
        rows = sorted(rows, key=lambda r: (r[1], -r[0]))
        while len(rows) > least:
            m = median(v for _, v in rows)
            if rows[-1][1] <= max(floor, m + 3.5 * 1.4826 * median(abs(v - m) for _, v in rows)):
                break
            rows.pop()
        return set(rows)

    rng = random.Random(2)
    rows = {k: [(i, float(round(rng.lognormvariate(0, 2), 1))) for i in range(n)] for k, n in enumerate((1, 2, 7, 8, 40, 900, 901))}
    df = spark.createDataFrame([(k, i, v) for k, r in rows.items() for i, v in r], "k int, v int, item double")
    for floor, least in ((0.1, 3), (1.0, 8)):
        got = {(r.k, r.v, r.item) for r in metrics.drop_worst(df, ["k"], "v", "item", floor, least).collect()}
        assert got == {(k, *x) for k, r in rows.items() for x in kept(r, floor, least)} and len(got) < 1800
    from timeloom.queries.base import frames

    d, want = "/root/testdata/sf0.001", {}
    for r in frames(spark, d).where("value IS NOT NULL").select("user_id", "frame", "value").collect():
        want.setdefault(r.user_id, []).append((r.frame, r.value))
    got = {(r.user_id, r.frame, r.value) for r in queries.queries()["drop_worst_all"](spark, d).collect()}
    assert got == {(k, *x) for k, r in want.items() for x in kept(r, 50.0, 8)}
    assert max(x[1] for x in got) >= 12
    q = queries.queries()
    length = {k: len(r) for k, r in frames(spark, d).select("user_id", "frame").groupBy("user_id").agg(F.collect_list("frame").alias("f")).collect()}
    stereo = q["stereo_rows"](spark, d).select("recording", "output_index").collect()
    assert len(stereo) == sum(min(n, length.get(k + 1, 0)) for k, n in length.items() if k % 2 == 0) and max(r.output_index for r in stereo) >= 30
    assert q["ranked_donors_all"](spark, d).where("frame >= 12 AND donor >= 12").count() > 0


def test_edit_score_tells_any_labels_apart(spark):
    e = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate([(0, 256), (500, 500), (-70, 256), (None, -70)])] + [("s", 0, 0, 0)], "k string, t long, a int, b int")
    got = {r["k"]: (r["runs_a"], r["runs_b"], r["edit_score"]) for r in metrics.edit_score(e, ["k"], "t", "a", "b").collect()}
    assert got["s"] == (1, 1, 100.0) and got["r"][:2] == (3, 4) and abs(got["r"][2] - 50) < 1e-9  # 0 500 -70 against 256 500 256 -70
    many = spark.createDataFrame([("r", i, i, i + 1) for i in range(1000)], "k string, t long, a int, b int")
    assert abs(metrics.edit_score(many, ["k"], "t", "a", "b").first()["edit_score"] - 99.8) < 1e-9


def test_pooled_edit_score_joins_runs_across_recordings(spark):
    e = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 2, 1), ("b", 0, 2, 3), ("b", 1, 2, 3)], "k string, t long, p int, q int")
    r = metrics.pooled_edit_score(e, ["k"], "t", "p", "q").first()
    assert (r["runs_a"], r["runs_b"], r["edit_score"]) == (2, 2, 50.0)
    for tile in (1, 2, 64):
        rng = random.Random(tile)
        long = [(k, i, rng.randrange(4), rng.choice([None, 0, 1, 2, 3])) for k in "abc" for i in range(30 if tile > 1 else 4)]
        text = ["".join(str(x) for k, x in enumerate(side) if not k or x != side[k - 1]) for side in ([r[2] for r in long], [r[3] for r in long if r[3] is not None])]
        r = metrics.pooled_edit_score(spark.createDataFrame(long, "k string, t long, p int, q int"), ["k"], "t", "p", "q", 16 if tile == 64 else tile * 6).first()
        far = list(range(len(text[1]) + 1))
        for i, x in enumerate(text[0], 1):
            far, before = [i], far
            for j, y in enumerate(text[1], 1):
                far.append(min(far[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        assert (r["runs_a"], r["runs_b"]) == (len(text[0]), len(text[1])) and abs(r["edit_score"] - 100 * (1 - far[-1] / max(map(len, text)))) < 1e-9


def test_distance_in_one_pass_where_one_side_has_runs_put_in(spark, monkeypatch):
    rng = random.Random(5)
    for trial in range(300):
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        a = [rng.randrange(4) if rng.random() < 0.05 else x for x in b if rng.random() < 0.8] or [b[0]]
        a = (a[:3] + [3] + a[3:])[: len(b)] if trial % 3 == 0 else a
        far = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            far, before = [i], far
            for j, y in enumerate(b, 1):
                far.append(min(far[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        for most in (0, 3, 8):
            at, size = [min(len(a), e // 2) for e in range(most + 1)], 7
            for j in range(0, len(b), size):
                if max(at) >= 0:
                    at = metrics.excess_run(a[min(x for x in at if x >= 0) :], b[j : j + size], at, len(a), len(b) - j)
            excess = next((e for e, x in enumerate(at) if x == len(a)), None)
            assert excess == (far[-1] - len(b) + len(a) if far[-1] - len(b) + len(a) <= most else None)
    written, cut = [], metrics.cut
    monkeypatch.setattr(metrics, "cut", lambda df: written.append(1) or cut(df))
    side = lambda codes: spark.createDataFrame(list(enumerate(codes)), "index long, code long")
    long = [rng.randrange(5) for _ in range(400)]
    short = [x for i, x in enumerate(long) if i % 9]
    assert metrics.sequence_distance(side(long), side(short), 4) == (400, len(short), 400 - len(short)) and len(written) < 10
    assert metrics.sequence_distance(side([9, *short]), side(long), 4) == (len(short) + 1, 400, 400 - len(short))


def test_histogram_of_one_value_and_exact_quantiles(spark):
    df = spark.createDataFrame([(4.0,)] * 3 + [(None,), (float("nan"),)], "x double")
    assert metrics.value_range(df, "x") == (4.0, 4.0)
    assert [tuple(r) for r in metrics.histogram(df, [], "x", 4.0, 4.0, 10).collect()] == [(5, 3)]
    assert metrics.value_range(df.where("false"), "x") == (0.0, 0.0)
    many = spark.createDataFrame([(float(i * i % 101),) for i in range(200)], "x double").repartition(7)
    want = many.agg(F.percentile("x", [0.0, 0.33, 0.5, 1.0])).first()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(metrics.quantiles(many, "x", (0.0, 0.33, 0.5, 1.0)), want, strict=True))


def test_points_between_pixels(spark):
    pixels = spark.createDataFrame([("a", y, x, 10.0 * y + x) for y in range(3) for x in range(4) if (y, x) != (2, 3)] + [(None, y, x, 1.0) for y in (0, 1) for x in (0, 1)], "k string, y int, x int, v double")
    points = spark.createDataFrame([("a", 0, 1.25, 0.5), ("a", 1, -3.0, 0.0), ("a", 2, 9.0, 9.0), ("a", 3, None, 1.0), ("b", 4, 0.0, 0.0), (None, 5, 0.5, 0.5), ("a", 6, 1.25, 0.5)], "k string, id int, u double, v double")
    got = {r["id"]: r["sample"] for r in metrics.bilinear_sample(pixels, points, ["k"], 4, 3).collect()}
    assert {i: None if x is None else round(x, 9) for i, x in got.items()} == {0: 6.25, 1: 0.0, 2: None, 3: None, 4: None, 5: 1.0, 6: 6.25}


@pytest.mark.parametrize(("tile", "most_edges"), [(1024, 1 << 20), (3, 4)])
def test_components_within_and_across_tiles(spark, tile, most_edges):
    rng = random.Random(tile)
    on = {(k, y, x) for k in ("f", None) for y in range(14) for x in range(11) if rng.random() < 0.45}
    got = {(r["k"], r["y"], r["x"]): r["component"] for r in graph.pixel_components(spark.createDataFrame(sorted(on, key=str), "k string, y int, x int"), ["k"], 11, tile).collect()}

    def flood(nodes, near):
        name = {}
        for n in sorted(nodes, key=lambda n: (str(n[0]), *n[1:])):
            todo = [n] if n not in name else []
            while todo:
                m = todo.pop()
                if m not in name:
                    name[m] = n
                    todo += [o for o in near(m) if o in nodes]
        return name

    want = flood(on, lambda m: [(m[0], m[1] + dy, m[2] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    assert got == {n: c[1] * 11 + c[2] for n, c in want.items()}
    edges = [(k, rng.randrange(40), rng.randrange(40)) for k in ("m", "n", None) for _ in range(30)]
    nodes = {(k, i) for k in ("m", "n", None, "lone") for i in range(40) if i % 7}
    touching = {}
    for k, a, b in edges:
        touching.setdefault((k, a), []).append((k, b)), touching.setdefault((k, b), []).append((k, a))
    out = graph.components(spark.createDataFrame(edges, "k string, a int, b int"), spark.createDataFrame(sorted(nodes, key=str), "k string, node int"), ["k"], most_edges)
    want = flood(nodes, lambda m: touching.get(m, []))
    assert {(r["k"], r["node"]): r["component"] for r in out.collect()} == {n: c[1] for n, c in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_equals_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    values = [rng.choice([0.0, 0.2, 0.5, 0.9, None, float("nan"), float("inf"), float("-inf")]) if rng.random() < 0.3 else rng.random() for _ in range(300)]
    min_on, hold = rng.randint(1, 4), rng.randint(0, 3)
    want, active, above, below = [], False, 0, 0
    for v in values:
        v = v if v is not None and abs(v) < float("inf") else 0.0
        above, below = above + 1 if v >= 0.6 else 0, below + 1 if v < 0.4 else 0
        if active:
            active = below <= hold
        elif above >= min_on:
            active = True
            want[len(want) - (min_on - 1) :] = [True] * (min_on - 1)
        want.append(active)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", i, v) for i, v in enumerate(values)], "k string, t long, x double")
    got = rows(sequence.hysteresis(df, ["k"], "t", "x", 0.6, 0.4, min_on, hold), "k", "t", "active")
    assert got == [(k, i, a) for k in "ab" for i, a in enumerate(want)]


def test_a_long_key_takes_time_in_proportion(spark):
    import time

    def took(n):
        df = spark.range(n).selectExpr("'a' AS k", "id AS t", "abs(hash(id) % 100) / 100 AS x")
        began = time.time()
        for out in (sequence.hysteresis(df, ["k"], "t", "x", 0.6, 0.3, 2, 1), sequence.ema_dual_threshold(df, ["k"], "t", "x"), sequence.rate_limit(df, ["k"], "t", "x", 0.1, 0.0, 1.0)):
            assert out.count() == out.agg(F.count("t")).first()[0] == n
        return time.time() - began

    took(1000)
    assert took(400_000) < 4 * took(100_000) + 4


def test_spaced_top_k_has_no_cap(spark):
    df = spark.createDataFrame([("a", i, float(-abs(i - 2500))) for i in range(5000)] + [("b", 1, 5.0), ("b", 3, 5.0), ("b", 3, 5.0)], "k string, t long, x double")
    got = rows(sampling.spaced_top_k(df, ["k"], "t", "x", gap=1000, most=5), "k", "t")
    assert len([t for k, t in got if k == "a"]) == 5 and [t for k, t in got if k == "b"] == [3]


def test_interval_labels_with_long_and_short_segments(spark):
    import random

    rng = random.Random(1)
    segments = [("r", 0, 5000, 1, 0)] + [("r", s, s + rng.randint(0, 9), rng.randint(2, 9), i + 1) for i, s in enumerate(sorted(rng.sample(range(5200), 200)))] + [("r", 9, 5, 99, 999)]
    f = spark.createDataFrame([("r", i) for i in range(5300)], "k string, t long")
    seg = spark.createDataFrame(segments, "k string, s long, e long, label int, pos int")
    want = [max([(p, v) for _, a, b, v, p in segments if a <= t <= b], default=(0, None))[1] for t in range(5300)]
    assert [r["label"] for r in joins.interval_labels(f, seg, ["k"], "t", "s", "e", "label", "pos").orderBy("t").collect()] == want


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from timeloom.plans import scratch

    with scratch.scope(spark) as folder:
        assert scratch.cut(spark.range(5)).count() == 5
        local = folder.removeprefix("file:")
        assert os.listdir(local)
    assert not os.path.exists(local) and scratch.cut(spark.range(3)).count() == 3


def test_masked_pool_counts_nulls_as_zero(spark):
    patches = spark.createDataFrame([(1, 0, [2.0, 4.0]), (1, 1, [6.0, None]), (1, 2, None)], "g int, patch int, v array<double>")
    masks = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 0, 2, 9.0), (1, 1, 0, None), (1, 1, 1, 0.0)], "g int, object int, patch int, occupancy double")
    got = {r["object"]: r["pooled"] for r in ml.masked_pool(patches, masks, ["g"], "v").collect()}
    assert got == {0: [5.0, 1.0], 1: [0.0, 0.0]}


def test_softmax_and_unit_vectors_of_long_arrays(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i % 10 + 0.0).alias("v"))
    r = df.select(S.softmax(F.col("v")).alias("p"), S.l2_normalize(F.col("v")).alias("u"), S.softmax(F.lit(None).cast("array<double>")).alias("none")).first()
    assert abs(sum(r["p"]) - 1) < 1e-9 and abs(sum(x * x for x in r["u"]) - 1) < 1e-9 and r["none"] is None
    assert r["p"][8] == max(r["p"])


def test_interval_labels_of_a_null_key(spark):
    f = spark.createDataFrame([(k, t) for k in ("a", None) for t in range(4)], "k string, t int")
    seg = spark.createDataFrame([(None, 1, 2, 7), ("a", 3, 9, 8)], "k string, s int, e int, label int")
    assert {(r["k"], r["t"]): r["label"] for r in joins.interval_labels(f, seg, ["k"], "t", "s", "e", "label", missing=-1).collect()} == {(k, t): 7 if k is None and 1 <= t <= 2 else 8 if k and t == 3 else -1 for k in ("a", None) for t in range(4)}


def test_folds_tell_the_same_as_a_copy_of_every_row_for_each_group(spark):
    rows = [(i, g) for i, g in enumerate(["b", "a", None, "b", "c", "b", None])]
    df = spark.createDataFrame(rows, "i long, g string")
    folds = {r["i"]: r["fold"] for r in sampling.fold_ids(df, "g").collect()}
    assert folds == {0: 2, 1: 1, 2: 0, 3: 2, 4: 3, 5: 2, 6: 0}
    copies = sampling.leave_one_group_out(df, "g")
    want = sorted(map(str, copies.groupBy("holdout", "role").count().collect()))
    assert copies.count() == 28 and sorted(map(str, sampling.fold_sizes(df, "g").withColumnRenamed("n", "count").collect())) == want
    name = {2: "b", 1: "a", 0: None, 3: "c"}
    for k in range(4):
        roles = {r["i"]: r["role"] for r in sampling.fold_ids(df, "g").withColumn("role", sampling.fold_role(k)).collect()}
        assert roles == {r["i"]: r["role"] for r in copies.where(F.col("holdout").eqNullSafe(F.lit(name[k]))).collect()}
    assert sampling.fold_ids(df.where("false"), "g").count() == sampling.fold_sizes(df.where("false"), "g").count() == 0
    assert [tuple(r) for r in sampling.fold_sizes(df.where("g = 'a'"), "g").collect()] == [("a", "validation", 1)]
