"""Filters and episodes of keys that are cut into blocks, against plain loops over the whole key."""

import math
import random

import numpy as np
import pytest

from timeloom.operators import sequence

KIND = "k string, t long, x double"


def series(rng, n, gaps=0.1, flat=0.0):
    out, v = [], 0.0
    for _ in range(n):
        v = v if rng.random() < flat else round(v + rng.uniform(-1, 1), 3)
        out.append(rng.choice([None, float("nan")]) if rng.random() < gaps else v)
    return out


def frame(spark, keys):
    return spark.createDataFrame([(k, 3 * i, v) for k, values in keys.items() for i, v in enumerate(values)], KIND).repartition(5)


def got(df, name):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append((r["t"], r[name]))
    return {k: [v for _, v in sorted(rows)] for k, rows in out.items()}


def brute_savgol(values, window, poly, median):
    n = len(values)
    known = [i for i, v in enumerate(values) if v is not None and not math.isnan(v)]
    if not known:
        return [None] * n
    v = np.interp(range(n), known, [values[i] for i in known])
    r = median // 2
    v = np.array([sorted([v[j] if 0 <= j < n else 0.0 for j in range(i - r, i + r + 1)])[r] for i in range(n)])
    size = min(window, n)
    size -= 1 - size % 2
    if size < poly + 2:
        return v.tolist()
    out = []
    for i in range(n):
        first = min(max(i - size // 2, 0), n - size)
        out.append(float(np.polyval(np.polyfit(np.arange(size), v[first : first + size], poly), i - first)))
    return out


@pytest.mark.parametrize(("window", "poly", "median", "block"), [(7, 2, 3, 16), (9, 3, 1, 7), (5, 2, 5, 100), (3, 2, 3, 4)])
def test_savgol_over_blocks(spark, window, poly, median, block):
    rng = random.Random(window)
    keys = {"long": series(rng, 150), "gap": [1.0] + [None] * 60 + [7.0] + series(rng, 9), "none": [None, float("nan")], "one": [4.0], None: series(rng, 6), "few": series(rng, 3, 0.5)}
    out = got(sequence.median_then_savgol(frame(spark, keys), ["k"], "t", "x", window, poly, median, block), "x_smooth")
    for k, values in keys.items():
        want = brute_savgol(values, window, poly, median)
        assert len(out[k]) == len(want) and all(a is None and b is None or abs(a - b) < 1e-6 for a, b in zip(out[k], want, strict=True)), k


def brute_smooth(values, sigma):
    r = max(1, int(4 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    v = [0.0 if x is None or math.isnan(x) else x for x in values]
    n = len(v)
    mirror = lambda j: j % (2 * n) if j % (2 * n) < n else 2 * n - 1 - j % (2 * n)
    return [sum(a * v[mirror(i + k - r)] for k, a in enumerate(w / w.sum())) for i in range(n)]


def brute_episodes(x, distance, prominence, most, valid):
    n, peaks, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(peaks, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def rise(p):
        a = b = p
        while a > 0 and x[a - 1] <= x[p]:
            a -= 1
        while b + 1 < n and x[b + 1] <= x[p]:
            b += 1
        return x[p] - max(min(x[a : p + 1]), min(x[p : b + 1]))

    good = sorted(sorted((p for p in kept if rise(p) >= prominence and valid[p]), key=lambda p: (rise(p), p), reverse=True)[:most])
    edges = [(p + q) // 2 for p, q in zip(good, good[1:], strict=False)]
    return [(i, 3 * a, 3 * b, 3 * p) for i, (a, b, p) in enumerate(zip([0, *[e + 1 for e in edges]], [*edges, n - 1], good, strict=False))]


@pytest.mark.parametrize(("sigma", "distance", "prominence", "block"), [(1.0, 5, 0.3, 16), (0.6, 2, 0.0, 9), (2.0, 12, 0.1, 1000)])
def test_episodes_over_blocks(spark, sigma, distance, prominence, block):
    rng = random.Random(distance)
    keys = {"a": series(rng, 160), "b": series(rng, 40, 0.3), "short": [1.0, 2.0], "flat": [1.0] * 20, None: series(rng, 30, 0, 0.5), "tiny": [2.0, 3.0, 1.0]}
    df = frame(spark, keys).selectExpr("*", "t % 7 <> 0 AS fine")
    out = {}
    for r in sequence.find_episodes(df, ["k"], "t", "x", sigma, distance, prominence, 4, "fine", block).collect():
        out.setdefault(r["k"], []).append((r["episode"], r["start_frame"], r["end_frame"], r["peak"]))
    smooth = got(sequence.gaussian_smooth(df, ["k"], "t", "x", sigma, block=block), "smooth")
    for k, values in keys.items():
        assert np.allclose(smooth[k], brute_smooth(values, sigma), atol=1e-12)
        assert sorted(out.get(k, [])) == brute_episodes(smooth[k], distance, prominence, 4, [3 * i % 7 != 0 for i in range(len(values))]), k


def test_peaks_with_flat_tops_and_equal_heights():
    rng = random.Random(4)
    for _ in range(300):
        x = [float(rng.randrange(5)) for _ in range(rng.randrange(3, 40))]
        at, height, low, i = [], [], [], 0
        runs = []
        while i < len(x):
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            runs.append((i, j, x[i]))
            i = j + 1
        valley = math.inf
        for k, (a, b, v) in enumerate(runs):
            if 0 < k < len(runs) - 1 and runs[k - 1][2] < v > runs[k + 1][2]:
                at.append((a + b) // 2), height.append(v), low.append(valley)
                valley = math.inf
            else:
                valley = min(valley, v)
        low.append(valley)
        keep, rise = sequence.far_apart(at, height, 3), sequence.prominences(height, low)
        good = [p for p, k, r in zip(at, keep, rise, strict=True) if k and r >= 1]
        assert [3 * p for p in good] == [p for *_, p in brute_episodes(x, 3, 1, 99, [True] * len(x))]


# Lag correlation over blocks


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_lag_correlation_over_blocks(spark, block):
    from timeloom.operators import metrics

    rng = random.Random(block)
    make = lambda n: [(k, t, rng.choice([None, float("nan")]) if rng.random() < 0.1 else 1000 + rng.random()) for k in ("a", None) for t in range(-5, n) if rng.random() < 0.8] + [("flat", t, 7.0) for t in range(9)] + [("a", 3, 999.5)]
    x, y = make(60), make(50)
    got = {(r["k"], r["lag"]): (r["n"], r["correlation"]) for r in metrics.lag_correlation(*[spark.createDataFrame(v, KIND).repartition(3) for v in (x, y)], ["k"], "t", "x", 6, 3, block).collect()}
    for k in ("a", None, "flat"):
        for lag in range(-6, 7):
            pairs = [(p, q) for kx, t, p in x for ky, u, q in y if kx == ky == k and u == t + lag and None not in (p, q) and not math.isnan(p + q)]
            n, c = got.get((k, lag), (0, None))
            assert n == len(pairs)
            if n < 3 or k == "flat":
                assert c is None
            else:
                assert abs(c - np.corrcoef(*zip(*pairs, strict=True))[0, 1]) < 1e-9


# Perceptron


def test_gradient_is_that_of_the_loss():
    from timeloom.operators import ml

    rng = np.random.default_rng(3)
    sizes, x, y = [4, 5, 3], rng.standard_normal((7, 4)), rng.integers(0, 3, 7)
    flat, w = rng.standard_normal(4 * 5 + 5 + 5 * 3 + 3), np.array([0.5, 2.0, 1.0])
    g, loss, weight = ml.gradient(ml.unflat(flat, sizes), x, y, w, 0.2)
    assert abs(weight - w[y].sum()) < 1e-12
    p = ml.forward(ml.unflat(flat, sizes), x)[1]
    by_hand = sum(-w[c] * (0.8 * (c == label) + 0.2 / 3) * math.log(p[i, c]) for i, label in enumerate(y) for c in range(3))
    assert abs(loss - by_hand) < 1e-9
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (ml.gradient(ml.unflat(flat + s, sizes), x, y, w, 0.2)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_class_weights_and_smoothing_change_the_fit(spark):
    from timeloom.operators import ml

    rng = np.random.default_rng(5)
    rows = [([float(a), float(b)], int(label)) for label, n, at in ((0, 190, 0.0), (1, 10, 1.2)) for a, b in rng.standard_normal((n, 2)) + at]
    df = spark.createDataFrame([*rows, (None, 1), ([0.0, 0.0], -1)], "v array<double>, label int").repartition(4)
    fits = {name: ml.train_perceptron(df, "v", "label", 2, [6], steps=25, **how) for name, how in {"even": {"weights": "none", "smoothing": 0.0}, "weighted": {"smoothing": 0.0}, "smooth": {"weights": "none", "smoothing": 0.3}}.items()}
    scored = {name: ml.score_perceptron(m, df, "v").collect() for name, m in fits.items()}
    found = {name: sum(r["prediction"] == 1 for r in out if r["label"] == 1 and r["v"] is not None) for name, out in scored.items()}
    assert found["weighted"] > found["even"]  # rare classes are found more often
    sure = {name: np.mean([max(r["p"]) for r in out if r["p"]]) for name, out in scored.items()}
    assert sure["smooth"] < sure["even"] - 0.02
    assert all(m.losses[-1] < m.losses[0] for m in fits.values())
    assert [r["prediction"] for r in scored["even"] if r["v"] is None] == [None]
    again = ml.train_perceptron(df.repartition(2), "v", "label", 2, [6], steps=3, smoothing=0.0)
    first = ml.train_perceptron(df, "v", "label", 2, [6], steps=3, smoothing=0.0)
    assert all(np.allclose(a, b, atol=1e-6) for p, q in zip(again.layers, first.layers, strict=True) for a, b in zip(p, q, strict=True))


def brute_donors(bad, frames, weight):
    out = {}
    for (rec, f), pixels in bad.items():
        scores = sorted((len(pixels & bad.get((rec, d), set())) / len(pixels) + weight * abs(f - d), d) for r, d in frames if r == rec and d != f)
        for p in pixels:
            free = [(score, d) for score, d in scores if p not in bad.get((rec, d), set())]
            if free:
                out[rec, f, p] = free[0]
    return out


@pytest.mark.parametrize(("weight", "first"), [(0.002, 8), (0.2, 2), (0.34, 1), (0.0, 3)])
def test_ranked_donors_equal_the_check_of_all_frames(spark, weight, first):
    """Recordings of up to 40 frames: at a weight of 0.2 only frames within 5 meet at first; pixel 64 is valid in far frames only, pixel 129 in none."""
    rng = random.Random(7)
    frames = [(r, f) for r, n in (("a", 40), ("b", 9), ("c", 1)) for f in range(n)]
    bad = {}
    for r, f in frames:
        pixels = {p for p in range(0, 200, 3) if rng.random() < rng.choice([0.1, 0.7])} | {129}
        bad[r, f] = pixels | ({64} if f < 30 else set()) if rng.random() < 0.9 else set()
    bad = {k: v for k, v in bad.items() if v}
    rows = [(r, f, p) for (r, f), pixels in bad.items() for p in pixels]
    kind = "recording string, frame long, pixel long"
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1), ("a", None, 1), ("a", 1, None)], kind)
    every = spark.createDataFrame([*frames, frames[0], (None, 3)], "recording string, frame long")
    out = sequence.ranked_donors(df, every, weight, first).collect()
    want = brute_donors(bad, frames, weight)
    assert len(out) == len(want) and {(r["recording"], r["frame"], r["pixel"]): (round(r["score"], 9), r["donor"]) for r in out} == {k: (round(s, 9), d) for k, (s, d) in want.items()}
    assert sequence.ranked_donors(df.where("false"), every, weight, first).count() == sequence.ranked_donors(df, every.where("false"), weight, first).count() == 0
