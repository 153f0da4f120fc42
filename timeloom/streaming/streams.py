"""Causal operators as Structured Streaming. Each has a batch twin in operators/ and shares its array code: on the same rows both give the same result, in whatever order the rows
arrive within the delay, null, NaN and infinite values included."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FractionalType, StructField, StructType

from timeloom.operators import kernels
from timeloom.streaming.ordered import SLICES, Slices, by_slice, in_order, keep_state, micros, one, packed


def pair_streams(left: DataFrame, right: DataFrame, key: str, time: str, max_delta: str, delay: str) -> DataFrame:
    """All pairs of a key within max_delta; rows later than `delay` are dropped. For one partner each: stream_nearest_pairs()."""
    a = left.withWatermark(time, delay).alias("a")
    b = right.withWatermark(time, delay).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col(f"b.{time}").between(F.col(f"a.{time}") - F.expr(f"interval {max_delta}"), F.col(f"a.{time}") + F.expr(f"interval {max_delta}"))
    return a.join(b, near).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("left_id"), F.col(f"a.{time}").alias("left_time"), F.col("b.id").alias("right_id"), F.col(f"b.{time}").alias("right_time"))


def decide(lefts: list[tuple], rights: list[tuple], delta: int) -> list[tuple]:
    """For each (time, id) of lefts, in order, the nearest of rights (time, id, taken; in order) within delta, the earlier of two, and a reason if there is none or it is
    taken; marks what is taken."""
    out = []
    times = np.array([r[0] for r in rights], np.int64)
    for t, i in lefts:
        at = int(np.searchsorted(times, t))
        ahead = at if at < len(rights) else None
        back = int(np.searchsorted(times, times[at - 1])) if at else None  # the first of equal times
        pick = ahead if back is None else back if ahead is None or t - times[back] <= times[ahead] - t else ahead
        if pick is None or abs(times[pick] - t) > delta:
            out.append((i, t, None, None, "right_delta"))
        elif rights[pick][2]:
            out.append((i, t, None, None, "right_non_unique"))
        else:
            rights[pick] = (*rights[pick][:2], True)
            out.append((i, t, rights[pick][1], rights[pick][0], None))
    return out


class NearestPairs(Slices):
    """Both sides of a key wait in its slice's state. A left row is decided once the watermark is max_delta past it, as no nearer right row can come then; right rows go when
    no left row, here or to come, can reach them."""

    def __init__(self, held: str, names: list[str], kinds: list[DataType], delta: int, odd_keys: bool):
        super().__init__(3, held, names, kinds)
        self.delta, self.odd_keys = delta, odd_keys

    def settle(self, stored, fresh, limit):
        sides = defaultdict(lambda: ([], []))
        for t, key, i, is_left, taken in [*(zip(*stored, strict=True) if stored else []), *[(*r, False) for r in fresh]]:
            left, right = sides[one(key) if self.odd_keys else key]
            left.append((t, i)) if is_left else right.append((t, i, taken))
        order = lambda r: (r[0], r[1] is not None, r[1])
        out, kept, due = [], [], []
        for key, (left, right) in sides.items():
            left.sort(key=order)
            right.sort(key=order)
            ready, wait = [r for r in left if r[0] + self.delta <= limit], [r for r in left if r[0] + self.delta > limit]
            out += [(key, *r) for r in decide(ready, right, self.delta)]
            reach = min([limit, *[r[0] for r in wait[:1]]]) - self.delta
            right = [r for r in right if r[0] >= reach]
            due += [-(-(r[0] + self.delta) // 1000) for r in wait[:1]] + [-(-(r[0] + self.delta) // 1000) + 1 for r in right[:1]]
            kept += [(t, key, i, True, False) for t, i in wait] + [(t, key, i, False, taken) for t, i, taken in right]
        return packed(kept, 5) if kept else None, min(due, default=None), out


def stream_nearest_pairs(left: DataFrame, right: DataFrame, key: str, time: str, max_delta: str, delay: str, slices: int = SLICES) -> DataFrame:
    """key, left_id, left_time, right_id, right_time, reason: each left row once, with its nearest right row within max_delta as joins.pair_nearest has it, or with a reason:
    right_delta (none so near) or right_non_unique (an earlier left row has it).

    left, right: key, id (long), time. Both sides have a watermark `delay` behind their latest row, and the slower one counts; rows without a time or later than that are
    dropped. What a key holds is bounded by max_delta and delay.
    """
    keep_state(left)
    side = lambda df, is_left: by_slice(df.select(key, time, F.col("id").cast("long").alias("id"), F.lit(is_left).alias("is_left")), [key], time, ["id", "is_left"], delay, slices)
    kind = left.schema[key].dataType
    held = f"t array<long>, key array<{kind.simpleString()}>, id array<long>, is_left array<boolean>, taken array<boolean>"
    out = StructType([StructField(key, kind)]).add("left_id", "long").add("left_time", "long").add("right_id", "long").add("right_time", "long").add("reason", "string")
    processor = NearestPairs(held, out.names, [f.dataType for f in out], micros(max_delta), isinstance(kind, FractionalType | ArrayType))
    rows = side(left, True).union(side(right, False)).groupBy("slice").transformWithStateInPandas(processor, out, "append", "EventTime")
    return rows.withColumns({n: F.timestamp_micros(n) for n in ("left_time", "right_time")})


def numbers(rows: list[tuple], at: int = -1) -> np.ndarray:
    return np.array([np.nan if r[at] is None else r[at] for r in rows], float)


def stream_hysteresis(df: DataFrame, key: str, time: str, value: str, on: float, off: float, min_on: int, hold: int, delay: str, carry: list[str] | None = None, ttl: str | None = None, slices: int = SLICES) -> DataFrame:
    """key, time, carry, active as they are settled: a row that isn't active is held back until it can't be filled any more, at most min_on - 1 rows of its key."""
    if off > on:
        raise ValueError("off must not be above on")

    def advance(state, rows):
        active, below, waiting = state
        rows = [(t, *extra) for t, extra in zip(waiting["t"], waiting["row"], strict=True)] + [(r[0], *r[1:]) for r in rows] if waiting else rows
        filled, open_, active, below = kernels.hysteresis_run(numbers(rows), on, off, min_on, hold, active, below)
        end = len(rows) - open_
        return (active, below, {"t": [r[0] for r in rows[end:]], "row": [r[1:] for r in rows[end:]]}), [(*r[: 1 + len(carry or [])], bool(a)) for r, a in zip(rows[:end], filled[:end].tolist(), strict=True)]

    return _hysteresis_stream(df, key, time, value, advance, delay, carry or [], ttl, slices)


def _hysteresis_stream(df: DataFrame, key: str, time: str, value: str, advance, delay: str, carry: list[str], ttl: str | None, slices: int) -> DataFrame:
    """The rows held back are part of the state, column by column."""
    used = [*carry, value]
    kinds = ", ".join(f"w{i} array<{df.schema[c].dataType.simpleString()}>" for i, c in enumerate(used))

    def by_columns(state, rows):
        active, below, t, *columns = state
        (active, below, waiting), out = advance((active, below, {"t": list(t), "row": list(zip(*columns, strict=True)) if columns else []}), rows)
        return (active, below, waiting["t"], *[[r[i] for r in waiting["row"]] for i in range(len(used))]), out

    return in_order(df, [key], time, delay, used, [], f"active boolean, below long, t array<long>, {kinds}", lambda: (False, 0, [], *[[] for _ in used]), by_columns, "active boolean", carry, ttl, slices)


def stream_ema_switch(df: DataFrame, key: str, time: str, value: str, delay: str, alpha: float = 0.65, on: float = 0.40, off: float = 0.28, carry: list[str] | None = None, ttl: str | None = None, slices: int = SLICES) -> DataFrame:
    """key, time, carry, ema, active as sequence.ema_dual_threshold has them."""
    carry = carry or []

    def advance(state, rows):
        ema, active = kernels.ema_switch_run(numbers(rows), np.zeros(len(rows), bool), alpha, on, off, *state)
        return (float(ema[-1]), bool(active[-1])), [(*r[: 1 + len(carry)], e, a) for r, e, a in zip(rows, ema.tolist(), active.tolist(), strict=True)]

    return in_order(df, [key], time, delay, [*carry, value], [], "ema double, active boolean", lambda: (0.0, False), advance, "ema double, active boolean", carry, ttl, slices)


def stream_rate_limit(df: DataFrame, key: str, time: str, value: str, step_limit: float, low: float, high: float, delay: str, carry: list[str] | None = None, ttl: str | None = None, slices: int = SLICES) -> DataFrame:
    """key, time, carry, limited as sequence.rate_limit has it."""
    carry = carry or []

    def advance(state, rows):
        out, last = kernels.rate_run(numbers(rows), step_limit, low, high, state[0])
        return (last,), [(*r[: 1 + len(carry)], y) for r, y in zip(rows, out, strict=True)]

    return in_order(df, [key], time, delay, [*carry, value], [], "last_output double", lambda: (None,), advance, "limited double", carry, ttl, slices)


def stream_trailing_window(df: DataFrame, key: str, time: str, vec: str, width: int, size: int, delay: str, carry: list[str] | None = None, ttl: str | None = None, slices: int = SLICES) -> DataFrame:
    """key, time, carry, window (flat, width * size numbers): the last rows' vectors as sequence.trailing_window has them, null ones left out, zeros in front."""
    carry = carry or []

    def advance(state, rows):
        vectors = [None if v is None else [float(x) for x in v] for v in state[0]] + [None if r[-1] is None else [float(x) for x in r[-1]] for r in rows]
        out, skip = [], len(vectors) - len(rows)
        for i, r in enumerate(rows):
            known = [v for v in vectors[max(0, skip + i - width + 1) : skip + i + 1] if v is not None]
            out.append((*r[: 1 + len(carry)], [0.0] * (size * (width - len(known))) + [x for v in known for x in v]))
        return (vectors[len(vectors) - width + 1 :] if width > 1 else [],), out

    return in_order(df, [key], time, delay, [*carry, vec], [], "vectors array<array<double>>", lambda: ([],), advance, "window array<double>", carry, ttl, slices)


def stream_episodes(df: DataFrame, key: str, time: str, flag: str, gap: str, delay: str, least: int = 1) -> DataFrame:
    """key, start, end, n of true rows that are less than `gap` apart, once the watermark has passed them; sessions of fewer than `least` rows go."""
    on = df.withWatermark(time, delay).where(F.col(flag))
    s = on.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("end"))
    return s.where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), "end", "n")


def stream_window_stats(df: DataFrame, time: str, value: str, valid: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """start, rows, count, mean, median (approximate), max, valid_rate for each window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    v = F.when(~F.isnan(value), F.col(value))
    out = df.withWatermark(time, delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.percentile_approx(v, 0.5).alias("median"), F.max(v).alias("max"), F.avg(F.col(valid).cast("double")).alias("valid_rate"),
    )
    return out.select(F.col("w.start").alias("start"), "rows", "count", "mean", "median", "max", "valid_rate")


def stream_ingest_dedup(df: DataFrame, key: str, time: str, delay: str, seen: DataFrame | None = None) -> DataFrame:
    """Records whose id wasn't seen within the watermark, nor in the table of ids already taken."""
    new = df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return new.join(seen.select(key), key, "left_anti") if seen is not None else new
