"""Operators on the ordered rows of a key (recording, track): runs, gaps, smoothing, state. Each shuffles once, on its keys, and never looks across them.

`keys` are the partition columns, `order` the column of time. Rows of null keys form a partition of their own; null values are gaps. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window, WindowSpec

from timeloom.operators import kernels
from timeloom.plans.ranges import in_ranges, join_same, numbered, with_halo
from timeloom.plans.scratch import cut


def over(keys: list[str], order: str, before: int | None = None, after: int | None = None) -> WindowSpec:
    """Window of rows: whole partition in order, or `before` rows back to `after` rows ahead."""
    w = Window.partitionBy(*keys).orderBy(order)
    return w if before is None else w.rowsBetween(-before, after)


def whole(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def up_to(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def from_here(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def frame_index(df: DataFrame, keys: list[str], order: list[str], name: str = "frame") -> DataFrame:
    """Dense row number from 0 in the given order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def island(changed: Column, keys: list[str], order: str) -> Column:
    """Running count of changes: rows between two changes share a number, from 0."""
    return (F.sum(F.when(changed, 1).otherwise(0)).over(up_to(keys, order)) - 1).cast("long")


# Windows of vectors


def trailing_window(df: DataFrame, keys: list[str], order: str, vec: str, width: int, size: int, out: str = "window") -> DataFrame:
    """The last `width` vectors, this row's included, oldest first; zero vectors stand for rows before the first."""
    rows = F.collect_list(vec).over(over(keys, order, width - 1, 0))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("double"), size), width)
    return df.withColumn(out, F.concat(F.slice(zeros, F.lit(1), F.lit(width) - F.size(rows)), rows.cast("array<array<double>>")))


def window_pool(df: DataFrame, window: str, width: int, how: str = "mean", out: str = "pooled") -> DataFrame:
    """mean: per dimension, divided by width whatever was padded; concat: all vectors in a row."""
    if how == "concat":
        return df.withColumn(out, F.flatten(window))
    if how != "mean":
        raise ValueError(f"unknown pool {how!r}")
    total = F.aggregate(F.slice(window, 2, width), F.col(window)[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return df.withColumn(out, F.transform(total, lambda x: x / width))


def first_difference(df: DataFrame, keys: list[str], order: str, vec: str, out: str = "delta") -> DataFrame:
    """Vector less the previous row's; zeros on the first row."""
    last = F.lag(vec).over(over(keys, order))
    zero = F.transform(vec, lambda x: F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.zip_with(vec, last, lambda a, b: (a - b).cast("double")), zero))


def centered_moving_average(df: DataFrame, keys: list[str], order: str, values: list[str], width: int = 3) -> DataFrame:
    """Means over a centred window of odd width; beyond an end the end's value is repeated. Adds <value>_smooth for each value."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be odd")
    r, w = width // 2, over(keys, order)
    before, after = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole(keys)) - F.row_number().over(w)
    left, right = F.greatest(F.lit(0), F.lit(r) - before), F.greatest(F.lit(0), F.lit(r) - after)
    first, last = lambda c: F.first(c).over(up_to(keys, order)), lambda c: F.last(c).over(from_here(keys, order))
    return df.withColumns({f"{c}_smooth": (F.sum(c).over(over(keys, order, r, r)) + left * first(c) + right * last(c)) / width for c in values})


# Runs


def run_length_segments(df: DataFrame, keys: list[str], order: str, value: str, half_open: bool = False) -> DataFrame:
    """Maximal runs of equal values: keys, run (from 0), start_frame, end_frame, label, length. Null is a value like any other. Ends are included unless half_open."""
    w = over(keys, order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    runs = df.withColumn("__new", changed)
    runs = runs.withColumn("run", island(F.col("__new"), keys, order))
    end = F.max(order) + (1 if half_open else 0)
    return runs.groupBy(*keys, "run").agg(F.min(order).alias("start_frame"), end.alias("end_frame"), F.first(value).alias("label"), F.count(F.lit(1)).alias("length"))


def true_runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Runs of consecutive integers of `order` whose flag is true: keys, start_frame, end_frame, length."""
    on = df.where(F.col(flag)).withColumn("__k", F.col(order) - F.row_number().over(over(keys, order)))
    return on.groupBy(*keys, "__k").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count(F.lit(1)).alias("length")).drop("__k")


def merge_runs(runs: DataFrame, keys: list[str], bridge: int, min_frames: int = 1) -> DataFrame:
    """Runs that at most `bridge` frames part become one; what is then shorter than min_frames goes."""
    reach = F.max("end_frame").over(Window.partitionBy(*keys).orderBy("start_frame").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start_frame") - reach - 1
    merged = runs.withColumn("__new", gap.isNull() | (gap > bridge)).withColumn("run", island(F.col("__new"), keys, "start_frame"))
    out = merged.groupBy(*keys, "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    return out.withColumn("length", F.col("end_frame") - F.col("start_frame") + 1).where(F.col("length") >= min_frames).drop("run")


def run_id(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """df with __run: the number of the run of equal flags that a row is in."""
    w = over(keys, order)
    mark = df.withColumn("__new", ~F.col(flag).eqNullSafe(F.lag(flag).over(w)) | (F.row_number().over(w) == 1))
    return mark.withColumn("__run", island(F.col("__new"), keys, order)).drop("__new")


def suppress_short_runs(df: DataFrame, keys: list[str], order: str, flag: str, min_frames: int) -> DataFrame:
    """True runs of fewer than min_frames rows become false."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    return run_id(df, keys, order, flag).withColumn(flag, F.col(flag) & (n >= min_frames)).drop("__run")


def fill_short_gaps(df: DataFrame, keys: list[str], order: str, flag: str, max_gap: int) -> DataFrame:
    """False rows between true ones at most max_gap rows apart become true; the ends stay."""
    at = F.when(F.col(flag), F.col(order))
    last, following = F.last(at, ignorenulls=True).over(up_to(keys, order)), F.first(at, ignorenulls=True).over(from_here(keys, order))
    return df.withColumn(flag, F.col(flag) | F.coalesce(following - last - 1 <= max_gap, F.lit(False)))


def expand_bad_runs(df: DataFrame, keys: list[str], order: str, bad: str, ratio: str, recovery: float, track: str) -> DataFrame:
    """A bad row spreads to its neighbours while their ratio is under `recovery` and the track is the same."""
    w, low = over(keys, order), (F.col(ratio) < recovery) | F.col(bad)
    mark = df.withColumn("__low", F.coalesce(low, F.lit(False)))
    same = F.col("__low") & F.lag("__low").over(w) & F.col(track).eqNullSafe(F.lag(track).over(w))
    mark = mark.withColumn("__new", ~F.coalesce(same, F.lit(False))).withColumn("__run", island(F.col("__new"), keys, order))
    hit = F.max(F.col(bad).cast("int")).over(Window.partitionBy(*keys, "__run")) == 1
    return mark.withColumn(bad, F.col("__low") & hit).drop("__low", "__new", "__run")


# Gaps in values


def neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with structs __prev and __next (t, v): the nearest rows, this one included, with a value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    return df.withColumns({"__prev": F.last(known, ignorenulls=True).over(up_to(keys, order)), "__next": F.first(known, ignorenulls=True).over(from_here(keys, order))})


def interpolate_linear(df: DataFrame, keys: list[str], order: str, value: str, max_gap: int | None = None, edges: bool = True, least: int = 2) -> DataFrame:
    """Nulls between values become linear; before the first and after the last the nearest value holds if `edges`. Partitions with fewer than `least` values stay as they
    are. max_gap: only gaps of at most so many rows are filled."""
    span = F.col("__next.t") - F.col("__prev.t")
    line = F.col("__prev.v") + (F.col("__next.v") - F.col("__prev.v")) * (F.col(order) - F.col("__prev.t")) / span
    inner = F.col("__prev").isNotNull() & F.col("__next").isNotNull()
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(inner if max_gap is None else inner & (span - 1 <= max_gap), line)
    if edges:
        filled = filled.when(~inner, F.coalesce("__prev.v", "__next.v"))
    enough = F.count(value).over(whole(keys)) >= least
    return neighbours(df, keys, order, value).withColumn(value, F.when(enough, filled).otherwise(F.col(value))).drop("__prev", "__next")


def interpolate_bounded(df: DataFrame, keys: list[str], order: str, value: str, max_gap: int, width: int = 5) -> DataFrame:
    """Interior gaps of at most max_gap rows become linear, then a centred median over known rows; rows still unknown stay null."""
    filled = interpolate_linear(df, keys, order, value, max_gap=max_gap, edges=False)
    return filled.withColumn(value, F.when(F.col(value).isNotNull(), F.percentile(value, 0.5).over(over(keys, order, width // 2, width // 2))))


def hold_last_valid(df: DataFrame, keys: list[str], order: str, value: str, fill: float = 0.0) -> DataFrame:
    """A null repeats the last value; nulls before the first become `fill`."""
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(up_to(keys, order)), F.lit(fill)))


def nearest_clean_donor(df: DataFrame, keys: list[str], order: str, value: str, valid: str, fallback: str | None = None) -> DataFrame:
    """Adds donor and donor_at: the value of the nearest valid row, the earlier of two equally near; the fallback column where there is none."""
    clean = df.withColumn("__v", F.when(F.col(valid), F.col(value)))
    n = neighbours(clean, keys, order, "__v")
    back, ahead = F.col(order) - F.col("__prev.t"), F.col("__next.t") - F.col(order)
    pick = F.when(F.col("__next").isNull() | (back <= ahead), F.col("__prev")).otherwise(F.col("__next"))
    donor = F.coalesce(pick["v"], F.col(fallback)) if fallback else pick["v"]
    return n.withColumns({"donor": donor, "donor_at": pick["t"]}).drop("__v", "__prev", "__next")


def _near(frame: str, reach: int | None) -> tuple[Column, Column]:
    """(cells that a target looks into, cell that a donor is in): frames at most `reach` apart meet by equality."""
    if reach is None:
        return F.array(F.lit(0)), F.lit(0)
    cell = F.floor(F.col(frame) / reach)
    return F.sequence(cell - 1, cell + 1), cell


def _donor_ranks(targets: DataFrame, words: DataFrame, frames: DataFrame, weight: float, wanted: Column, reach: int | None) -> DataFrame:
    """recording, frame, donor, score, rank: for the frames of `targets` (bitmaps) the donors for which `wanted` holds, best first. Overlaps are bit counts, summed by pair
    before they move."""
    looks, lies = _near("frame", reach)
    sizes = targets.groupBy("recording", "frame").agg(F.sum(F.bit_count("bits")).alias("n")).withColumn("cell", F.explode(looks))
    pairs = sizes.join(frames.select("recording", lies.alias("cell"), F.col("frame").alias("donor")), ["recording", "cell"]).where(wanted)
    there = words.select("recording", "word", lies.alias("cell"), F.col("frame").alias("donor"), F.col("bits").alias("there"))
    both = targets.withColumn("cell", F.explode(looks)).join(there, ["recording", "word", "cell"]).where(wanted)
    both = both.groupBy("recording", "frame", "donor").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("there")))).alias("both"))
    score = F.coalesce(F.col("both"), F.lit(0)) / F.col("n") + weight * F.abs(F.col("frame") - F.col("donor"))
    scored = pairs.join(both, ["recording", "frame", "donor"], "left").select("recording", "frame", "donor", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("recording", "frame").orderBy("score", "donor")))


def _lend(asked: DataFrame, words: DataFrame, ranks: DataFrame) -> DataFrame:
    """recording, frame, word, bit, best (score, donor): for each bit of `asked` the best of its frame's donors in which it is valid, null if it is in none."""
    there = words.select("recording", "word", F.col("frame").alias("donor"), F.col("bits").alias("there"))
    offers = asked.join(ranks.select("recording", "frame", "donor", "score"), ["recording", "frame"], "left").join(there, ["recording", "donor", "word"], "left")
    offer = F.when(F.col("donor").isNotNull(), F.struct("score", "donor", F.coalesce("there", F.lit(0).cast("long")).alias("there")))
    listed = offers.groupBy("recording", "frame", "word", "bits").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    bits = listed.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1L) = 1L)")))
    first = F.expr("get(filter(offers, o -> (shiftrightunsigned(o.there, bit) & 1L) = 0L), 0)")
    return bits.select("recording", "frame", "word", "bit", first.alias("best")).withColumn("best", F.when(F.col("best").isNotNull(), F.struct("best.score", "best.donor")))


def _bitmaps(bits: DataFrame) -> DataFrame:
    return bits.groupBy("recording", "frame", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def ranked_donors(invalid: DataFrame, frames: DataFrame, weight: float = 0.002, first: int = 8) -> DataFrame:
    """For each (recording, target frame, pixel) that is invalid: the best donor frame in which the pixel is valid.

    invalid: recording, frame, pixel (whole numbers but the recording). frames: recording, frame. Donors rank by the share of the target's invalid pixels that are invalid
    there too plus weight * distance, then by frame. Columns: recording, frame, pixel, donor, score. Repeated rows count once, rows with a null not at all; pixels that are
    valid nowhere else have no row.

    Invalid pixels are bitmaps of 64 to a row, and shares bit counts of their intersections. A share is 1 at most, so frames more than 1 / weight apart only meet for pixels
    that no nearer donor serves at a score under theirs. The `first` best donors are asked for all pixels, the others for what these leave.
    """
    reach = math.ceil(1 / weight) if weight > 0 else None
    place = F.col("pixel").cast("long")
    words = cut(_bitmaps(invalid.dropna(subset=["recording", "frame", "pixel"]).select("recording", "frame", F.floor(place / 64).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))))
    every = frames.select("recording", "frame").dropna().distinct()
    gap = F.abs(F.col("frame") - F.col("donor"))
    ranks = cut(_donor_ranks(words, words, every, weight, gap > 0 if reach is None else gap.between(1, reach), reach))
    served = cut(_lend(words, words, ranks.where(F.col("rank") <= first)))
    more = cut(_lend(_bitmaps(served.where("best is null")), words, ranks.where(F.col("rank") > first)))
    best = served.where("best is not null").unionByName(more)
    if reach is not None:
        settled = F.coalesce(F.col("best.score") < weight * (reach + 1), F.lit(False))
        left = cut(best.where(~settled))
        best = best.where(settled)
        if not left.isEmpty():
            asked = _bitmaps(left)
            of_frames = words.join(asked.select("recording", "frame").distinct(), ["recording", "frame"], "left_semi")
            far = _lend(asked, words, _donor_ranks(of_frames, words, every, weight, gap > reach, None))
            best = best.unionByName(left.unionByName(far).groupBy("recording", "frame", "word", "bit").agg(F.min("best").alias("best")))
    return best.where("best is not null").select("recording", "frame", (F.col("word") * 64 + F.col("bit")).alias("pixel"), F.col("best.donor").alias("donor"), F.col("best.score").alias("score"))


# Smoothing


def centered_median(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str | None = None) -> DataFrame:
    """Median of known values over width // 2 rows before and width - width // 2 - 1 after, cut at the ends."""
    return df.withColumn(out or value, F.percentile(value, 0.5).over(over(keys, order, width // 2, width - width // 2 - 1)))


def same_track_median(df: DataFrame, keys: list[str], order: str, value: str, track: str, radius: int, out: str) -> DataFrame:
    """Median over the rows within `radius` that are of the same track as this one."""
    near = F.collect_list(F.struct(F.col(track).alias("k"), F.col(value).alias("v"))).over(over(keys, order, radius, radius))
    own = F.array_sort(F.transform(F.filter("__near", lambda x: x["k"].eqNullSafe(F.col(track)) & x["v"].isNotNull()), lambda x: x["v"]))
    n = F.size("__own")
    middle = (F.col("__own")[F.floor((n - 1) / 2).cast("int")] + F.col("__own")[F.floor(n / 2).cast("int")]) / 2
    return df.withColumn("__near", near).withColumn("__own", own).withColumn(out, F.when(n > 0, middle)).drop("__near", "__own")


def centered_prior(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str = "prior") -> DataFrame:
    """0.7 * median + 0.3 * 70 % quantile over a centred window."""
    w = over(keys, order, width // 2, width // 2)
    return df.withColumn(out, 0.7 * F.percentile(value, 0.5).over(w) + 0.3 * F.percentile(value, 0.7).over(w))


def scale_clip(df: DataFrame, keys: list[str], order: str, value: str, width: int, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Centred median, held within [low, high] times the partition's median."""
    mid = F.percentile(value, 0.5).over(whole(keys))
    smooth = F.percentile(value, 0.5).over(over(keys, order, width // 2, width // 2))
    return df.withColumn(f"{value}_scaled", F.least(F.greatest(smooth, low * mid), high * mid))


def savgol_weights(window: int, poly: int) -> np.ndarray:
    """Row i: the weights that give the polynomial fit over a window its value at place i."""
    x = np.arange(window) - window // 2
    a = np.vander(x, poly + 1, increasing=True)
    return a @ np.linalg.pinv(a)


#: Rows of a key that one task smooths at once.
BLOCK = 1 << 16


def fill_over_blocks(df: DataFrame, keys: list[str], value: str, block: int, index: str = "__i") -> DataFrame:
    """df with value as doubles, gaps (null or NaN) linear by row number and the nearest value at the ends; null where a key has none. A block of rows looks into itself, and
    at one row of each other block for what it lacks."""
    v = F.col(value).cast("double")
    cut_up = df.withColumn("__b", F.floor(F.col(index) / block)).withColumn("__known", F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.col(index).alias("i"), v.alias("v"))))
    ends = cut_up.groupBy(*keys, "__b").agg(F.max("__known").alias("last"), F.min("__known").alias("first"))
    w = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(
        *keys, "__b", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    both = join_same(cut_up, ends, [*keys, "__b"])
    own = Window.partitionBy(*keys, "__b").orderBy(index)
    back = F.coalesce(F.last("__known", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "__before")
    ahead = F.coalesce(F.first("__known", ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing)), "__after")
    p, n = F.col("__p"), F.col("__n_")
    line = p["v"] + (n["v"] - p["v"]) * (F.col(index) - p["i"]) / (n["i"] - p["i"])
    filled = F.when(F.col("__known").isNotNull(), F.col("__known.v")).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))
    return both.withColumns({"__p": back, "__n_": ahead}).withColumn(value, filled).drop("__b", "__known", "__before", "__after", "__p", "__n_")


def median_then_savgol(df: DataFrame, keys: list[str], order: str, value: str, window: int, poly: int = 2, median: int = 1, block: int = BLOCK) -> DataFrame:
    """Interpolate, median with zeros beyond the ends, then Savitzky-Golay; the ends take the fit of the first and last window. Adds <value>_smooth, null in a key without values.

    The window is cut to the odd number that fits the key, and smoothing is left out below poly + 2 rows. Rows are numbered over ranges and smoothed in blocks with as many
    neighbours on both sides as the filters reach, so a long key is spread over tasks. The weights of every window and place are a table of window**2 rows at most.
    """
    out, reach = f"{value}_smooth", median // 2 + window - 1
    rows = numbered(df.withColumn("__v", F.col(value)), keys, [order], "__i", "__n")
    halo = with_halo(fill_over_blocks(rows, keys, "__v", block), "__i", reach, reach, block)
    near = lambda r: Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-r, r)
    width = 2 * (median // 2) + 1
    if width > 1:
        some = F.collect_list("__v").over(near(width // 2))
        halo = halo.withColumn("__some", some).withColumn("__v", F.when(F.col("__v").isNotNull(), F.array_sort(F.concat("__some", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("__some"))))[width // 2])).drop("__some")
    size = F.least(F.lit(window), F.col("__n") - 1 + F.col("__n") % 2).cast("int")
    size = size - 1 + size % 2
    first = F.least(F.greatest(F.col("__i") - F.floor(F.col("__size") / 2), F.lit(0)), F.col("__n") - F.col("__size"))
    halo = halo.withColumns({"__size": size, "__all": F.collect_list("__v").over(near(window - 1))}).where("__own").withColumn("__first", first)
    halo = halo.withColumns({"__at": (F.col("__i") - F.col("__first")).cast("int"), "__skip": (F.col("__first") - F.greatest(F.lit(0), F.col("__i") - (window - 1))).cast("int")})
    fits = [(n, i, [float(x) for x in row]) for n in range(1, window + 1, 2) if n >= poly + 2 for i, row in enumerate(savgol_weights(n, poly))]
    weights = df.sparkSession.createDataFrame(fits or [(0, 0, [0.0])], "__size int, __at int, __w array<double>")
    both = halo.join(F.broadcast(weights), ["__size", "__at"], "left")
    fit = F.aggregate(F.zip_with(F.slice("__all", F.col("__skip") + 1, F.greatest(F.col("__size"), F.lit(1))), "__w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.when(F.col("__w").isNull() | F.col("__v").isNull(), F.col("__v")).otherwise(fit).alias(out))


def gaussian_smooth(df: DataFrame, keys: list[str], order: str, value: str, sigma: float, out: str = "smooth", block: int = BLOCK) -> DataFrame:
    """df with index, n and the Gaussian mean over four sigma on both sides, ends mirrored; null and NaN are 0. In blocks with their neighbours."""
    r = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    halo = with_halo(numbered(df.withColumn("__v", v), keys, [order]), "index", r, r, block)
    halo = halo.withColumn("__all", F.collect_list("__v").over(Window.partitionBy(*keys, "__block").orderBy("index").rowsBetween(-r, r))).where("__own")
    mirrored = "cast(least(pmod(index + k - {r}, 2 * n), 2 * n - 1 - pmod(index + k - {r}, 2 * n)) - greatest(0, index - {r}) as int)".format(r=r)
    weights = F.array(*[F.lit(float(w)) for w in kernel / kernel.sum()])
    total = F.expr(f"aggregate(transform(__w, (w, k) -> w * __all[{mirrored}]), 0D, (a, x) -> a + x)")
    return halo.withColumn("__w", weights).withColumn(out, total).drop("__v", "__block", "__own", "__all", "__w")


def quaternion_unwrap(df: DataFrame, keys: list[str], order: str, quat: str) -> DataFrame:
    """Signs flipped so that neighbouring quaternions don't point apart, each of length 1. An exact zero product starts anew with the sign as given."""
    last = F.lag(quat).over(over(keys, order))
    dot = F.aggregate(F.zip_with(quat, last, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    mark = df.withColumn("__dot", F.coalesce(dot, F.lit(0.0))).withColumn("__part", island(F.col("__dot") == 0, keys, order))
    turns = F.sum((F.col("__dot") < 0).cast("int")).over(up_to([*keys, "__part"], order))
    size = F.sqrt(F.aggregate(quat, F.lit(0.0), lambda a, x: a + x * x))
    sign = F.when(F.col("__turns") % 2 == 1, -1.0).otherwise(1.0)
    return mark.withColumn("__turns", turns).withColumn("__size", size).withColumn(quat, F.transform(quat, lambda x: sign * x / F.col("__size"))).drop("__dot", "__part", "__turns", "__size")


def temporal_majority(df: DataFrame, keys: list[str], order: str, flag: str, radius: int) -> DataFrame:
    """True if more than half of the rows within `radius` are."""
    w = over(keys, order, radius, radius)
    return df.withColumn(flag, F.sum(F.col(flag).cast("int")).over(w) * 2 > F.count(F.lit(1)).over(w))


# Labels


def boundary_ambiguous(df: DataFrame, keys: list[str], order: str, label: str, radius: int, out: str = "ambiguous") -> DataFrame:
    """Labelled rows (label >= 0) that have another label within `radius` rows."""
    w, known = over(keys, order, radius, radius), F.when(F.col(label) >= 0, F.col(label))
    return df.withColumn(out, F.coalesce((F.col(label) >= 0) & (F.min(known).over(w) != F.max(known).over(w)), F.lit(False)))


def tolerant_correct(df: DataFrame, keys: list[str], order: str, label: str, prediction: str, radius: int, out: str = "correct") -> DataFrame:
    """Labelled rows whose prediction is the label of some labelled row within `radius`."""
    near = F.collect_set(F.when(F.col(label) >= 0, F.col(label))).over(over(keys, order, radius, radius))
    return df.withColumn(out, F.coalesce((F.col(label) >= 0) & F.array_contains(near, F.col(prediction)), F.lit(False)))


def best_epoch(history: DataFrame, keys: list[str], order: str, score: str, patience: int, min_delta: float = 0.0, min_epochs: int = 0) -> DataFrame:
    """keys, best_epoch (first of the best scores), best_score, stop_epoch: the first epoch, min_epochs at least, with `patience` epochs since the last that beat all
    before by more than min_delta; null if never."""
    before = F.max(score).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("__better", before.isNull() | (F.col(score) > before + min_delta))
    h = h.withColumn("__since", F.col(order) - F.last(F.when(F.col("__better"), F.col(order)), ignorenulls=True).over(up_to(keys, order)))
    stop = F.min(F.when((F.col("__since") >= patience) & (F.col(order) >= min_epochs), F.col(order)))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("e")))
    return h.groupBy(*keys).agg(best.alias("b"), stop.alias("stop_epoch")).select(*keys, (-F.col("b.e")).alias("best_epoch"), F.col("b.s").alias("best_score"), "stop_epoch")


# State: one pass over the sorted rows of a key


def scan(df: DataFrame, keys: list[str], order: str, values: list[str], start: Callable[[], object], step: Callable, out: list[tuple[str, pa.DataType]]) -> DataFrame:
    """keys, order and `out`: step(state, *values) gives (next state, values of out) for each row in order; start() is a key's first state.

    Rows are dealt out by key and sorted once, then pass by in Arrow batches: time grows with the rows, and of a key no more than the state is held.
    """
    kinds = [(k, df.schema[k].dataType) for k in [*keys, order]]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds] + [T.StructField(n, from_arrow_type(t)) for n, t in out])
    n_keys = len(keys)

    def run(batches):
        key, state = None, None
        for batch in batches:
            names = list(zip(*[c.to_pylist() for c in batch.columns[:n_keys]], strict=True)) if n_keys else [()] * batch.num_rows
            rows = []
            for own, row in zip(names, zip(*[c.to_pylist() for c in batch.columns[n_keys + 1 :]], strict=True), strict=True):
                if own != key:
                    key, state = own, start()
                state, made = step(state, *row)
                rows.append(made)
            made = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keys + 1], *(pa.array(x, t) for x, (_, t) in zip(made, out, strict=True))], names=[*keys, order, *(n for n, _ in out)])

    sorted_rows = df.select(*keys, order, *values).repartition(*keys).sortWithinPartitions(*keys, order, *values) if keys else df.select(order, *values).repartition(1).sortWithinPartitions(order, *values)
    return sorted_rows.mapInArrow(run, schema)


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, on: float, off: float, min_on: int, hold: int) -> DataFrame:
    """keys, order, active: on after min_on rows in a row at `on` or more (these rows included), off after more than `hold` rows in a row under `off`. Values that aren't finite are 0.

    As off <= on, a row at `on` ends every run under `off` and the other way round; so the state is what the last event said: a run long enough to switch on, or one
    long enough to switch off. Windows of one sort.
    """
    if off > on:
        raise ValueError("off must not be above on")
    x = F.col(value).cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    so_far, here = up_to(keys, order), over(keys, order)
    rank = F.row_number().over(here)
    run = lambda broken: F.col("__k") - F.coalesce(F.last(F.when(broken, F.col("__k")), ignorenulls=True).over(so_far), F.lit(0))
    out = df.select(*keys, order, x.alias("__x")).withColumn("__k", rank).withColumns({"__above": run(F.col("__x") < on), "__below": run(F.col("__x") >= off)})
    event = F.when(F.col("__above") >= min_on, True).when(F.col("__below") > hold, False)
    out = out.withColumn("__on", F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(False)))
    out = out.withColumn("__begins", F.col("__on") & ~F.coalesce(F.lag("__on").over(here), F.lit(False)))
    return out.select(*keys, order, (F.col("__on") | F.coalesce(F.max("__begins").over(over(keys, order, 0, max(0, min_on - 1))), F.lit(False))).alias("active"))


def new_keys(batch: pa.RecordBatch, last: pa.RecordBatch | None, names: list[str]) -> np.ndarray:
    """Which rows have another key than the row before them; last: the row before the first."""
    out = np.zeros(batch.num_rows, bool)
    for n in names:
        col = pa.chunked_array([*([] if last is None else [last.column(n)]), batch.column(n)]).combine_chunks()
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[batch.num_rows - len(a) :] |= np.asarray(differs)
    if last is None and batch.num_rows:
        out[0] = True
    return out


def _parts(batches, keys: list[str]):
    """(part, batch, new): batches cut where a part ends, and which rows begin a key within their part."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.asarray(batch.column("__part"))
        new = new_keys(batch, last, ["__part", *keys])
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[i]), batch.slice(i, j - i), new[i:j]
        last = batch.slice(batch.num_rows - 1, 1)


def _floats(col: pa.Array) -> np.ndarray:
    return np.asarray(col.to_numpy(zero_copy_only=False), float)


def carried(ends: list, start, follow):
    """{part: state} that the first key of a part brings along. ends: (part, first key, last key, the last key's map over the part), part by part; follow(map, state)."""
    out, state, key = {}, start, None
    for k, (part, first, last, own) in enumerate(sorted(ends, key=lambda e: e[0])):
        if k and first == key:
            out[part] = state
        state, key = follow(own, out.get(part, start) if first == last else start), last
    return out


def ema_dual_threshold(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.65, on: float = 0.40, off: float = 0.28) -> DataFrame:
    """keys, order, ema, active: ema = alpha * x + (1 - alpha) * ema from 0; active if at `off` or more while active, else at `on` or more. Values that aren't finite are 0.

    A parallel prefix scan: rows are dealt out by ranges of key and order, a range is one affine map of its last key's average, and the maps of the ranges, one row each,
    are composed; then every range runs from its own start. The switch goes likewise, as a map of two states: both outcomes are found, and the ranges' last rows tell which
    holds. So a key of all rows is spread over all tasks, and no row is a step of Python.
    """
    plain = df.select(*keys, order, F.col(value).cast("double").alias("__x"))
    rows = in_ranges(plain, keys, [order, "__x"]).repartition("__part").sortWithinPartitions("__part", "__at")
    key, kind = F.struct(*keys, F.lit(0).alias("__none")), pa.schema([("__part", pa.int32()), ("slope", pa.float64()), ("shift", pa.float64())])

    def summary(batches):
        now, slope, shift = None, 1.0, 0.0
        for part, batch, new in _parts(batches, keys):
            if part != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"__part": [now], "slope": [slope], "shift": [shift]}, schema=kind)
                now, slope, shift = part, 1.0, 0.0
                new[0] = False
            x, begin = _floats(batch.column("__x")), 0
            if new.any():
                begin, slope, shift = int(np.flatnonzero(new)[-1]), 1.0, 0.0
            run = kernels.ema_run(x[begin:], np.zeros(len(x) - begin, bool), alpha, shift)
            slope, shift = slope * (1 - alpha) ** len(run), float(run[-1])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"__part": [now], "slope": [slope], "shift": [shift]}, schema=kind)

    ends = rows.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"))
    ends = ends.join(rows.mapInArrow(summary, "__part int, slope double, shift double"), "__part").collect()  # a row a range
    averages = carried([(r["__part"], r["first"], r["last"], (r["slope"], r["shift"])) for r in ends], 0.0, lambda m, s: m[0] * s + m[1])
    key_kinds = ", ".join(f"`{n}` {plain.schema[n].dataType.simpleString()}" for n in [*keys, order])

    def apply(batches):
        now, ema, no, yes = None, 0.0, False, False
        for part, batch, new in _parts(batches, keys):
            if part != now:
                now, ema, no, yes = part, averages.get(part, 0.0), False, True
                new[0] = False
            e = kernels.ema_run(_floats(batch.column("__x")), new, alpha, ema)
            never, ever = kernels.switch_run(e, new, on, off, no), kernels.switch_run(e, new, on, off, yes)
            ema, no, yes = float(e[-1]), bool(never[-1]), bool(ever[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in [*keys, order, "__part", "__at"]], pa.array(e), pa.array(never), pa.array(ever)], names=[*keys, order, "__part", "__at", "ema", "no", "yes"])

    both = cut(rows.mapInArrow(apply, f"{key_kinds}, __part int, __at long, ema double, no boolean, yes boolean"))
    tails = both.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"), F.max_by(F.struct("no", "yes"), "__at").alias("m")).collect()
    states = carried([(r["__part"], r["first"], r["last"], r["m"]) for r in tails], False, lambda m, s: m["yes"] if s else m["no"])
    on_parts = [p for p, s in states.items() if s]
    return both.select(*keys, order, "ema", F.when(F.col("__part").isin(on_parts), F.col("yes")).otherwise(F.col("no")).alias("active"))


def rate_limit(df: DataFrame, keys: list[str], order: str, value: str, step_limit: float, low: float, high: float) -> DataFrame:
    """keys, order, limited: the first finite value as it is, then each moves at most step_limit from the last output and stays within [low, high]. Null, NaN and infinite
    values keep the last output, within the bounds; before the first finite value the output is null."""
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in [*keys, order])

    def run(batches):
        before, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = _floats(batch.column("__x")), []
            edges = [0, *[i for i in np.flatnonzero(new_keys(batch, before, keys)).tolist() if i], batch.num_rows]
            if before is None or keys and new_keys(batch.slice(0, 1), before, keys)[0]:
                last = None
            for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                made, last = kernels.rate_run(x[i:j], step_limit, low, high, None if k else last)
                out += made
            before = batch.slice(batch.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in [*keys, order]], pa.array(out, pa.float64())], names=[*keys, order, "limited"])

    plain = df.select(*keys, order, F.col(value).cast("double").alias("__x"))
    dealt = plain.repartition(*keys) if keys else plain.repartition(1)
    return dealt.sortWithinPartitions(*keys, order, "__x").mapInArrow(run, f"{kinds}, limited double")


def far_apart(at: list[int], height: list[float], distance: int) -> list[bool]:
    """Which peaks stay when, from the highest down (of equal ones the later first), each takes out those less than `distance` away."""
    keep = [True] * len(at)
    for i in sorted(range(len(at)), key=lambda i: (height[i], i), reverse=True):
        if keep[i]:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(at) and abs(at[j] - at[i]) < distance:
                    keep[j] = False
                    j += step
    return keep


def prominences(height: list[float], low: list[float]) -> list[float]:
    """Height of each peak over the higher of its two bases; low[k] is the least value between peak k - 1 and peak k. A stack of falling heights: each peak goes in and out once."""

    def base(heights, lows):
        out, stack = [], []
        for h, m in zip(heights, lows, strict=True):
            while stack and stack[-1][0] <= h:
                m = min(m, stack.pop()[1])
            stack.append((h, m))
            out.append(m)
        return out

    left, right = base(height, low[:-1]), base(height[::-1], low[:0:-1])[::-1]
    return [h - max(a, b) for h, a, b in zip(height, left, right, strict=True)]


def find_episodes(df: DataFrame, keys: list[str], order: str, value: str, sigma: float = 2.0, distance: int = 5, prominence: float = 0.1, most: int = 10, valid: str | None = None, block: int = BLOCK) -> DataFrame:
    """keys, episode, start_frame, end_frame, peak: Gaussian smoothing (ends mirrored), local maxima (the middle of a flat top) `distance` apart at least and `prominence` above
    their surroundings, those at rows that aren't valid left out, the `most` most prominent ones, parted halfway between neighbours.

    Smoothing goes in blocks with their neighbours. What a key's task then holds is its peaks and the valleys between them, not its rows; the work on these is linear but
    for one sort.
    """
    w = over(keys, "index")
    kept = gaussian_smooth(df.select(*keys, F.col(order).cast("long").alias("__t"), F.col(value).alias("__x"), (F.col(valid) if valid else F.lit(True)).alias("__ok")), keys, "__t", "__x", sigma, block=block)
    starts = kept.withColumn("__new", ~F.col("smooth").eqNullSafe(F.lag("smooth").over(w)))
    # a flat run by its first row; its middle row is its place
    runs = starts.where("__new").withColumns({"__up": F.lag("smooth").over(w) < F.col("smooth"), "__down": F.lead("smooth").over(w) < F.col("smooth"), "__end": F.coalesce(F.lead("index").over(w), F.col("n")) - 1})
    runs = runs.withColumn("__peak", F.coalesce(F.col("__up") & F.col("__down"), F.lit(False))).withColumn("__at", F.floor((F.col("index") + F.col("__end")) / 2))
    runs = runs.withColumn("__k", F.sum(F.col("__peak").cast("long")).over(up_to(keys, "index")))
    sides = runs.groupBy(*keys, "__k").agg(F.max(F.when(F.col("__peak"), F.col("__at"))).alias("at"), F.max(F.when(F.col("__peak"), F.col("smooth"))).alias("height"), F.min(F.when(~F.col("__peak"), F.col("smooth"))).alias("low"))
    # frames by row number: of the peaks, and of the key's ends
    spots = kept.select(*keys, "index", "n", "__t", "__ok")
    sides = join_same(sides, spots.select(*keys, F.col("index").alias("at"), F.col("__ok").alias("ok")), [*keys, "at"], "left")
    names = [f"k{i}" for i in range(len(keys))]
    kind = ", ".join([*(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)), "episode int, first long, last long, peak_at long"])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__k")
        low, peaks = part["low"].tolist(), part[part["__k"] > 0]
        at, height, ok = peaks["at"].astype(int).tolist(), peaks["height"].tolist(), peaks["ok"].tolist()
        rise = prominences(height, low) if at else []
        good = [i for i, far in enumerate(far_apart(at, height, distance)) if far and rise[i] >= prominence and ok[i]]
        good = sorted(sorted(good, key=lambda i: (rise[i], i), reverse=True)[:most])
        rows = []
        for k, i in enumerate(good):
            a = (at[good[k - 1]] + at[i]) // 2 + 1 if k else 0
            b = (at[i] + at[good[k + 1]]) // 2 if k + 1 < len(good) else -1
            rows.append((*part[keys].iloc[0], k, a, b, at[i]))
        return pd.DataFrame(rows, columns=[*names, "episode", "first", "last", "peak_at"])

    found = sides.groupBy(*keys).applyInPandas(choose, kind).withColumnsRenamed(dict(zip(names, keys, strict=True)))
    asked = found.select(*keys, "episode", F.explode(F.map_from_arrays(F.array(F.lit("start_frame"), F.lit("end_frame"), F.lit("peak")), F.array("first", "last", "peak_at"))).alias("what", "index"))
    at = spots.select(*keys, "index", "__t").unionByName(spots.where("index = n - 1").select(*keys, F.lit(-1).cast("long").alias("index"), "__t"))
    named = join_same(asked, at, [*keys, "index"])
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("__t"))).alias(what)
    return named.groupBy(*keys, "episode").agg(pick("start_frame"), pick("end_frame"), pick("peak"))


def bridge_mask_gaps(mask: DataFrame, max_gap: int, radius: int, eligible: DataFrame | None = None) -> DataFrame:
    """Pixels that a gap of at most max_gap frames parts from the same label on both sides, within `radius` of a pixel there, are added: recording, label, frame, y, x.

    mask: recording, label, frame, y, x (sparse). Frames of a gap come from the gap's own length, so rows grow with max_gap * disk, not with the recording.
    """
    seen = mask.select("recording", "label", "frame").distinct()
    following = F.lead("frame").over(Window.partitionBy("recording", "label").orderBy("frame"))
    gaps = seen.withColumn("after", following).where((F.col("after") - F.col("frame") > 1) & (F.col("after") - F.col("frame") - 1 <= max_gap)).withColumnRenamed("frame", "before")
    gaps = gaps.withColumn("frame", F.explode(F.sequence(F.col("before") + 1, F.col("after") - 1)))
    moves = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    disk = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves])).alias("m")
    grown = mask.select("recording", "label", "frame", "y", "x", disk).select("recording", "label", "frame", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).distinct()
    side = lambda name: gaps.select("recording", "label", "frame", F.col(name).alias("side")).join(grown.withColumnRenamed("frame", "side"), ["recording", "label", "side"]).select("recording", "label", "frame", "y", "x")
    added = side("before").intersect(side("after"))
    if eligible is not None:
        added = added.join(eligible, ["recording", "frame", "y", "x"], "left_semi").select("recording", "label", "frame", "y", "x")
    return mask.select("recording", "label", "frame", "y", "x").union(added).distinct()
