"""Joins on time, intervals, offsets and keys. Equal keys always carry the join, so that Spark shuffles or broadcasts by size; order and ranges are settled after it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.scalars import box_iou, normalize_phrase
from timeloom.operators.sequence import scan
from timeloom.plans.ranges import join_same


class JoinError(ValueError):
    """A strict join found rows without a partner."""


def nearest_candidates(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row nearest in time, the earlier of two equally near: keys, left_id, left_time, right_id, right_time.

    One sort of both streams together instead of a range join: the nearest row is the last one before or the first one after.
    """
    a = left.select(*keys, F.col(time).alias("t"), F.col(left_id).alias("l"), F.lit(None).cast(right.schema[right_id].dataType).alias("r"))
    b = right.select(*keys, F.col(time).alias("t"), F.lit(None).cast(left.schema[left_id].dataType).alias("l"), F.col(right_id).alias("r"))
    both = a.unionByName(b)
    point = F.when(F.col("r").isNotNull(), F.struct("t", "r"))
    back = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("r").isNull(), F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("r").isNotNull(), F.col("r")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"__p": F.last(point, ignorenulls=True).over(back), "__n": F.first(point, ignorenulls=True).over(ahead)}).where("l is not null")
    gap = lambda c: F.abs(c["t"].cast("double") - F.col("t").cast("double"))
    pick = F.when(F.col("__n").isNull() | (gap(F.col("__p")) <= gap(F.col("__n"))), F.col("__p")).otherwise(F.col("__n"))
    return both.select(*keys, F.col("l").alias(left_id), F.col("t").alias("left_time"), pick["r"].alias(right_id), pick["t"].alias("right_time"))


def pair_nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, right_id: str, max_delta: float) -> DataFrame:
    """Nearest pairs within max_delta (in the unit of time; seconds for timestamps), each right row once and in rising order; the first left row that wants it gets it.

    On strictly increasing times the wanted row never goes back, so the first claim of each right row is what a greedy scan accepts. Adds delta = right - left.
    """
    near = nearest_candidates(left, right, keys, time, left_id, right_id).where(F.col(right_id).isNotNull())
    near = near.withColumn("delta", F.col("right_time").cast("double") - F.col("left_time").cast("double")).where(F.abs("delta") <= max_delta)
    first = F.row_number().over(Window.partitionBy(*keys, right_id).orderBy("left_time", left_id))
    return near.withColumn("__k", first).where("__k = 1").drop("__k")


def pair_nearest_strict(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, right_id: str, max_delta: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, violations): left rows without a partner of their own within max_delta are violations; check() raises on them."""
    pairs = pair_nearest(left, right, keys, time, left_id, right_id, max_delta)
    return pairs, left.select(*keys, left_id).join(pairs, [*keys, left_id], "left_anti").withColumn("reason", F.lit("no_unique_match_within_tolerance"))


def check(violations: DataFrame) -> None:
    rows = violations.limit(5).collect()
    if rows:
        raise JoinError("; ".join(str(r.asDict()) for r in rows))


def pair_four_way(pairs: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], max_delta: float) -> DataFrame:
    """Pairs (keys, output_index, t1, t2) kept only if both sides have a valid depth row of their own.

    first, second: keys, output_index, depth_id, depth_time: the nearest depth row of each side. Adds depth_1, depth_2, accepted, reasons (array). Depth rows of accepted
    pairs rise strictly on both sides; the state moves on only with an accepted pair, so this is a fold over each key's pairs.
    """
    both = pairs.join(first.select(*keys, "output_index", F.col("depth_id").alias("d1"), F.col("depth_time").alias("dt1")), [*keys, "output_index"], "left")
    both = both.join(second.select(*keys, "output_index", F.col("depth_id").alias("d2"), F.col("depth_time").alias("dt2")), [*keys, "output_index"], "left")
    far = lambda d, a, b: d.isNull() | (F.abs(a.cast("double") - b.cast("double")) > max_delta)
    row = F.struct(
        F.col("d1").cast("long").alias("d1"), F.col("d2").cast("long").alias("d2"),
        far(F.col("d1"), F.col("dt1"), F.col("t1")).alias("far1"), far(F.col("d2"), F.col("dt2"), F.col("t2")).alias("far2"),
    )

    def step(last, row):
        own, again = (row["d1"], row["d2"]), []
        for n in (0, 1):
            if row[f"far{n + 1}"]:
                again.append(f"camera_{n + 1}_depth_delta")
            elif last[n] is not None and own[n] <= last[n]:
                again.append(f"camera_{n + 1}_depth_non_unique")
        return last if again else own, (*own, not again, again)

    kinds = [("depth_1", pa.int64()), ("depth_2", pa.int64()), ("accepted", pa.bool_()), ("reasons", pa.list_(pa.string()))]
    return scan(both.select(*keys, F.col("output_index").cast("long").alias("output_index"), row.alias("row")), keys, "output_index", ["row"], lambda: (None, None), step, kinds)


def nearest_center(frames: DataFrame, tokens: DataFrame, keys: list[str], frame: str = "frame", center: str = "center", token: str = "token_index") -> DataFrame:
    """keys, frame, token: the token whose centre is nearest, the lower token of two. One sort of frames and centres together; keys without tokens have no rows."""
    asked = frames.select(*keys, F.col(frame).cast("long").alias("__t"), F.col(frame).alias("__frame"))
    centers = tokens.select(*keys, F.col(center).cast("long").alias("__t"), F.col(token).alias("__token"))
    near = nearest_candidates(asked, centers, keys, "__t", "__frame", "__token").where("__token is not null")
    return near.select(*keys, F.col("__frame").alias(frame), F.col("__token").alias(token))


def segment_width(segments: DataFrame, start: str, end: str) -> float:
    """The mean length of segments, 1 at least: cut into cells of this width, all segments together are at most thrice as many rows, however uneven they are."""
    mean = segments.agg(F.avg(F.col(end).cast("double") - F.col(start).cast("double")).alias("w")).first()["w"]
    return max(1.0, mean or 1.0)


def cells(start: Column, end: Column, width: float) -> Column:
    """A row for each cell of time that a segment touches, so that a segment meets the rows and segments near it by equality."""
    return F.explode(F.when(start <= end, F.sequence(F.floor(start / width), F.floor(end / width))).otherwise(F.array().cast("array<bigint>")))


def interval_labels(frames: DataFrame, segments: DataFrame, keys: list[str], frame: str, start: str, end: str, label: str, position: str | None = None, missing=None) -> DataFrame:
    """frames with the label of the segment that covers them (ends included); where several do, the last by position (or start). Uncovered rows get `missing`. A null key is a key like any other."""
    rank = position or start
    width = segment_width(segments, start, end)
    part = segments.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(rank).alias("__rank"), F.col(label).alias("__label"), cells(F.col(start), F.col(end), width).alias("__cell"))
    key = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("f.__cell") == F.col("s.__cell"), F.col(f"f.{frame}").between(F.col("s.__s"), F.col("s.__e"))]
    hit = frames.select(*keys, frame, F.floor(F.col(frame) / width).alias("__cell")).distinct().alias("f").join(part.alias("s"), key)
    found = hit.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], F.col(f"f.{frame}").alias(frame)).agg(F.max_by("__label", "__rank").alias("__label"))
    return join_same(frames, found, [*keys, frame], "left").withColumn(label, F.coalesce("__label", F.lit(missing)) if missing is not None else F.col("__label")).drop("__label")


def offset_join(left: DataFrame, right: DataFrame, offsets: DataFrame, keys: list[str], frame: str, value: str, out: str, fill=None, outer: bool = True) -> DataFrame:
    """left with right's value at frame + offset (one offset for each key): filled where there is none if outer, else such rows go."""
    other = right.select(*keys, F.col(frame).alias("__at"), F.col(value).alias(out))
    want = left.join(offsets, keys).withColumn("__at", F.col(frame) + F.col("offset"))
    got = want.join(other, [*keys, "__at"], "left" if outer else "inner").drop("__at", "offset")
    return got.withColumn(out, F.coalesce(out, F.lit(fill))) if outer and fill is not None else got


def key_differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side ('first' or 'second'): keys that stand on one side only. Empty means that the sides match."""
    a, b = first.select(*keys).distinct().withColumn("__a", F.lit(True)), second.select(*keys).distinct().withColumn("__b", F.lit(True))
    return a.join(b, keys, "full_outer").where("__a is null or __b is null").select(*keys, F.when(F.col("__b").isNull(), "first").otherwise("second").alias("side"))


def paired(first: DataFrame, second: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Rows of two runs with equal keys, side by side; other columns get the suffixes."""
    name = lambda df, s: df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])
    return name(first, suffixes[0]).join(name(second, suffixes[1]), keys)


def sidecar_join(base: DataFrame, sidecar: DataFrame, keys: list[str], recording: str) -> tuple[DataFrame, DataFrame]:
    """(base with the sidecar's columns, violations): recordings whose rows in both differ in number, or that have no sidecar."""
    a, b = base.groupBy(recording).agg(F.count(F.lit(1)).alias("n_base")), sidecar.groupBy(recording).agg(F.countDistinct(*[k for k in keys if k != recording]).alias("n_sidecar"))
    bad = a.join(b, recording, "left").where("n_sidecar is null or n_sidecar <> n_base")
    return base.join(sidecar, keys, "left"), bad.withColumn("reason", F.when(F.col("n_sidecar").isNull(), "missing_sidecar").otherwise("row_count"))


def expand_tokens(predictions: DataFrame, mapping: DataFrame, keys: list[str], token: str = "token_index") -> DataFrame:
    """Every frame with its token's columns."""
    return mapping.join(predictions, [*keys, token])


def default_token_mapping(frames: DataFrame, tokens: DataFrame, keys: list[str], tubelet: int, frame: str = "frame") -> DataFrame:
    """token_index = least(frame div tubelet, last token of the key)."""
    last = tokens.groupBy(*keys).agg(F.max("token_index").alias("__last"))
    return frames.join(last, keys).withColumn("token_index", F.least(F.floor(F.col(frame) / tubelet), F.col("__last"))).drop("__last")


def not_yet_done(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys (an id, or id and signature) aren't among those done."""
    return candidates.join(done, keys, "left_anti")


def priority_lookup(frames: DataFrame, by_metadata: DataFrame, by_name: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, dense_frame, source_frame) with path and rule: the metadata index at the dense frame, else the name index at the source frame, else at the dense one."""
    pick = lambda df, on, name: df.select(*keys, F.col("frame").alias(on), F.col("path").alias(name))
    out = frames.join(pick(by_metadata, "dense_frame", "__m"), [*keys, "dense_frame"], "left")
    out = out.join(pick(by_name, "source_frame", "__s"), [*keys, "source_frame"], "left").join(pick(by_name, "dense_frame", "__d"), [*keys, "dense_frame"], "left")
    rule = F.when(F.col("__m").isNotNull(), "metadata").when(F.col("__s").isNotNull(), "name_at_source").when(F.col("__d").isNotNull(), "name_at_dense")
    return out.withColumn("path", F.coalesce("__m", "__s", "__d")).withColumn("rule", rule).drop("__m", "__s", "__d")


def match_names(phrases: DataFrame, prompts: DataFrame, phrase: str = "phrase") -> DataFrame:
    """phrases with the best name of the dimension (name, prompt): equal phrases score 1000 + length, one within the other the shorter's length; ties go to the later name.

    The prompts are a small dimension; phrases that differ are matched once each.
    """
    p = phrases.select(phrase).distinct().withColumn("__p", normalize_phrase(F.col(phrase)))
    q = F.broadcast(prompts.select("name", normalize_phrase(F.col("prompt")).alias("__q")))
    hit = p.join(q, (F.length("__p") > 0) & (F.length("__q") > 0) & (F.contains("__p", "__q") | F.contains("__q", "__p")))
    score = F.when(F.col("__p") == F.col("__q"), 1000 + F.length("__q")).otherwise(F.least(F.length("__p"), F.length("__q")))
    best = hit.groupBy(phrase).agg(F.max(F.struct(score.alias("score"), "name")).alias("b")).select(phrase, F.col("b.name").alias("name"), F.col("b.score").alias("match_score"))
    return phrases.join(best, phrase, "left")


def suppress_duplicate_boxes(detections: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """Detections (keys, name, score, x0, y0, x1, y1) in falling score, without those that overlap a kept box of another name by IoU >= threshold. Frames are independent."""
    kind = "array<struct<less:double,name:string,x0:double,y0:double,x1:double,y1:double>>"
    box = F.struct((-F.col("score").cast("double")).alias("less"), F.col("name"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["name"] != b["name"]) & (box_iou(*[k[c] for c in ("x0", "y0", "x1", "y1")], *[b[c] for c in ("x0", "y0", "x1", "y1")]) >= threshold))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    got = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes")).withColumn("kept", F.aggregate("boxes", F.array().cast(kind), step))
    got = got.select(*keys, F.explode("kept").alias("b"))
    return got.select(*keys, "b.name", (-F.col("b.less")).alias("score"), "b.x0", "b.y0", "b.x1", "b.y1")


def knn_transfer(source: DataFrame, target: DataFrame, keys: list[str], k: int, sigma: float) -> DataFrame:
    """target (keys, target_id, x, y, z) with the weighted mean of `flag` over the k nearest source points of its group, weights exp(-d**2 / (2 sigma**2)).

    Groups (a frame and finger) hold tens of points; the pairing never leaves a group.
    """
    s = source.select(*keys, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z"), F.col("flag").cast("double").alias("__f"), F.col("source_id").alias("__id"))
    d2 = F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2) + F.pow(F.col("z") - F.col("__z"), 2)
    near = target.join(s, keys).withColumn("__d", d2).withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "target_id").orderBy("__d", "__id"))).where(F.col("__k") <= k)
    w = F.exp(-F.col("__d") / (2 * sigma * sigma))
    return near.groupBy(*keys, "target_id").agg(F.try_divide(F.sum(w * F.col("__f")), F.sum(w)).alias("value"))


def segment_matches(predicted: DataFrame, truth: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """predicted (keys, start_frame, end_frame, label; half-open ends) with iou and hit: the best truth segment of the same label, at `threshold` or more, not claimed by an
    earlier prediction."""
    t = truth.select(*keys, F.col("start_frame").alias("__s"), F.col("end_frame").alias("__e"), F.col("label").alias("label"))
    common = F.least("end_frame", "__e") - F.greatest("start_frame", "__s")
    union = F.greatest("end_frame", "__e") - F.least("start_frame", "__s")
    width = segment_width(truth, "start_frame", "end_frame")
    p = predicted.withColumn("__cell", cells(F.col("start_frame"), F.col("end_frame"), width))
    t = t.withColumn("__cell", cells(F.col("__s"), F.col("__e"), width))
    meets = [p[k].eqNullSafe(t[k]) for k in [*keys, "label", "__cell"]] + [p["start_frame"] < t["__e"], t["__s"] < p["end_frame"], p["__cell"] == F.floor(F.greatest(p["start_frame"], t["__s"]) / width)]  # in the first cell they share
    names = [*keys, "label", "start_frame", "end_frame"]
    both = p.join(t, meets).select(*[p[c] for c in names], "__s", "__e").withColumn("__iou", F.greatest(common, F.lit(0)) / union).select(*names, "__s", "__iou")
    both = both.unionByName(predicted.select(*names, F.lit(None).cast(truth.schema["start_frame"].dataType).alias("__s"), F.lit(0.0).alias("__iou")))
    best = both.groupBy(*keys, "label", "start_frame", "end_frame").agg(F.max(F.struct("__iou", (-F.col("__s")).alias("s"))).alias("b"))
    claim = Window.partitionBy(*keys, "label", "b.s").orderBy(F.col("b.__iou") < threshold, "start_frame")
    hit = (F.col("b.__iou") >= threshold) & (F.row_number().over(claim) == 1)
    return best.withColumn("hit", hit).select(*keys, "label", "start_frame", "end_frame", F.col("b.__iou").alias("iou"), "hit")


def paired_deltas(results: DataFrame, keys: list[str], variant: str, base: str, treated: str, metrics: list[str], support: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(deltas, violations): for each key, metric of `treated` less metric of `base`; keys with one variant only or other supports are violations."""
    one = lambda v: F.col(variant) == v
    sides = [F.max(F.when(one(v), F.col(m))).alias(f"{m}_{n}") for m in metrics for v, n in ((base, "base"), (treated, "treated"))]
    ns = [F.max(F.when(one(v), F.col(support))).alias(f"__n_{n}") for v, n in ((base, "base"), (treated, "treated"))] if support else []
    wide = results.where(F.col(variant).isin(base, treated)).groupBy(*keys).agg(*sides, *ns, F.countDistinct(variant).alias("__v"))
    bad = wide.where((F.col("__v") < 2) | (~F.col("__n_base").eqNullSafe(F.col("__n_treated")) if support else F.lit(False)))
    good = wide.join(bad, keys, "left_anti").withColumns({f"{m}_delta": F.col(f"{m}_treated") - F.col(f"{m}_base") for m in metrics})
    return good.drop("__v", "__n_base", "__n_treated"), bad.select(*keys)


def lookup_enrich(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """rows with the dimension's columns; rows of unknown keys go."""
    return rows.join(dimension, key)


def grounding_rank(detections: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Best detection of each segment: 2 exp(-4 distance / diagonal) + coverage + confidence, then the earlier box id.

    detections: keys, box_id, score, x0..y1. segments: keys, segment, cx, cy (contact point), rx0..ry1 (region), diagonal.
    """
    dx = F.greatest(F.col("x0") - F.col("cx"), F.lit(0.0), F.col("cx") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("cy"), F.lit(0.0), F.col("cy") - F.col("y1"))
    common = F.greatest(F.least("x1", "rx1") - F.greatest("x0", "rx0"), F.lit(0.0)) * F.greatest(F.least("y1", "ry1") - F.greatest("y0", "ry0"), F.lit(0.0))
    cover = F.coalesce(F.try_divide(common, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), F.lit(0.0))
    rank = 2 * F.exp(-4 * F.hypot(dx, dy) / F.col("diagonal")) + cover + F.col("score")
    best = detections.join(segments, keys).groupBy(*keys, "segment").agg(F.max(F.struct(rank.alias("rank"), (-F.col("box_id")).alias("b"))).alias("best"))
    return best.select(*keys, "segment", (-F.col("best.b")).alias("box_id"), F.col("best.rank").alias("rank"))


def split_overlap(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits; empty means that the splits are apart."""
    return train.select(key).intersect(validation.select(key))
