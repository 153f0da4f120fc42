"""Projections and filters: labels, sampling of frames, masks, depth order, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_index(df: DataFrame, labels: DataFrame, label: str = "label", out: str = "class") -> DataFrame:
    """df with the class number of its label; -1 if the vocabulary (label, idx) hasn't got it. Labels are compared trimmed."""
    dim = F.broadcast(labels.select(F.trim("label").alias("__l"), F.col("idx").alias(out)))
    return df.join(dim, F.trim(F.col(label)) == F.col("__l"), "left").drop("__l").withColumn(out, F.coalesce(out, F.lit(-1)))


def vocabulary(labels: list[str], spark) -> DataFrame:
    """(label, idx) in the given order; labels must be unique and not empty."""
    clean = [x.strip() for x in labels]
    if not clean or not all(clean) or len(set(clean)) != len(clean):
        raise ValueError("labels must be unique and not empty")
    return spark.createDataFrame(list(enumerate(clean)), "idx int, label string").select("label", "idx")


def mask_label(df: DataFrame, label: str, masked: int) -> DataFrame:
    """One class becomes -1."""
    return df.withColumn(label, F.when(F.col(label) == masked, -1).otherwise(F.col(label)))


def keep_labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label. Windows must be made before."""
    return df.where(F.col(label) >= 0)


def sample_tokens(recordings: DataFrame, keys: list[str], sample_fps: float, tubelet: int = 2, pad: bool = True) -> DataFrame:
    """keys, token_index, frames (array of `tubelet` frames), center. recordings: keys, num_frames, fps.

    Sample k is frame rint(k * fps / sample_fps), half to even, cut to the last frame, each frame once. A last token that isn't full repeats its last frame, or goes unless
    `pad`. center = floor(mean + 0.5).
    """
    most = F.floor((F.col("num_frames") - 1) * sample_fps / F.col("fps") + 1e-9)
    k = recordings.where("num_frames > 0").withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), most)))
    frames = k.select(*keys, F.least(F.rint(F.col("__k") * F.col("fps") / sample_fps).cast("long"), F.col("num_frames").cast("long") - 1).alias("frame")).distinct()
    n = frames.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1)
    got = n.groupBy(*keys, F.floor(F.col("__i") / tubelet).alias("token_index")).agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    got = got.withColumn("frames", F.concat("frames", F.array_repeat(F.element_at("frames", -1), F.lit(tubelet) - F.size("frames")))) if pad else got.where(F.size("frames") == tubelet)
    return got.withColumn("center", F.floor(F.aggregate("frames", F.lit(0.0), lambda a, x: a + x) / tubelet + 0.5))


def stride_filter(df: DataFrame, keys: list[str], frame: str, n: int, keep_last: bool = False) -> DataFrame:
    """Every n-th frame, and the key's last if asked for."""
    if not keep_last:
        return df.where(F.col(frame) % n == 0)
    marked = df.withColumn("__last", F.max(frame).over(Window.partitionBy(*keys)))
    return marked.where((F.col(frame) % n == 0) | (F.col(frame) == F.col("__last"))).drop("__last")


def prefix_trim(frames: DataFrame, annotated: DataFrame, keys: list[str], frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(frames of the annotated beginning, report: keys, available, num_frames, dropped, too_short). annotated: keys, num_frames."""
    n = frames.groupBy(*keys).agg((F.max(frame) + 1).alias("available"))
    report = annotated.join(n, keys, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    report = report.withColumns({"dropped": F.greatest(F.col("available") - F.col("num_frames"), F.lit(0)), "too_short": F.col("available") < F.col("num_frames")})
    return frames.join(annotated, keys).where(F.col(frame) < F.col("num_frames")).drop("num_frames"), report


def exclude_by_label(segments: DataFrame, keys: list[str], labels: list[str], label: str = "label") -> DataFrame:
    """keys, excluded: whether any label of the recording, without case, is one of those given."""
    return segments.groupBy(*keys).agg(F.coalesce(F.bool_or(F.lower(F.trim(label)).isin([x.lower() for x in labels])), F.lit(False)).alias("excluded"))


def status_filter(log: DataFrame, curation: DataFrame, status: str = "all") -> DataFrame:
    """log (id ..) with status (pending without curation) and clips; status: pending, curated, denied or all."""
    c = curation.groupBy("id").agg(F.first("status").alias("status"), F.max("clips").alias("clips"))
    out = log.join(c, "id", "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "clips": F.coalesce("clips", F.lit(0))})
    return out if status == "all" else out.where(F.col("status") == status)


def duration_filter(candidates: DataFrame, seen: DataFrame, limit: float) -> DataFrame:
    """candidates (id, duration) with reason: seen, too_long or null (take it)."""
    s = seen.select("id").distinct().withColumn("__s", F.lit(True))
    return candidates.join(s, "id", "left").withColumn("reason", F.when(F.col("__s"), "seen").when(F.col("duration") >= limit, "too_long")).drop("__s")


def valid_range(value: Column, low: float, high: float) -> Column:
    """The value if it is finite and within [low, high], else null."""
    return F.when(~F.isnan(value) & value.between(low, high), value)


def split_observations(modal: DataFrame, hand: DataFrame, keys: list[str], contact: DataFrame | None = None) -> DataFrame:
    """Pixels of the modal mask with kind: trusted (no hand there), contested (hand; and contact, if given), or hidden."""
    out = modal.select(*keys).join(hand.select(*keys).distinct().withColumn("__h", F.lit(True)), keys, "left")
    touch = F.lit(True)
    if contact is not None:
        out = out.join(contact.select(*keys).distinct().withColumn("__c", F.lit(True)), keys, "left")
        touch = F.coalesce("__c", F.lit(False))
    kind = F.when(F.col("__h").isNull(), "trusted").when(touch, "contested").otherwise("hidden")
    return out.select(*keys, kind.alias("kind"))


def dilate_pixels(mask: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """keys, y, x: all pixels of the image within `radius` of a pixel of the mask."""
    moves = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    disk = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves])).alias("m")
    grown = mask.select(*keys, "y", "x", disk).select(*keys, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    return grown.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def classify_volume(depth: Column, front: Column, back: Column, thickness: float) -> Column:
    """front (at or before the interval), behind (after it and the thickness), else intersecting; null if unknown."""
    return F.when(depth <= front, "front").when(depth > F.greatest(back, front + thickness), "behind").when(depth.isNotNull(), "intersecting")


def depth_order(hand: Column, thing: Column, margin: float) -> Column:
    """1 hand in front, 2 object in front, 0 within the margin, unknown or not positive."""
    delta = hand - thing
    known = (hand > 0) & (thing > 0) & ~F.isnan(hand) & ~F.isnan(thing)
    return F.when(known & (delta < -margin), 1).when(known & (delta > margin), 2).otherwise(0)


def resolve_order(primary: Column, assist: Column, strong: Column) -> Column:
    """struct value, source: 1 primary as it is; 2 ambiguous, promoted by a strong assist; 3 hand in front, contradicted by a strong assist; 0 nothing known."""
    promoted = (primary == 0) & strong & (assist > 0)
    flipped = (primary == 1) & strong & (assist == 2)
    value = F.when(F.coalesce(flipped, F.lit(False)), 2).when(F.coalesce(promoted, F.lit(False)), assist).otherwise(F.coalesce(primary, F.lit(0)))
    source = F.when(F.coalesce(flipped, F.lit(False)), 3).when(F.coalesce(promoted, F.lit(False)), 2).when(primary > 0, 1).otherwise(0)
    return F.struct(value.alias("value"), source.alias("source"))


def gate_occlusion(robot: Column, finger: Column, occluder: Column, support: Column, robot_depth: Column, object_depth: Column, contact_depth: Column, tolerance: float, bias: float) -> Column:
    """True if all flags hold and the robot is behind: by the object's depth if known, else by the contact's; unknown never hides."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    known = lambda c: F.when(~F.isnan(c) & (c > 0), c)
    surface = F.coalesce(known(object_depth), known(contact_depth) + bias)
    return flag(robot) & flag(finger) & flag(occluder) & flag(support) & flag(known(robot_depth) + tolerance >= surface)


def ablation_zero(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.lit(0.0))


def ablation_boxes(df: DataFrame, keys: list[str], columns: int, patch: str = "patch", value: str = "occupancy") -> DataFrame:
    """Every patch of the box around the patches that aren't 0 gets 1, the others 0."""
    w = Window.partitionBy(*keys)
    r, c, on = F.floor(F.col(patch) / columns), F.col(patch) % columns, F.col(value) > 0
    edge = lambda f, x: f(F.when(on, x)).over(w)
    inside = r.between(edge(F.min, r), edge(F.max, r)) & c.between(edge(F.min, c), edge(F.max, c))
    return df.withColumn("__in", F.coalesce(inside, F.lit(False)).cast("double")).withColumn(value, F.col("__in")).drop("__in")


def ablation_shuffle(df: DataFrame, group: list[str], member: str, seed: str) -> DataFrame:
    """`member` values of a group change places, the same way for the same seed: adds shuffled_<member>."""
    m = df.select(*group, member).distinct()
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in [*group, member]]), 256)
    w = Window.partitionBy(*group)
    ranked = m.withColumns({"__a": F.row_number().over(w.orderBy(member)), "__b": F.row_number().over(w.orderBy(h, member))})
    target = ranked.select(*group, F.col("__a").alias("__b"), F.col(member).alias(f"shuffled_{member}"))
    return df.join(ranked.join(target, [*group, "__b"]).drop("__a", "__b"), [*group, member])


def jitter_parameters(recordings: DataFrame, key: str, seed: int, ranges: dict[str, float]) -> DataFrame:
    """key and one factor in [1 - r, 1 + r] for each range r, drawn from a hash of seed, key and name; null for a range of 0."""
    unit = lambda name: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(name)), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return recordings.select(key, *[(1 - r + 2 * r * unit(n) if r else F.lit(None).cast("double")).alias(n) for n, r in ranges.items()])


def provenance(files: DataFrame, keys: list[str], parameters: dict[str, str] | None = None) -> DataFrame:
    """keys, files, first, last, bytes, modified, signature (SHA-256 of these and the parameters). files: keys, path, length, modificationTime."""
    p = F.to_json(F.create_map(*[F.lit(x) for kv in sorted((parameters or {}).items()) for x in kv])) if parameters else F.lit("{}")
    out = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"), F.max("path").alias("last"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return out.withColumn("signature", F.sha2(F.concat_ws("|", "files", "first", "last", "bytes", F.col("modified").cast("string"), p), 256))


def stale(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose stored signature isn't the current one."""
    c = current.select(*keys, F.col("signature").alias("__now"))
    return stored.join(c, keys, "left").where(~F.col("signature").eqNullSafe(F.col("__now"))).select(*keys)
