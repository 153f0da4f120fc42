"""Column functions: geometry, text keys, scores. All run inside the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, from the first entry on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def axis_angle_to_matrix(x: Column, y: Column, z: Column) -> Column:
    """3 x 3 array of arrays; below an angle of 1e-8 the identity."""
    angle = F.sqrt(x * x + y * y + z * z)
    s, c = F.sin(angle), F.cos(angle)
    kx, ky, kz = x / angle, y / angle, z / angle
    v = 1 - c
    turned = F.array(
        F.array(c + kx * kx * v, kx * ky * v - kz * s, kx * kz * v + ky * s),
        F.array(ky * kx * v + kz * s, c + ky * ky * v, ky * kz * v - kx * s),
        F.array(kz * kx * v - ky * s, kz * ky * v + kx * s, c + kz * kz * v),
    )
    one = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    return F.when(angle < 1e-8, one).otherwise(turned)


def axis_angle_to_rot6d(x: Column, y: Column, z: Column, valid: Column | None = None) -> Column:
    """The rotation's first two columns, one after the other; zeros where not valid."""
    m = axis_angle_to_matrix(x, y, z)
    six = F.array(*[m[i][j] for j in range(2) for i in range(3)])
    return six if valid is None else F.when(valid, six).otherwise(F.array_repeat(F.lit(0.0), 6))


def joints_to_rot6d(joints: Column, valid: Column) -> Column:
    """array<struct<x,y,z>> to one flat array of 6 numbers a joint; zeros where not valid."""
    return F.flatten(F.transform(joints, lambda j: axis_angle_to_rot6d(j["x"], j["y"], j["z"], valid)))


def matrix_to_axis_angle(m: Column) -> Column:
    """array of three; below an angle of 1e-6 zeros."""
    angle = F.acos(_clip((m[0][0] + m[1][1] + m[2][2] - 1) / 2, -1.0, 1.0))
    k = angle / (2 * F.sin(angle))
    vec = F.array((m[2][1] - m[1][2]) * k, (m[0][2] - m[2][0]) * k, (m[1][0] - m[0][1]) * k)
    return F.when(angle < 1e-6, F.array_repeat(F.lit(0.0), 3)).otherwise(vec)


def angle_between(a: Column, b: Column) -> Column:
    """Radians between two vectors; 0 if either is shorter than 1e-8."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(F.acos(_clip(dot(a, b) / (na * nb), -1.0, 1.0)))


def bend(a: Column, b: Column, c: Column) -> Column:
    """Angle between the bones a-b and b-c; 0 is straight."""
    return angle_between(F.zip_with(b, a, lambda x, y: x - y), F.zip_with(c, b, lambda x, y: x - y))


def project_pinhole(x: Column, y: Column, z: Column, focal, width, height) -> Column:
    """struct u, v around the image's centre; null unless z > 1e-8."""
    return F.when(z > 1e-8, F.struct((_c(focal) * x / z + _c(width) / 2).alias("u"), (_c(focal) * y / z + _c(height) / 2).alias("v")))


def unproject(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> Column:
    """array x, y, z in the camera's frame."""
    return F.array((u - _c(cx)) * z / _c(fx), (v - _c(cy)) * z / _c(fy), z)


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def camera_to_world(p: Column, rotation: Column, translation: Column) -> Column:
    """R transposed, times p - t."""
    moved = F.zip_with(p, translation, lambda a, b: a - b)
    return F.array(*[sum((rotation[i][j] * moved[i] for i in range(1, 3)), rotation[0][j] * moved[0]) for j in range(3)])


def brown_conrady(x: Column, y: Column, k: list[float]) -> Column:
    """Distorted normalised point, struct x, y. k: k1, k2, p1, p2, k3."""
    r2 = x * x + y * y
    radial = 1 + k[0] * r2 + k[1] * r2 * r2 + k[4] * r2 * r2 * r2
    return F.struct((x * radial + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x)).alias("x"), (y * radial + k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y).alias("y"))


def invert_brown_conrady(x: Column, y: Column, k: list[float], iterations: int = 8) -> Column:
    """Undistorted point by fixed-point iteration, struct x, y."""
    start = F.struct(x.alias("x"), y.alias("y"))

    def step(p: Column, _: Column) -> Column:
        d = brown_conrady(p["x"], p["y"], k)
        return F.struct((p["x"] + x - d["x"]).alias("x"), (p["y"] + y - d["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)


def rigid_apply(rotation: Column, translation: Column, p: Column) -> Column:
    return F.zip_with(matvec(rotation, p), translation, lambda a, b: a + b)


def rigid_compose(r2: Column, t2: Column, r1: Column, t1: Column) -> Column:
    """struct rotation, translation: first (r1, t1), then (r2, t2)."""
    column = lambda j: F.transform(r1, lambda row: row[j])
    product = F.transform(r2, lambda row: F.array(*[dot(row, column(j)) for j in range(3)]))
    return F.struct(product.alias("rotation"), rigid_apply(r2, t2, t1).alias("translation"))


def similarity_apply(scale: Column, rotation: Column, translation: Column, p: Column) -> Column:
    return F.zip_with(F.transform(matvec(rotation, p), lambda v: v * scale), translation, lambda a, b: a + b)


def normalize_epoch_time(t: Column) -> Column:
    """Seconds: nanoseconds from 1e15 on, milliseconds from 1e11 on."""
    t = t.cast("double")
    return F.when(F.abs(t) >= 1e15, t / 1e9).when(F.abs(t) >= 1e11, t / 1e3).otherwise(t)


def frame_to_sec(frame: Column, fps) -> Column:
    """Rounded to 4 places, half to even."""
    return F.bround(frame / _c(fps), 4)


def sec_to_frame(sec: Column, fps) -> Column:
    return F.rint(sec * _c(fps)).cast("long")


def sanitize(s: Column) -> Column:
    """Runs of other than word characters become _, none at the ends, 50 characters at most."""
    return F.substring(F.trim(F.regexp_replace(s, r"[^\w]+", "_"), F.lit("_")), 1, 50)


def natural_key(s: Column) -> Column:
    """Sorts like the name with its digit runs read as numbers, letters without case."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x)), "")


def normalize_phrase(s: Column) -> Column:
    """Lower-case letters and digits, words joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def box_iou(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """0 where the union has no area."""
    common = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0)) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def intersection_fraction(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Share of the first box within the second."""
    common = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0)) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return F.when((ax1 > ax0) & (ay1 > ay0), common / ((ax1 - ax0) * (ay1 - ay0))).otherwise(0.0)


def distance_to_box(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(F.greatest(x0 - x, F.lit(0.0), x - x1), F.greatest(y0 - y, F.lit(0.0), y - y1))


def known(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def fuse_max(a: Column, b: Column) -> Column:
    """The larger known score within [0, 1]; 0 if neither is known."""
    return F.coalesce(_clip(F.greatest(known(a), known(b)), 0.0, 1.0), F.lit(0.0))


def visibility_evidence(a: Column, b: Column) -> Column:
    """a * (1 - b); 0 if either is unknown."""
    return F.coalesce(known(a) * (1 - known(b)), F.lit(0.0))


def fuse_depth(a: Column, b: Column, tolerance: float) -> Column:
    """struct depth, source: 1 agree (the farther), 2 differ (the second), 3 first only, 4 second only, 0 none."""
    a, b = known(a), known(b)
    close = F.abs(a - b) <= tolerance
    depth = F.when(close, F.greatest(a, b)).otherwise(F.coalesce(b, a))
    source = F.when(close, 1).when(a.isNotNull() & b.isNotNull(), 2).when(a.isNotNull(), 3).when(b.isNotNull(), 4).otherwise(0)
    return F.struct(depth.alias("depth"), source.alias("source"))


def vote_2of3(a: Column, b: Column, c: Column) -> Column:
    """At least two are true; unknown is an abstention and counts against."""
    return sum((F.coalesce(x.cast("int"), F.lit(0)) for x in (b, c)), F.coalesce(a.cast("int"), F.lit(0))) >= 2


def dead_zone_ramp(x: Column, zone: float, full: float) -> Column:
    """-1 .. 1: 0 within the zone, then linear up to `full`."""
    return F.signum(x) * _clip((F.abs(x) - zone) / (full - zone), 0.0, 1.0)


def confidence_score(delta: Column, stereo: Column, contact: Column, *, zone: float = 0.005, full: float = 0.03, weights: tuple[float, float] = (0.6, 0.4), floor: float = 0.5, threshold: float = 0.35) -> Column:
    """struct score, active: weighted mean of the depth ramp (behind is positive) and the stereo score, times a gain that contact lifts from `floor` to 1."""
    ramp = F.coalesce(dead_zone_ramp(known(delta), zone, full), F.lit(0.0))
    side = F.coalesce(_clip(known(stereo), 0.0, 1.0), F.lit(0.0))
    gain = floor + (1 - floor) * F.coalesce(_clip(known(contact), 0.0, 1.0), F.lit(0.0))
    score = gain * (weights[0] * ramp + weights[1] * side) / (weights[0] + weights[1])
    return F.struct(score.alias("score"), (score >= threshold).alias("active"))


def weight_by_known(confidence: Column, fraction: Column) -> Column:
    return confidence * fraction


def frames_to_ranges(frames: Column, most: int = 10) -> Column:
    """Text of an array of frames: "3-7, 9", after `most` ranges "... (+k more)"."""
    sorted_ = F.array_distinct(F.array_sort(frames))
    kind = "array<struct<a:bigint,b:bigint>>"

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        grow = (F.size(out) > 0) & (last["b"] + 1 == x)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), x.cast("long").alias("b"))))
        return F.when(F.coalesce(grow, F.lit(False)), grown).otherwise(F.concat(out, F.array(F.struct(x.cast("long").alias("a"), x.cast("long").alias("b")))))

    guarded = lambda out, x: F.when(F.size(out) == 0, F.array(F.struct(x.cast("long").alias("a"), x.cast("long").alias("b")))).otherwise(step(out, x))
    ranges = F.aggregate(sorted_, F.array().cast(kind), guarded)
    text = F.array_join(F.transform(F.slice(ranges, 1, most), lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))), ", ")
    return F.when(F.size(ranges) > most, F.concat(text, F.lit(", ... (+"), (F.size(ranges) - most).cast("string"), F.lit(" more)"))).otherwise(text)


def stable_seed(text: Column) -> Column:
    """First 8 bytes of SHA-256 as an unsigned number (decimal(20, 0))."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once: an expression named inside a lambda is worked out again for each element."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column) -> Column:
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    powers = lambda w: let(F.array_max(w), lambda top: F.transform(w, lambda x: F.exp(x - top)))
    return let(v, lambda w: let(powers(w), shares))


def argmax(v: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def l2_normalize(v: Column) -> Column:
    """Zero vectors stay zero."""
    return let(F.sqrt(dot(v, v)), lambda size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def attributes_from_path(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Value of the first (part, value) whose part the path contains."""
    out = F.lit(default)
    for part, value in reversed(rules):
        out = F.when(F.contains(path, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def display_label(label: Column, description: Column) -> Column:
    return F.when(description.isNotNull(), F.concat(label, F.lit(" - "), description)).otherwise(label)
