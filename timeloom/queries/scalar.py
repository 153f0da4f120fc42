"""Column functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.functions import scalars as S
from timeloom.operators import metrics
from timeloom.queries.base import FRAMES, frames, rounded, table


def xyz(spark, d, scale=1.0):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * scale).alias(n) for i, n in enumerate(("x", "y", "z", "a", "b", "c"))])


XYZ = "p AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("x", "y", "z", "a", "b", "c"))) + " FROM embeddings)"


def rot6d(spark, d):
    p = xyz(spark, d, 3.0).withColumn("r", S.axis_angle_to_rot6d(F.col("x"), F.col("y"), F.col("z"), F.col("label") < 8))
    names = [f"r{i}" for i in range(6)]
    return rounded(p.select("vec_id", *[F.col("r")[i].alias(n) for i, n in enumerate(names)]), *names)


def axis_angle_round_trip(spark, d):
    p = xyz(spark, d, 3.0).withColumn("r", S.matrix_to_axis_angle(S.axis_angle_to_matrix(F.col("x"), F.col("y"), F.col("z"))))
    return rounded(p.select("vec_id", *[F.col("r")[i].alias(n) for i, n in enumerate(("rx", "ry", "rz"))]), "rx", "ry", "rz")


def angles(spark, d):
    p = xyz(spark, d)
    u, v = F.array("x", "y", "z"), F.array("a", "b", "c")
    return rounded(p.select("vec_id", S.angle_between(u, v).alias("angle"), S.bend(u, v, F.array("b", "c", "x")).alias("bend"), S.cosine(u, v).alias("cosine")), "angle", "bend", "cosine")


def project_pinhole(spark, d):
    p = xyz(spark, d).withColumn("q", S.project_pinhole(F.col("x"), F.col("y"), F.col("z"), 600.0, 640, 480))
    return rounded(p.select("vec_id", F.col("q.u").alias("u"), F.col("q.v").alias("v")), "u", "v", places=4)


def unproject_world(spark, d):
    """Pixels to the camera's frame, then to the world by a quarter turn and a shift."""
    p = xyz(spark, d).withColumn("q", S.unproject(F.col("x") * 100 + 320, F.col("y") * 100 + 240, F.col("z") + 2, 600.0, 610.0, 320.0, 240.0))
    turn = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))])
    p = p.withColumn("w", S.camera_to_world(F.col("q"), turn, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))))
    return rounded(p.select("vec_id", *[F.col("w")[i].alias(n) for i, n in enumerate(("wx", "wy", "wz"))]), "wx", "wy", "wz")


LENS = [0.1, -0.05, 0.001, -0.002, 0.01]


def brown_conrady(spark, d):
    p = xyz(spark, d).withColumn("q", S.brown_conrady(F.col("x"), F.col("y"), LENS))
    p = p.withColumn("back", S.invert_brown_conrady(F.col("q.x"), F.col("q.y"), LENS, 20))
    return rounded(p.select("vec_id", F.col("q.x").alias("dx"), F.col("q.y").alias("dy"), F.col("back.x").alias("ux"), F.col("back.y").alias("uy")), "dx", "dy", "ux", "uy")


def rigid_transforms(spark, d):
    turn = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))])
    t = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    p = xyz(spark, d).withColumn("two", S.rigid_compose(turn, t, turn, t))
    v = F.array("x", "y", "z")
    p = p.withColumns({"once": S.rigid_apply(turn, t, v), "twice": S.rigid_apply(F.col("two.rotation"), F.col("two.translation"), v), "scaled": S.similarity_apply(F.lit(2.0), turn, t, v)})
    return rounded(p.select("vec_id", F.col("once")[0].alias("once_x"), F.col("twice")[0].alias("twice_x"), F.col("twice")[1].alias("twice_y"), F.col("scaled")[1].alias("scaled_y")), "once_x", "twice_x", "twice_y", "scaled_y")


def time_scalars(spark, d):
    f = frames(spark, d).select("event_id", "frame", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    raw = F.when(F.col("event_id") % 3 == 0, F.col("us") * 1000).when(F.col("event_id") % 3 == 1, F.floor(F.col("us") / 1000)).otherwise(F.floor(F.col("us") / 1000000))
    out = f.select("event_id", F.floor(S.normalize_epoch_time(raw)).alias("seconds"), S.frame_to_sec(F.col("frame"), 32.0).alias("sec"), S.sec_to_frame(F.col("frame") / 32, 16.0).alias("half"))
    return rounded(out, "sec")


def text_scalars(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", S.sanitize(F.col("url")).alias("safe"), S.natural_key(F.col("url")).alias("natural"), S.normalize_phrase(F.col("url")).alias("phrase"), S.attributes_from_path(F.col("url"), [("/en/", "en"), ("/fr/", "fr"), ("https", "tls")], "other").alias("kind"))


def stable_seed(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.stable_seed(F.col("c_name")).cast("string").alias("seed"))


def box_scalars(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.cast("double").alias(n) for n, c in {
        "ax0": F.col("l_partkey") % 7, "ay0": F.col("l_suppkey") % 5, "ax1": F.col("l_partkey") % 7 + F.col("l_quantity"), "ay1": F.col("l_suppkey") % 5 + F.col("l_quantity"),
        "bx0": F.col("l_orderkey") % 9, "by0": F.col("l_orderkey") % 6, "bx1": F.col("l_orderkey") % 9 + 10, "by1": F.col("l_orderkey") % 6 + 12}.items()])
    a, b = [F.col(c) for c in ("ax0", "ay0", "ax1", "ay1")], [F.col(c) for c in ("bx0", "by0", "bx1", "by1")]
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", S.box_iou(*a, *b).alias("iou"), S.intersection_fraction(*a, *b).alias("fraction"), S.distance_to_box(F.lit(20.0), F.lit(1.0), *b).alias("distance"))
    return rounded(out, "iou", "fraction", "distance")


def scores(spark, d):
    f = frames(spark, d)
    a, b = F.when(F.col("frame") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 200), F.when(F.col("frame") % 7 != 0, F.col("event_id") % 100 / 90)
    return f.select("event_id", "frame", a.alias("a"), b.alias("b"))


SCORES = f"{FRAMES}, s AS (SELECT event_id, frame, CASE WHEN frame % 5 > 0 THEN value / 200 END AS a, CASE WHEN frame % 7 <> 0 THEN event_id % 100 / 90 END AS b FROM f)"


def fused_scores(spark, d):
    a, b = F.col("a"), F.col("b")
    out = scores(spark, d).select("event_id", S.fuse_max(a, b).alias("fused"), S.visibility_evidence(a, b).alias("evidence"), S.fuse_depth(a, b, 0.2).alias("d"), S.vote_2of3(a > 0.3, b > 0.5, F.col("frame") % 2 == 0).alias("vote"),
                                  S.weight_by_known(F.lit(0.5), S.known(a)).alias("weighted"))
    return rounded(out.select("event_id", "fused", "evidence", F.col("d.depth").alias("depth"), F.col("d.source").alias("source"), "vote", "weighted"), "fused", "evidence", "depth", "weighted")


def confidence_score(spark, d):
    out = scores(spark, d).withColumn("c", S.confidence_score(F.col("a") / 10 - 0.01, F.col("b"), F.col("a")))
    return rounded(out.select("event_id", F.col("c.score").alias("score"), (F.col("c.score") >= 0.35).alias("active")), "score")


def vector_scalars(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p, u = S.softmax(F.transform("v", lambda x: x * 10)), S.l2_normalize(F.col("v"))
    return rounded(e.select("vec_id", p[0].alias("p0"), S.argmax(F.col("v")).alias("best"), u[0].alias("u0"), F.array_max(p).alias("top")), "p0", "u0", "top")


def display_labels(spark, d):
    dim = spark.createDataFrame([("click", "pressed"), ("view", "seen")], "event_type string, description string")
    f = frames(spark, d).select("event_id", "event_type").join(F.broadcast(dim), "event_type", "left")
    return f.select("event_id", S.display_label(F.col("event_type"), F.col("description")).alias("shown"))


def bilinear_sample(spark, d):
    """Each vector as an 8 x 8 image, sampled at three points that its number and label give, the last beyond the edge."""
    e = table(spark, d, "embeddings")
    px = e.select("vec_id", F.posexplode("embedding").alias("i", "value")).select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "value")
    u, v = (F.col("vec_id") % 29) / 4, (F.col("label") * 3 % 8) * 0.9
    points = e.select("vec_id", F.posexplode(F.array(F.struct(u.alias("u"), v.alias("v")), F.struct(v.alias("u"), u.alias("v")), F.struct((u + 5).alias("u"), (v - 2).alias("v")))).alias("k", "p")).select("vec_id", "k", "p.u", "p.v")
    return rounded(metrics.bilinear_sample(px, points, ["vec_id"], 8, 8, "value").select("vec_id", "k", "sample"), "sample")


QUERIES = {f.__name__: f for f in (rot6d, axis_angle_round_trip, angles, project_pinhole, unproject_world, brown_conrady, rigid_transforms, time_scalars, text_scalars, stable_seed, box_scalars, fused_scores, confidence_score, vector_scalars, display_labels, bilinear_sample)}
DOT = lambda u, v: " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True))
SQL = {
    "rot6d": f"""WITH {XYZ}, q AS (SELECT vec_id, label, x * 3 AS x, y * 3 AS y, z * 3 AS z, sqrt(x * x + y * y + z * z) * 3 AS t FROM p), k AS (SELECT *, x / t AS i, y / t AS j, z / t AS l, sin(t) AS s, cos(t) AS c, 1 - cos(t) AS v FROM q)
SELECT vec_id, CASE WHEN label < 8 THEN round(c + i * i * v, 6) + 0.0 ELSE 0.0 END AS r0, CASE WHEN label < 8 THEN round(j * i * v + l * s, 6) + 0.0 ELSE 0.0 END AS r1, CASE WHEN label < 8 THEN round(l * i * v - j * s, 6) + 0.0 ELSE 0.0 END AS r2,
CASE WHEN label < 8 THEN round(i * j * v - l * s, 6) + 0.0 ELSE 0.0 END AS r3, CASE WHEN label < 8 THEN round(c + j * j * v, 6) + 0.0 ELSE 0.0 END AS r4, CASE WHEN label < 8 THEN round(l * j * v + i * s, 6) + 0.0 ELSE 0.0 END AS r5 FROM k""",
    "axis_angle_round_trip": f"WITH {XYZ} SELECT vec_id, round(x * 3, 6) + 0.0 AS rx, round(y * 3, 6) + 0.0 AS ry, round(z * 3, 6) + 0.0 AS rz FROM p",
    "angles": f"""WITH {XYZ}, n AS (SELECT vec_id, {DOT('xyz', 'abc')} AS uv, sqrt({DOT('xyz', 'xyz')}) AS nu, sqrt({DOT('abc', 'abc')}) AS nv,
(a - x) * (b - a) + (b - y) * (c - b) + (c - z) * (x - c) AS w, sqrt(pow(a - x, 2) + pow(b - y, 2) + pow(c - z, 2)) AS n1, sqrt(pow(b - a, 2) + pow(c - b, 2) + pow(x - c, 2)) AS n2 FROM p)
SELECT vec_id, round(acos(greatest(-1, least(1, uv / (nu * nv)))), 6) AS angle, round(acos(greatest(-1, least(1, w / (n1 * n2)))), 6) AS bend, round(uv / (nu * nv), 6) + 0.0 AS cosine FROM n""",
    "project_pinhole": f"WITH {XYZ} SELECT vec_id, round(CASE WHEN z > 1e-8 THEN 600.0 * x / z + 320 END, 4) AS u, round(CASE WHEN z > 1e-8 THEN 600.0 * y / z + 240 END, 4) AS v FROM p",
    "unproject_world": f"WITH {XYZ}, q AS (SELECT vec_id, x * 100 * (z + 2) / 600.0 - 0.1 AS x, y * 100 * (z + 2) / 610.0 - 0.2 AS y, z + 2 - 0.3 AS z FROM p) SELECT vec_id, round(y, 6) + 0.0 AS wx, round(-x, 6) + 0.0 AS wy, round(z, 6) + 0.0 AS wz FROM q",
    "brown_conrady": f"""WITH {XYZ}, q AS (SELECT vec_id, x, y, x * x + y * y AS r, 1 + 0.1 * (x * x + y * y) - 0.05 * pow(x * x + y * y, 2) + 0.01 * pow(x * x + y * y, 3) AS k FROM p)
SELECT vec_id, round(x * k + 0.002 * x * y - 0.002 * (r + 2 * x * x), 6) + 0.0 AS dx, round(y * k + 0.001 * (r + 2 * y * y) - 0.004 * x * y, 6) + 0.0 AS dy, round(x, 6) + 0.0 AS ux, round(y, 6) + 0.0 AS uy FROM q""",
    "rigid_transforms": f"WITH {XYZ} SELECT vec_id, round(1 - y, 6) + 0.0 AS once_x, round(-x - 1, 6) + 0.0 AS twice_x, round(3 - y, 6) + 0.0 AS twice_y, round(2 * x + 2, 6) + 0.0 AS scaled_y FROM p",
    "time_scalars": f"WITH {FRAMES} SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, round(round_even(frame / 32.0, 4), 6) AS sec, CAST(round_even(frame / 32.0 * 16.0, 0) AS BIGINT) AS half FROM f",
    "text_scalars": r"""SELECT page_id, substr(trim(regexp_replace(url, '[^\w]+', '_', 'g'), '_'), 1, 50) AS safe,
array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN lpad(x, 20, '0') ELSE x END), '') AS natural,
array_to_string(regexp_extract_all(lower(url), '[a-z0-9]+'), ' ') AS phrase, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, 'https') THEN 'tls' ELSE 'other' END AS kind FROM pages""",
    "stable_seed": "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM customer",
    "box_scalars": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 7 AS ax0, l_suppkey % 5 AS ay0, l_partkey % 7 + l_quantity AS ax1, l_suppkey % 5 + l_quantity AS ay1, l_orderkey % 9 AS bx0, l_orderkey % 6 AS by0, l_orderkey % 9 + 10 AS bx1, l_orderkey % 6 + 12 AS by1 FROM lineitem),
c AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS i, (ax1 - ax0) * (ay1 - ay0) AS s FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, round(i / (s + 120 - i), 6) AS iou, round(i / s, 6) AS fraction, round(sqrt(pow(greatest(bx0 - 20, 0, 20 - bx1), 2) + pow(greatest(by0 - 1, 0, 1 - by1), 2)), 6) AS distance FROM c""",
    "fused_scores": f"""WITH {SCORES} SELECT event_id, round(coalesce(least(greatest(greatest(a, b), 0.0), 1.0), 0.0), 6) AS fused, round(coalesce(a * (1 - b), 0.0), 6) + 0.0 AS evidence,
round(CASE WHEN abs(a - b) <= 0.2 THEN greatest(a, b) ELSE coalesce(b, a) END, 6) AS depth, CASE WHEN abs(a - b) <= 0.2 THEN 1 WHEN a IS NOT NULL AND b IS NOT NULL THEN 2 WHEN a IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 4 ELSE 0 END AS source,
CAST(coalesce(a > 0.3, frame % 5 = 0) AS INTEGER) + CAST(coalesce(b > 0.5, false) AS INTEGER) + CAST(frame % 2 = 0 AS INTEGER) >= 2 AS vote, round(0.5 * a, 6) AS weighted FROM s""",
    "confidence_score": f"""WITH {SCORES}, r AS (SELECT event_id, coalesce(sign(a / 10 - 0.01) * least(greatest((abs(a / 10 - 0.01) - 0.005) / (CAST(0.03 AS DOUBLE) - CAST(0.005 AS DOUBLE)), 0.0), 1.0), 0.0) AS r, coalesce(least(greatest(b, 0.0), 1.0), 0.0) AS s, 0.5 + 0.5 * coalesce(least(greatest(a, 0.0), 1.0), 0.0) AS g FROM s),
x AS (SELECT event_id, g * (0.6 * r + 0.4 * s) / (0.6 + 0.4) AS score FROM r) SELECT event_id, round(score, 6) + 0.0 AS score, score >= 0.35 AS active FROM x""",
    "vector_scalars": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), e AS (SELECT *, list_transform(v, lambda x: exp(10 * (x - list_max(v)))) AS e FROM v)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS u0, round(1 / list_sum(e), 6) AS top FROM e""",
    "display_labels": "SELECT event_id, CASE event_type WHEN 'click' THEN 'click - pressed' WHEN 'view' THEN 'view - seen' ELSE event_type END AS shown FROM events",
    "bilinear_sample": """WITH p AS (SELECT vec_id, embedding AS e, (vec_id % 29) / 4 AS a, (label * 3 % 8) * 0.9 AS b FROM embeddings), q AS (SELECT vec_id, e, 0 AS k, a AS u, b AS v FROM p UNION ALL SELECT vec_id, e, 1, b, a FROM p UNION ALL SELECT vec_id, e, 2, a + 5, b - 2 FROM p),
h AS (SELECT vec_id, k, e, least(greatest(CAST(u AS DOUBLE), 0), 6.999) AS u, least(greatest(CAST(v AS DOUBLE), 0), 6.999) AS v FROM q), f AS (SELECT *, CAST(floor(u) AS BIGINT) AS x, CAST(floor(v) AS BIGINT) AS y, u - floor(u) AS du, v - floor(v) AS dv FROM h)
SELECT vec_id, k, round((1 - dv) * (1 - du) * CAST(e[y * 8 + x + 1] AS DOUBLE) + (1 - dv) * du * CAST(e[y * 8 + x + 2] AS DOUBLE) + dv * (1 - du) * CAST(e[y * 8 + x + 9] AS DOUBLE) + dv * du * CAST(e[y * 8 + x + 10] AS DOUBLE), 6) + 0.0 AS sample FROM f""",
}
