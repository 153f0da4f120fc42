"""ML-shaped operators on Spark MLlib and SQL. Token vectors are taken as given; models are fitted here, on Spark."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.scalars import cosine, l2_normalize, let, softmax
from timeloom.operators.joins import not_yet_done
from timeloom.operators.metrics import class_weights
from timeloom.plans.scratch import cut


def with_vector(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def train_window_classifier(df: DataFrame, vec: str, label: str, n_classes: int, weights: str = "inverse", iterations: int = 50) -> PipelineModel:
    """Scaled vectors to classes by logistic regression with class weights; for a perceptron, train_perceptron()."""
    rows = with_vector(df.where(F.col(label) >= 0), vec).withColumn("label", F.col(label).cast("double"))
    w = class_weights(rows, label, n_classes, weights).select(F.col("class").cast("double").alias("label"), "weight")
    head = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=iterations, family="multinomial")
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), head]).fit(rows.join(F.broadcast(w), "label"))


def score_windows(model: PipelineModel, df: DataFrame, vec: str) -> DataFrame:
    """df with p (array of class probabilities) and prediction."""
    drop = ("features", "scaled", "rawPrediction", "probability")
    return model.transform(with_vector(df, vec)).withColumn("p", vector_to_array("probability")).withColumn("prediction", F.col("prediction").cast("int")).drop(*drop)


@dataclass
class Perceptron:
    """Layers of (weights, bias) over scaled vectors, tanh between them; mean, scale: of the vectors; losses: one a step of the fit."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    losses: list[float]


def forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What goes into each layer, and the class probabilities."""
    inputs = [x]
    for k, (w, b) in enumerate(layers):
        z = inputs[-1] @ w + b
        inputs.append(np.tanh(z) if k + 1 < len(layers) else z)
    z = inputs.pop()
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return inputs, p / p.sum(axis=1, keepdims=True)


def gradient(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, class_weight: np.ndarray, smoothing: float) -> tuple[np.ndarray, float, float]:
    """Of rows: the gradient of the summed loss, laid out flat, the loss and the rows' weight. The target of class c is (1 - smoothing) for the label plus smoothing / classes,
    times the weight of c."""
    inputs, p = forward(layers, x)
    target = np.full(p.shape, smoothing / p.shape[1])
    target[np.arange(len(y)), y] += 1 - smoothing
    target *= class_weight
    loss, out = float(-(target * np.log(np.maximum(p, 1e-300))).sum()), []
    back = p * target.sum(axis=1, keepdims=True) - target
    for k in range(len(layers) - 1, -1, -1):
        out.append(np.concatenate([(inputs[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = back @ layers[k][0].T * (1 - inputs[k] ** 2)
    return np.concatenate(out[::-1]), loss, float(class_weight[y].sum())


def unflat(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:], strict=True):
        layers.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return layers


def train_perceptron(
    df: DataFrame, vec: str, label: str, n_classes: int, hidden: list[int], weights: str = "inverse", smoothing: float = 0.1, seed: int = 42, steps: int = 60, rate: float = 0.05, decay: float = 1e-4, warm_up: int = 5, clip: float = 1.0
) -> Perceptron:
    """A perceptron by cross entropy with class weights and label smoothing, fitted by full-batch steps (Adam with decoupled decay, a linear warm-up, then a cosine, clipped).

    The scaled vectors are written once, as blocks of numbers; a step sends the weights out, sums gradients block by block and task by task, and brings a bounded number of
    sums home. The same seed gives the same start. Labels under 0, null labels and null vectors don't count; without any row it is an error.
    """
    rows = df.where((F.col(label) >= 0) & F.col(vec).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("x"))
    m = with_vector(rows, "x").agg(Summarizer.mean(F.col("features")).alias("mean"), Summarizer.std(F.col("features")).alias("std"), F.count(F.lit(1)).alias("n")).first()
    if not m["n"]:
        raise ValueError("no labelled rows")
    mean, scale = m["mean"].toArray(), np.where(m["std"].toArray() > 0, m["std"].toArray(), 1.0)
    share = {r["class"]: r["weight"] for r in class_weights(rows, "y", n_classes, weights).collect()}
    class_weight = np.array([float(share.get(k) or 0.0) for k in range(n_classes)])
    size, kind = len(mean), pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def block(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, size)
                yield pa.RecordBatch.from_pydict({"x": [((x - mean) / scale).astype("<f8").tobytes()], "y": [np.asarray(batch.column("y")).astype("<i4").tobytes()]}, schema=kind)

    blocks = cut(rows.mapInArrow(block, "x binary, y binary"))
    sizes, rng = [size, *hidden, n_classes], np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([(rng.standard_normal((n, k)) / np.sqrt(n)).ravel(), np.zeros(k)]) for n, k in zip(sizes[:-1], sizes[1:], strict=True)])
    sums = pa.schema([("part", pa.int32()), ("g", pa.binary()), ("loss", pa.float64()), ("weight", pa.float64())])
    first, second, losses = np.zeros_like(flat), np.zeros_like(flat), []
    spark = df.sparkSession
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(flat)

        def partial(batches, shared=shared):
            layers, total, loss, weight = unflat(shared.value, sizes), np.zeros(len(shared.value)), 0.0, 0.0
            for batch in batches:
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    g, own, w = gradient(layers, np.frombuffer(x, "<f8").reshape(-1, size), np.frombuffer(y, "<i4"), class_weight, smoothing)
                    total, loss, weight = total + g, loss + own, weight + w
            yield pa.RecordBatch.from_pydict({"part": [0], "g": [total.tobytes()], "loss": [loss], "weight": [weight]}, schema=sums)

        def add(table):
            g = sum(np.frombuffer(x, float) for x in table.column("g").to_pylist())
            return pa.table({"part": [0], "g": [g.tobytes()], "loss": [sum(table.column("loss").to_pylist())], "weight": [sum(table.column("weight").to_pylist())]}, schema=sums)

        kinds = "part int, g binary, loss double, weight double"
        got = blocks.mapInArrow(partial, kinds).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("part").applyInArrow(add, kinds).collect()
        weight = sum(r["weight"] for r in got) or 1.0
        g = sum(np.frombuffer(bytes(r["g"]), float) for r in sorted(got, key=lambda r: bytes(r["g"]))) / weight
        losses.append(sum(r["loss"] for r in got) / weight)
        shared.destroy()
        g *= min(1.0, clip / max(1e-12, float(np.linalg.norm(g))))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        pace = rate * (step / warm_up if step < warm_up else 0.5 * (1 + np.cos(np.pi * (step - warm_up) / max(1, steps - warm_up))))
        flat = flat - pace * (first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) + decay * flat)
    return Perceptron([(w.copy(), b.copy()) for w, b in unflat(flat, sizes)], mean, scale, losses)


def score_perceptron(model: Perceptron, df: DataFrame, vec: str) -> DataFrame:
    """df with p (array of class probabilities) and prediction; null for a null vector."""
    layers, mean, scale = model.layers, model.mean, model.scale

    @F.pandas_udf("array<double>")
    def probabilities(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        out = pd.Series([None] * len(v), dtype=object)
        if known.any():
            p = forward(layers, (np.array(v[known].tolist(), float) - mean) / scale)[1]
            for i, row in zip(np.flatnonzero(known).tolist(), p.tolist(), strict=True):
                out.iat[i] = row
        return out

    return df.withColumn("p", probabilities(F.col(vec).cast("array<double>"))).withColumn("prediction", F.when(F.col("p").isNotNull(), F.array_position("p", F.array_max("p")).cast("int") - 1))


def prototype_scores(df: DataFrame, prototypes: DataFrame, keys: list[str], vec: str, scale: float = 10.0) -> DataFrame:
    """keys, label, similarity of the nearest prototype (ties: the smaller label). prototypes: label, prototype; a small dimension."""
    both = df.select(*keys, vec).join(F.broadcast(prototypes.select("label", "prototype")))
    sim = both.select(*keys, "label", (scale * cosine(F.col(vec), F.col("prototype"))).alias("similarity"))
    best = sim.groupBy(*keys).agg(F.max(F.struct("similarity", (-F.col("label")).alias("l"))).alias("b"))
    return best.select(*keys, (-F.col("b.l")).alias("label"), F.col("b.similarity").alias("similarity"))


def masked_pool(patches: DataFrame, masks: DataFrame, keys: list[str], vec: str, present: DataFrame | None = None) -> DataFrame:
    """keys, object, pooled (weighted mean vector), occupancy. patches: keys, patch, vec; masks: keys, object, patch, occupancy. Objects that `present` (keys, object, present)
    denies get zeros. Null occupancies and null numbers count as 0. One vector sum a group, combined before it is shuffled."""
    w = masks.join(patches.where(F.col(vec).isNotNull()), [*keys, "patch"]).withColumn("__w", F.coalesce(F.col("occupancy").cast("double"), F.lit(0.0)))
    w = w.withColumn("__v", array_to_vector(F.transform(vec, lambda x: F.coalesce(x.cast("double") * F.col("__w"), F.lit(0.0)))))
    sums = w.groupBy(*keys, "object").agg(Summarizer.sum(F.col("__v")).alias("__v"), F.sum("__w").alias("__w"))
    pooled = sums.select(*keys, "object", F.transform(vector_to_array("__v"), lambda x: x / F.greatest("__w", F.lit(1e-6))).alias("pooled"))
    out = pooled.join(masks.groupBy(*keys, "object").agg(F.avg("occupancy").alias("occupancy")), [*keys, "object"])
    if present is None:
        return out
    gate = present.select(*keys, "object", F.col("present").alias("__p"))
    return out.join(gate, [*keys, "object"], "left").withColumn("pooled", F.when(F.col("__p"), F.col("pooled")).otherwise(F.transform("pooled", lambda x: x * 0))).drop("__p")


def attention_pool(patches: DataFrame, keys: list[str], vec: str, query: list[float], eps: float = 1e-5) -> DataFrame:
    """keys, pooled, weights: softmax over patches of query . norm(v) / sqrt(d), then the weighted sum of the vectors."""
    d = len(query)
    rows = patches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("patch", F.col(vec).cast("array<double>").alias("v")))).alias("rows"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    q = F.array(*[F.lit(float(x)) for x in query])

    def logit(r):
        score = lambda c: total(F.zip_with(c, q, lambda x, k: x * k)) / F.sqrt(total(F.transform(c, lambda x: x * x)) / d + eps) / (d**0.5)
        return let(total(r["v"]) / d, lambda mean: let(F.transform(r["v"], lambda x: x - mean), score))

    out = rows.withColumn("weights", softmax(F.transform("rows", logit)))
    scaled = F.zip_with("rows", "weights", lambda r, w: F.transform(r["v"], lambda x: x * w))
    return out.withColumn("pooled", F.aggregate(scaled, F.array_repeat(F.lit(0.0), d), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))).drop("rows")


def pca(df: DataFrame, vec: str, k: int, out: str = "pca") -> DataFrame:
    """df with the first k components of the vectors' directions (signs are Spark's)."""
    unit = Normalizer(inputCol="features", outputCol="unit").transform(with_vector(df, vec))
    return PCA(k=k, inputCol="unit", outputCol="__pca").fit(unit).transform(unit).withColumn(out, vector_to_array("__pca")).drop("features", "unit", "__pca")


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 0, starts: int = 20) -> tuple[DataFrame, float]:
    """(df with cluster, cost) of the cheapest of `starts` seeded runs."""
    rows = with_vector(df, vec).cache()
    best = min((KMeans(k=k, seed=seed + i).fit(rows) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).withColumnRenamed("prediction", "cluster").drop("features")
    return out, best.summary.trainingCost


def silhouette(df: DataFrame, vec: str, cluster: str, sample: int | None = None) -> float | None:
    """Mean silhouette (squared Euclidean, from cluster sums, so linear in the rows) of all rows, or if asked for of about `sample` rows, chosen by a hash; null with fewer than two clusters."""
    rows = df if sample is None else df.where(F.pmod(F.xxhash64(vec), F.lit(max(1, df.count()))) < sample)
    rows = with_vector(rows, vec).withColumn("prediction", F.col(cluster).cast("int"))
    if rows.select("prediction").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y; near pairs, where products would lose digits, by their differences."""
    far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    square = far - 2 * (x @ y.T)
    near = np.argwhere(square <= 1e-5 * far)
    for i, j in (part.T for part in np.array_split(near, -(-len(near) // 10_000) or 1)):
        square[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(square)


def _cluster_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each row of left and cluster of right: the sum of its distances to that cluster's rows, and how many they are."""
    kind = pa.schema([("i", left.schema.field("i").type), ("c", left.schema.field("c").type), ("o", left.schema.field("c").type), ("s", pa.float64()), ("n", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    x, y = (t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t in (left, right))
    names = right.column("c").combine_chunks().dictionary_encode(null_encoding="encode")
    code = names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    y, first, size = y[order], np.searchsorted(code[order], np.arange(len(names.dictionary))), np.bincount(code)
    sums = np.concatenate([np.add.reduceat(distances(part, y), first, axis=1) for part in np.array_split(x, -(-len(x) // 512))])
    at = pa.array(np.repeat(np.arange(len(x)), len(size)))
    other = pa.array(np.tile(np.arange(len(size)), len(x)))
    return pa.table([left.column("i").take(at), left.column("c").take(at), names.dictionary.take(other), pa.array(sums.ravel()), pa.array(np.tile(size, len(x)))], schema=kind)


def exact_silhouette(df: DataFrame, key: str, vec: str, cluster: str, block_rows: int = 4096) -> DataFrame:
    """silhouette with Euclidean distances over all pairs of rows; a key is one row, and rows without a vector are left out.

    Blocks of about block_rows rows meet block by block and leave sums by (row, cluster). The work is the square of the rows, no task holds more than two blocks.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("i"), F.col(vec).alias("x"), F.col(cluster).alias("c"))
    blocks = max(1, -(-rows.count() // block_rows))
    own, every = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(own.alias("p"), every.alias("q"), "i", "x", "c").groupBy("p", "q")
    right = rows.select(every.alias("p"), own.alias("q"), "x", "c").groupBy("p", "q")
    kind = dict(rows.dtypes)
    sums = left.cogroup(right).applyInArrow(_cluster_sums, f"i {kind['i']}, c {kind['c']}, o {kind['c']}, s double, n long")
    same = F.col("c").eqNullSafe(F.col("o"))
    mean = sums.groupBy("i", "c", "o").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("n", F.col("n") - same.cast("int")).where("n > 0").withColumn("d", F.col("s") / F.col("n"))
    ends = mean.groupBy("i").agg(F.max(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    # A row without others has no mean, and counts as 0 as well.
    sides = rows.select("i").join(ends, "i", "left")
    return sides.agg(F.avg(F.when(F.greatest("a", "b") > 0, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0)).alias("silhouette"))


def grid_evaluation(spark, settings: dict[str, list], done: DataFrame | None, fit_and_score) -> DataFrame:
    """One row of metrics for each combination of settings that isn't among those done. fit_and_score(setting) -> dict of metrics runs Spark jobs."""
    names = sorted(settings)
    rows = [dict(zip(names, values, strict=True)) for values in product(*(settings[n] for n in names))]
    table = spark.createDataFrame(rows)
    left = not_yet_done(table, done.select(*names), names) if done is not None else table
    results = [{**r.asDict(), **fit_and_score(r.asDict())} for r in left.orderBy(*names).collect()]
    return spark.createDataFrame(results) if results else left.limit(0)


def balanced_training_set(df: DataFrame, recording: str, split: str, suffix: str = "__cj1") -> DataFrame:
    """Augmented views (recordings with the suffix) only in training: those of validation recordings go."""
    base = F.regexp_replace(recording, f"{suffix}$", "")
    sides = df.where(~F.endswith(recording, F.lit(suffix))).groupBy(F.col(recording).alias("__base")).agg(F.first(split).alias("__split"))
    both = df.withColumn("__base", base).join(sides, "__base")
    view = F.endswith(F.col(recording), F.lit(suffix))
    return both.where(~view | (F.col("__split") == "train")).withColumn(split, F.col("__split")).drop("__base", "__split")


def token_pair_mean(tokens: DataFrame, frames: DataFrame, keys: list[str], vec: str, size: int) -> DataFrame:
    """keys, token_index, vec: mean of the token's two frames, zeros unless both are valid; center_vec: that of the centre frame. tokens: keys, token_index, frames, center."""
    f = lambda n: frames.select(*keys, F.col("frame").alias(f"f{n}"), F.col(vec).cast("array<double>").alias(f"v{n}"), F.col("valid").alias(f"ok{n}"))
    t = tokens.withColumns({"f0": F.col("frames")[0], "f1": F.element_at("frames", -1)}).join(f(0), [*keys, "f0"], "left").join(f(1), [*keys, "f1"], "left")
    ok = F.coalesce(F.col("ok0") & F.col("ok1"), F.lit(False))
    return t.select(*keys, "token_index", F.when(ok, F.zip_with("v0", "v1", lambda a, b: (a + b) / 2)).otherwise(F.array_repeat(F.lit(0.0), size)).alias(vec), ok.alias("valid"))


def interpolate_between_centers(frames: DataFrame, tokens: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, frame, vec: linear mix of the two tokens whose centres are around the frame; the ends hold. tokens: keys, center, vec."""
    t = tokens.select(*keys, F.col("center").alias("t"), F.col(vec).cast("array<double>").alias("v"), F.lit(False).alias("ask"))
    both = t.unionByName(frames.select(*keys, F.col("frame").alias("t"), F.lit(None).cast("array<double>").alias("v"), F.lit(True).alias("ask")))
    point = F.when(~F.col("ask"), F.struct("t", "v"))
    w = Window.partitionBy(*keys)
    both = both.withColumns({
        "p": F.last(point, ignorenulls=True).over(w.orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.first(point, ignorenulls=True).over(w.orderBy("t", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing)),
    }).where("ask")
    part = (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    mixed = F.zip_with("p.v", "n.v", lambda a, b: a + (b - a) * part)
    out = F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull() | (F.col("n.t") == F.col("p.t")), F.col("p.v")).otherwise(mixed)
    return both.select(*keys, F.col("t").alias("frame"), out.alias(vec))
