"""Whole flows: recordings to scored segments, and experiment results to paired summaries. Each is one lineage of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.operators.filters import sample_tokens
from timeloom.operators.joins import expand_tokens, nearest_center, paired_deltas
from timeloom.operators.metrics import fold_mean, seed_summary
from timeloom.operators.sequence import centered_moving_average, run_length_segments


def token_table(recordings: DataFrame, frames: DataFrame, keys: list[str], sample_fps: float, label: str = "label", policy: str = "center") -> tuple[DataFrame, DataFrame]:
    """(tokens with a label, frame_to_token). policy: the centre frame's label, or `ignore`: -1 where the token's frames differ."""
    tokens = sample_tokens(recordings, keys, sample_fps)
    by = frames.select(*keys, F.col("frame").alias("__f"), F.col(label).alias("__l"))
    center = tokens.join(by, [*[tokens[k] == by[k] for k in keys], tokens["center"] == by["__f"]], "left").select(*[tokens[c] for c in tokens.columns], F.coalesce("__l", F.lit(-1)).alias(label))
    if policy == "ignore":
        each = tokens.select(*keys, "token_index", F.explode("frames").alias("__f")).join(by, [*keys, "__f"], "left")
        same = each.groupBy(*keys, "token_index").agg((F.min("__l") == F.max("__l")).alias("__same"))
        center = center.join(same, [*keys, "token_index"]).withColumn(label, F.when(F.col("__same"), F.col(label)).otherwise(-1)).drop("__same")
    return center, nearest_center(frames, tokens, keys)


def predictions_to_segments(scores: DataFrame, mapping: DataFrame, keys: list[str], classes: int, width: int = 3) -> DataFrame:
    """Token probabilities (keys, token_index, p0 ..) to frames, smoothed, argmax, runs of equal classes."""
    p = [f"p{c}" for c in range(classes)]
    smooth = centered_moving_average(expand_tokens(scores, mapping, keys), keys, "frame", p, width)
    both = F.array(*[F.col(f"{c}_smooth") for c in p])
    return run_length_segments(smooth.withColumn("label", (F.array_position(both, F.array_max(both)) - 1).cast("int")), keys, "frame", "label")


def experiment_summary(results: DataFrame, base: str, treated: str, metric: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per variant and seed over folds, paired deltas over seeds, violations) from variant, seed, fold, metric, support."""
    folds = fold_mean(results, ["variant", "seed"], "fold", metric, "support")
    deltas, bad = paired_deltas(results, ["seed", "fold"], "variant", base, treated, [metric], "support")
    return folds, seed_summary(deltas, ["fold"], f"{metric}_delta"), bad
