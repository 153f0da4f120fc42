"""Sinks. Spark's output committer publishes whole folders; small reports are collected after aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def annotation_json(segments: DataFrame, recordings: DataFrame, keys: list[str], source: str = "timeloom") -> DataFrame:
    """keys and value: the annotation file of each recording, segments in order, with where they come from."""
    s = F.array_sort(F.collect_list(F.struct(F.col("start_frame").cast("int").alias("start_frame"), F.col("end_frame").cast("int").alias("end_frame"), "label")))
    body = segments.groupBy(*keys).agg(s.alias("segments")).join(recordings, keys)
    return body.select(*keys, F.to_json(F.struct(F.col(keys[0]).cast("string").alias("episode"), "num_frames", "fps", "segments", F.struct(F.lit(source).alias("source")).alias("provenance"))).alias("value"))


def write_annotations(segments: DataFrame, recordings: DataFrame, keys: list[str], path: str, lines: bool = False) -> None:
    """A folder and file for each recording; with lines a recording is a line, and there are as many files as tasks, however many the recordings are."""
    out = annotation_json(segments, recordings, keys)
    if lines:
        out.select("value").write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").partitionBy(*keys).text(path)


def stereo_rows(pairs: DataFrame) -> DataFrame:
    """Times with 9 decimals, signed differences in ms with 6, as text."""
    delta = (F.col("camera_2_timestamp_s") - F.col("camera_1_timestamp_s")) * 1000
    return pairs.select(
        "recording", "output_index", *[c for n in (1, 2) for c in (f"camera_{n}_source_index", f"camera_{n}_frame_number", F.format_string("%.9f", f"camera_{n}_timestamp_s").alias(f"camera_{n}_timestamp_s"))],
        F.format_string("%.6f", delta).alias("camera_2_minus_camera_1_ms"),
    )


def camera_rows(pairs: DataFrame) -> DataFrame:
    delta = (F.col("depth_timestamp_s") - F.col("rgb_timestamp_s")) * 1000
    return pairs.select("recording", "output_index", "rgb_source_index", "depth_source_index", F.format_string("%.9f", "rgb_timestamp_s").alias("rgb_timestamp_s"), F.format_string("%.9f", "depth_timestamp_s").alias("depth_timestamp_s"), F.format_string("%.6f", delta).alias("depth_minus_rgb_ms"))


def write_ordered_csv(rows: DataFrame, path: str) -> None:
    """One folder for each recording, rows in the order of output_index."""
    rows.repartition("recording").sortWithinPartitions("recording", "output_index").write.mode("overwrite").partitionBy("recording").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A finished, small table as Markdown."""
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in got]) + "\n"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(rows: DataFrame, path: str, prefix: str) -> None:
    """The same rows as JSON, CSV (structs and arrays as JSON text) and Markdown."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{prefix}_json")
    rows.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{prefix}_csv")
    put_text(rows.sparkSession, f"{path}/{prefix}.md", markdown(rows.select(*flat)))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str, updated_at=None) -> DataFrame:
    """New records replace those with their key; updated_at stamps them."""
    stamped = new.withColumn("updated_at", F.lit(updated_at)) if updated_at is not None else new
    return old.join(new.select(key), key, "left_anti").unionByName(stamped, allowMissingColumns=True)


def write_cluster_points(points: DataFrame, path: str) -> None:
    """split, recording, token_index, label, cluster, x, y."""
    points.select("split", "recording", "token_index", "label", "cluster", "x", "y").write.mode("overwrite").option("header", True).csv(path)


def write_sidecar(rows: DataFrame, path: str, version: int) -> None:
    """An optional feature family beside the base table, with its schema version; the base isn't touched."""
    rows.withColumn("schema_version", F.lit(version)).write.mode("overwrite").partitionBy("recording").parquet(path)


def write_frame_predictions(rows: DataFrame, path: str) -> None:
    """frame, gt, raw, smoothed and probabilities, a folder for each recording."""
    rows.write.mode("overwrite").partitionBy("recording").parquet(path)
