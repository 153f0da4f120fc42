"""Readers: files to tables with fixed schemas. NaN and -1 of the files become null where a measurement is meant; labels keep -1. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.scalars import natural_key

ANNOTATION = "episode string, num_frames int, fps double, segments array<struct<start_frame:int,end_frame:int,label:string>>"
PAIRS = "output_index int, camera_1_source_index int, camera_1_frame_number int, camera_1_timestamp_s double, camera_2_source_index int, camera_2_frame_number int, camera_2_timestamp_s double, camera_2_minus_camera_1_ms double"
HAND = "array<struct<is_right:boolean,kpts_3d:array<array<double>>,mano_params:struct<hand_pose:array<double>,global_orient:array<double>>>>"
HISTORY = "epoch int, train_loss double, train_acc double, val_loss double, val_acc double"
EVALUATION = "validation_accuracy double, validation_f1_macro double, validation_f1_weighted double, validation_samples int, seed int, hand_representation string, deterministic boolean, per_class map<string,struct<support:int,accuracy:double>>"
FRAME_RECORDS = "recording string, topic string, source_index int, bag_timestamp_ns long, timestamp_s double, frame_number int, metadata map<string,string>"


class SourceError(ValueError):
    """Files that aren't there, or don't hold what they must."""


def source_path() -> Column:
    return F.col("_metadata.file_path")


def read_annotations(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """episode, num_frames, fps, position, start_frame, end_frame (included), label: a row for each segment; recordings without segments have one row with nulls. A missing
    episode takes its folder's name. A file is a recording, or with lines each of its lines is one."""
    raw = spark.read.schema(ANNOTATION).option("multiLine", not lines).json(paths).withColumn("__path", source_path())
    folder = F.element_at(F.split("__path", "/"), -2)
    rows = raw.select(F.coalesce("episode", folder).alias("episode"), "num_frames", "fps", F.posexplode_outer("segments").alias("position", "s"))
    return rows.select("episode", "num_frames", "fps", "position", "s.start_frame", "s.end_frame", "s.label")


def read_features(spark: SparkSession, root: str, globs: str) -> DataFrame:
    """Token tables of a comma-separated list of globs, each file once, with source (its path)."""
    names = sorted({g.strip() for g in globs.split(",") if g.strip()})
    if not names:
        raise SourceError("no glob given")
    part = [spark.read.parquet(f"{root}/{g}").withColumn("source", source_path()) for g in names]
    first_of = [p.withColumn("__g", F.lit(i)) for i, p in enumerate(part)]
    out = first_of[0]
    for p in first_of[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = out.groupBy("source").agg(F.min("__g").alias("__first"))
    return out.join(first, "source").where("__g = __first").drop("__g", "__first")


def list_frames(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png"), natural: bool = True) -> DataFrame:
    """directory, name, path, length, modificationTime, frame (dense, from 0, in natural or lexical order). Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(root)
    parts = F.split("path", "/")
    named = files.select("path", "length", "modificationTime", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("directory"))
    return index_frames(named, natural)


def index_frames(files: DataFrame, natural: bool = True) -> DataFrame:
    """files (directory, name, ..) with frame."""
    key = natural_key(F.col("name")) if natural else F.col("name")
    return files.withColumn("frame", F.row_number().over(Window.partitionBy("directory").orderBy(key, "name")) - 1)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise SourceError(f"no {what}")
    return df


def parse_hands(json: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, frame_name, side (1 right), keypoints, hand_pose, global_orient from a map of frame name to hands; entries without a pose go, of equal sides the last stays."""
    frames = json.select(*keys, F.explode(F.from_json(value, f"map<string,{HAND}>")).alias("frame_name", "hands"))
    each = frames.select(*keys, "frame_name", F.posexplode("hands").alias("k", "h")).where("h.mano_params.hand_pose is not null")
    row = F.struct(F.col("h.kpts_3d").alias("keypoints"), F.col("h.mano_params.hand_pose").alias("hand_pose"), F.col("h.mano_params.global_orient").alias("global_orient"))
    last = each.groupBy(*keys, "frame_name", F.col("h.is_right").cast("int").alias("side")).agg(F.max_by(row, "k").alias("r"))
    return last.select(*keys, "frame_name", "side", "r.*")


def read_hand_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.option("wholetext", True).text(paths).select(F.element_at(F.split(source_path(), "/"), -2).alias("recording"), "value")
    return parse_hands(files, ["recording"])


def read_pairs_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(PAIRS).option("header", True).csv(paths)


def check_pairs(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Violations: output_index that isn't its row's number from 0 within the keys (none: pairs of one recording)."""
    w = Window.partitionBy(*(keys or [])).orderBy("output_index")
    rows = pairs.withColumn("expected", F.row_number().over(w) - 1)
    return rows.where("output_index is null or output_index <> expected").select(*(keys or []), "output_index", "expected", F.lit("not_contiguous").alias("reason"))


def parse_key_values(text: Column) -> Column:
    """`k=v;k=v;` to a map: NUL and ; trimmed, parts without = dropped, the first = splits, of equal keys the last stays."""
    parts = F.filter(F.split(F.regexp_replace(text, r"[\x00;]+$", ""), ";"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value")))
    later = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(later)


def camera_info(fields: Column) -> Column:
    """struct width, height, fx, fy, ppx, ppy, coeffs from such a map."""
    number = lambda k: fields[k].cast("double")
    return F.struct(
        fields["width"].cast("int").alias("width"), fields["height"].cast("int").alias("height"), *[number(k).alias(k) for k in ("fx", "fy", "ppx", "ppy")],
        F.transform(F.split(fields["coeffs"], ","), lambda x: F.trim(x).cast("double")).alias("coeffs"),
    )


def read_frame_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(FRAME_RECORDS).parquet(*([paths] if isinstance(paths, str) else paths))


def check_frame_index(records: DataFrame, topics: list[str]) -> DataFrame:
    """Violations by recording and topic: without records, times that don't rise. That data and metadata agree in number is check_topic_counts()."""
    w = Window.partitionBy("recording", "topic").orderBy("source_index")
    step = records.withColumn("bad", F.col("timestamp_s") <= F.lag("timestamp_s").over(w))
    n = step.groupBy("recording", "topic").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("falling"))
    want = records.select("recording").distinct().withColumn("topic", F.explode(F.array(*[F.lit(t) for t in topics])))
    both = want.join(n, ["recording", "topic"], "left")
    reason = F.when(F.col("n").isNull(), "empty_topic").when(F.col("falling") > 0, "not_increasing")
    return both.withColumn("reason", reason).where("reason is not null")


def check_topic_counts(records: DataFrame, data: str, metadata: str) -> DataFrame:
    """Recordings whose data and metadata topics differ in number."""
    n = records.groupBy("recording").agg(F.count_if(F.col("topic") == data).alias("n_data"), F.count_if(F.col("topic") == metadata).alias("n_metadata"))
    return n.where("n_data <> n_metadata").withColumn("reason", F.lit("counts_differ"))


def parse_timestamps(lines: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """keys, index (from 0), timestamp_s of lines that aren't blank; what isn't a number is null, for the rules to find."""
    rows = lines.where(F.trim(value) != "")
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("index"), F.trim(value).try_cast("double").alias("timestamp_s"))


def read_timestamps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    whole = spark.read.option("wholetext", True).text(paths).select(source_path().alias("source"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return parse_timestamps(whole, ["source"], "line")


def read_eval_summaries(spark: SparkSession, paths: str | list[str], pattern: str = r"/([^/]+)/seed_(\d+)/fold_([^/]+)/") -> DataFrame:
    """Evaluation files with variant, path_seed and fold from their paths; rules: check_eval_summaries()."""
    raw = spark.read.schema(EVALUATION).option("multiLine", True).json(paths).withColumn("path", source_path())
    get = lambda k: F.regexp_extract("path", pattern, k)
    return raw.withColumns({"variant": get(1), "path_seed": get(2).try_cast("int"), "fold": get(3)})


def check_eval_summaries(rows: DataFrame) -> DataFrame:
    from timeloom.operators.rules import reasons

    share = lambda c: F.col(c).between(0, 1) & ~F.isnan(c)
    rules = {c: share(c) for c in ("validation_accuracy", "validation_f1_macro", "validation_f1_weighted")} | {"validation_samples": F.col("validation_samples") > 0, "seed": F.col("seed") == F.col("path_seed")}
    return reasons(rows, rules, ["path"])


def index_contact_files(files: DataFrame, keys: list[str], name: str = "file_name", frame: str = "meta_frame") -> DataFrame:
    """keys, file, frame, rule: the frame number inside the file, else the digits at the end of its name."""
    digits = F.regexp_extract(F.regexp_replace(name, r"(\.[A-Za-z]\w*)+$", ""), r"(\d+)$", 1).try_cast("long")
    return files.select(*keys, F.col(name).alias("file"), F.coalesce(F.col(frame).cast("long"), digits).alias("frame"), F.when(F.col(frame).isNotNull(), "metadata").otherwise("name").alias("rule"))


def duplicate_frames(index: DataFrame, keys: list[str]) -> DataFrame:
    return index.groupBy(*keys, "rule", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("reason", F.lit("duplicate_frame"))


def parse_log(json: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """id and the entry's fields from an object keyed by id. schema: a struct's fields in DDL."""
    return json.select(F.explode(F.from_json(value, f"map<string,struct<{schema}>>")).alias("id", "e")).select("id", "e.*")


def read_log(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return parse_log(spark.read.option("wholetext", True).text(paths), schema)


def read_history_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(HISTORY).option("header", True).csv(paths).withColumn("source", source_path())


def policy_frames(frames: DataFrame, episodes: DataFrame, index: str = "index", bucket: int = 4096) -> DataFrame:
    """frames with episode_index: half-open ranges [dataset_from_index, dataset_to_index). Ranges are cut at multiples of `bucket`, so the join has an equal key and
    neither side needs to be small."""
    low, high = F.floor(F.col("dataset_from_index") / bucket), F.floor((F.col("dataset_to_index") - 1) / bucket)
    cut = episodes.where("dataset_to_index > dataset_from_index").select("episode_index", F.col("dataset_from_index").alias("__from"), F.col("dataset_to_index").alias("__to"), F.explode(F.sequence(low, high)).alias("__bucket"))
    rows = frames.withColumn("__bucket", F.floor(F.col(index) / bucket)).join(cut, "__bucket")
    return rows.where((F.col(index) >= F.col("__from")) & (F.col(index) < F.col("__to"))).drop("__bucket", "__from", "__to")


def read_policy_dataset(spark: SparkSession, root: str) -> DataFrame:
    return policy_frames(spark.read.parquet(f"{root}/frames"), spark.read.parquet(f"{root}/episodes"))


def load_dims(spark: SparkSession, labels: str, objects: str, roles: str) -> dict[str, DataFrame]:
    return {"labels": spark.read.json(labels), "objects": spark.read.json(objects), "roles": spark.read.json(roles)}


def check_dims(labels: DataFrame, objects: DataFrame, roles: DataFrame) -> DataFrame:
    """name and reason: labels twice, roles of unknown labels or objects, limits that aren't positive."""
    twice = labels.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("label_twice").alias("reason"))
    lost = roles.join(objects, roles["object"] == objects["name"], "left_anti").select(F.col("object").alias("name"), F.lit("unknown_object").alias("reason"))
    odd = roles.join(labels, "label", "left_anti").select(F.col("label").alias("name"), F.lit("unknown_label").alias("reason"))
    low = objects.where("max_instances is null or max_instances < 1").select("name", F.lit("limit_not_positive").alias("reason"))
    return twice.unionByName(lost).unionByName(odd).unionByName(low)


def explode_tracks(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, track, frame, x0, y0, x1, y1, score, handedness from tracks (keys, track, entries); entries that weren't detected go."""
    e = tracks.select(*keys, "track", F.explode("entries").alias("e")).where("e.det")
    return e.select(*keys, "track", "e.frame", *[F.col("e.det_box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "score"))], F.col("e.det_handedness").alias("handedness"))


def read_detector_tracks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    kind = "recording string, track string, entries array<struct<frame:long,det:boolean,det_box:array<double>,det_handedness:int>>"
    return explode_tracks(spark.read.schema(kind).parquet(*([paths] if isinstance(paths, str) else paths)), ["recording"])
