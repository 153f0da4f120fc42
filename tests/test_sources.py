"""Readers, writers, streams and the registry."""

import json

import pytest
from pyspark.sql import functions as F

from timeloom.plans import registry
from timeloom.plans.flows import experiment_summary, predictions_to_segments, token_table
from timeloom.sources import readers, writers


def test_annotations_go_out_and_come_back(spark, tmp_path):
    seg = spark.createDataFrame([("a", 0, 4, "x"), ("a", 5, 9, "y")], "recording string, start_frame long, end_frame long, label string")
    rec = spark.createDataFrame([("a", 10, 30.0)], "recording string, num_frames int, fps double")
    writers.write_annotations(seg, rec, ["recording"], str(tmp_path / "ann"))
    back = readers.read_annotations(spark, f"{tmp_path}/ann/recording=a/*.txt").orderBy("position").collect()
    assert [(r["episode"], r["num_frames"], r["start_frame"], r["end_frame"], r["label"]) for r in back] == [("a", 10, 0, 4, "x"), ("a", 10, 5, 9, "y")]
    (tmp_path / "e" / "rec7").mkdir(parents=True)
    (tmp_path / "e" / "rec7" / "gt.json").write_text(json.dumps({"num_frames": 3, "fps": 30.0, "segments": []}))
    r = readers.read_annotations(spark, f"{tmp_path}/e/*/gt.json").first()
    assert r["episode"] == "rec7" and r["label"] is None


def test_feature_globs_take_each_file_once(spark, tmp_path):
    for n in ("a1", "a2", "b1"):
        spark.range(2).withColumn("recording", F.lit(n)).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    got = readers.read_features(spark, str(tmp_path), "a*, b*,a1")
    assert got.count() == 6
    with pytest.raises(readers.SourceError):
        readers.read_features(spark, str(tmp_path), " ,")


def test_frames_are_listed_in_natural_order(spark, tmp_path):
    for n in ("f10.png", "f2.png", "f1.PNG", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    got = readers.list_frames(spark, str(tmp_path), ("png", "PNG")).orderBy("frame").collect()
    assert [r["name"] for r in got] == ["f1.PNG", "f2.png", "f10.png"]
    with pytest.raises(readers.SourceError):
        readers.require_rows(readers.list_frames(spark, str(tmp_path), ("gif",)), "frames")


def test_hands_last_of_a_side_wins(spark):
    hand = lambda right, pose: {"is_right": right, "kpts_3d": [[0.0, 0.0, 0.0]], "mano_params": {"hand_pose": pose, "global_orient": [0.0]} if pose else {}}
    text = json.dumps({"f1": [hand(True, [1.0]), hand(True, [2.0]), hand(False, None)], "f2": []})
    got = readers.parse_hands(spark.createDataFrame([("r", text)], "recording string, value string"), ["recording"]).collect()
    assert [(r["frame_name"], r["side"], r["hand_pose"]) for r in got] == [("f1", 1, [2.0])]


def test_key_values_and_camera(spark):
    df = spark.createDataFrame([("width=640;height=480;fx=1.5;fy=2;ppx=3;ppy=4;coeffs=0.1, 0.2;bad;a=b=c;\0;",)], "t string").withColumn("m", readers.parse_key_values(F.col("t")))
    r = df.select("m", readers.camera_info(F.col("m")).alias("c")).first()
    assert r["m"]["a"] == "b=c" and "bad" not in r["m"] and r["c"]["width"] == 640 and r["c"]["coeffs"] == [0.1, 0.2]


def test_pairs_csv_and_its_contract(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, 0, 5, 0.1, 1, 6, 0.2), ("r", 2, 1, 6, 0.3, 2, 7, 0.4)], "recording string, output_index int, camera_1_source_index int, camera_1_frame_number int, camera_1_timestamp_s double, camera_2_source_index int, camera_2_frame_number int, camera_2_timestamp_s double")
    out = writers.stereo_rows(rows)
    assert out.first()["camera_1_timestamp_s"] == "0.100000000" and out.first()["camera_2_minus_camera_1_ms"] == "100.000000"
    writers.write_ordered_csv(out, str(tmp_path / "p"))
    back = readers.read_pairs_csv(spark, f"{tmp_path}/p/recording=r")
    assert [r["expected"] for r in readers.check_pairs(back).collect()] == [1]


def test_timestamps_and_logs(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0.1\n\n0.2\nx\n")
    got = readers.read_timestamps(spark, str(tmp_path / "t.txt")).orderBy("index").collect()
    assert [r["timestamp_s"] for r in got] == [0.1, 0.2, None]
    (tmp_path / "log.json").write_text(json.dumps({"v1": {"title": "a", "duration": 3.0}, "v2": {"title": "b"}}))
    log = readers.read_log(spark, str(tmp_path / "log.json"), "title string, duration double")
    assert {r["id"]: r["duration"] for r in log.collect()} == {"v1": 3.0, "v2": None}
    (tmp_path / "h.csv").write_text("epoch,train_loss,train_acc,val_loss,val_acc\n1,0.5,0.4,0.6,0.3\n")
    assert readers.read_history_csv(spark, str(tmp_path / "h.csv")).first()["val_acc"] == 0.3


def test_evaluation_paths_must_agree(spark, tmp_path):
    for seed, said, acc in ((1, 1, 0.5), (2, 3, 1.5)):
        d = tmp_path / "v" / f"seed_{seed}" / "fold_1_to_2"
        d.mkdir(parents=True)
        (d / "evaluation_summary.json").write_text(json.dumps({"validation_accuracy": acc, "validation_f1_macro": 0.4, "validation_f1_weighted": 0.4, "validation_samples": 10, "seed": said, "per_class": {"a": {"support": 3, "accuracy": 0.5}}}))
    rows = readers.read_eval_summaries(spark, f"{tmp_path}/v/*/*/evaluation_summary.json")
    assert {(r["variant"], r["fold"]) for r in rows.collect()} == {("v", "1_to_2")}
    assert {r["reason"] for r in readers.check_eval_summaries(rows).collect()} == {"seed", "validation_accuracy"}


def test_contact_index_prefers_what_the_file_says(spark):
    f = spark.createDataFrame([("r", "rgb_frame000042.png.npz", None), ("r", "rgb_frame000007.npz", 9), ("r", "x.npz", None)], "k string, file_name string, meta_frame long")
    got = {r["file"]: (r["frame"], r["rule"]) for r in readers.index_contact_files(f, ["k"]).collect()}
    assert got == {"rgb_frame000042.png.npz": (42, "name"), "rgb_frame000007.npz": (9, "metadata"), "x.npz": (None, "name")}
    twice = readers.index_contact_files(f.union(f), ["k"])
    assert readers.duplicate_frames(twice.where("frame is not null"), ["k"]).count() == 2


def test_dims_and_tracks(spark):
    labels = spark.createDataFrame([("a",), ("a",)], "label string")
    objects = spark.createDataFrame([("cup", 0)], "name string, max_instances int")
    roles = spark.createDataFrame([("a", "pan"), ("b", "cup")], "label string, object string")
    assert {r["reason"] for r in readers.check_dims(labels, objects, roles).collect()} == {"label_twice", "unknown_object", "unknown_label", "limit_not_positive"}
    kind = "recording string, track string, entries array<struct<frame:long,det:boolean,det_box:array<double>,det_handedness:int>>"
    t = spark.createDataFrame([("r", "t", [(0, True, [1.0, 2.0, 3.0, 4.0, 0.5], 1), (1, False, None, None)])], kind)
    assert [(r["frame"], r["x1"], r["score"]) for r in readers.explode_tracks(t, ["recording"]).collect()] == [(0, 3.0, 0.5)]


def test_reports_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, [1, 2])], "name string, acc double, xs array<int>")
    writers.write_report(rows, str(tmp_path), "r")
    assert "| a | 0.5000 | [1,2] |" in (tmp_path / "r.md").read_text()
    assert spark.read.json(f"{tmp_path}/r_json").first()["xs"] == [1, 2]
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, updated_at int")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted((r["id"], r["v"], r["updated_at"]) for r in writers.upsert_manifest(old, new, "id", 5).collect()) == [(1, "x", 1), (2, "z", 5), (3, "w", 5)]


def test_other_sinks(spark, tmp_path):
    p = spark.createDataFrame([("train", "r", 0, 1, 2, 0.1, 0.2)], "split string, recording string, token_index int, label int, cluster int, x double, y double")
    writers.write_cluster_points(p, f"{tmp_path}/c")
    writers.write_sidecar(p, f"{tmp_path}/s", 3)
    writers.write_frame_predictions(p, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/s").first()["schema_version"] == 3 and spark.read.parquet(f"{tmp_path}/f").count() == 1


def test_registry_names_are_unique():
    @registry.operator("test_double")
    def double(spark, inputs, params):
        return inputs["x"]

    assert registry.build("test_double") is double and "test_double" in registry.names()
    with pytest.raises(ValueError):
        registry.operator("test_double")(double)
    with pytest.raises(KeyError):
        registry.build("nothing")


def test_flow_from_frames_to_segments(spark):
    frames = spark.createDataFrame([("r", i, int(i >= 30)) for i in range(60)], "k string, frame long, label int")
    rec = spark.createDataFrame([("r", 60, 30.0)], "k string, num_frames int, fps double")
    tokens, mapping = token_table(rec, frames, ["k"], 4.0)
    assert tokens.count() == 4 and mapping.count() == 60
    scores = tokens.select("k", "token_index", (F.col("label") == 0).cast("double").alias("p0"), (F.col("label") == 1).cast("double").alias("p1"))
    seg = predictions_to_segments(scores, mapping, ["k"], 2).orderBy("start_frame").collect()
    assert [r["label"] for r in seg] == [0, 1] and seg[0]["start_frame"] == 0 and seg[-1]["end_frame"] == 59


def test_experiment_summary_flags_unequal_support(spark):
    rows = [(v, s, f, 0.5 + 0.1 * (v == "new"), 10 + (v == "new" and s == 2)) for v in ("base", "new") for s in (1, 2) for f in ("1_to_2", "2_to_1")]
    r = spark.createDataFrame(rows, "variant string, seed int, fold string, acc double, support int")
    folds, deltas, bad = experiment_summary(r, "base", "new", "acc")
    assert folds.count() == 4 and bad.count() == 2
    assert {(x["fold"], x["n"], round(x["mean"], 6)) for x in deltas.collect()} == {("1_to_2", 1, 0.1), ("2_to_1", 1, 0.1)}


def test_annotations_of_many_recordings_share_files(spark, tmp_path, monkeypatch):
    from timeloom.queries import files

    monkeypatch.setattr(files, "folder", lambda s, name: str(tmp_path / name))
    users = spark.range(200).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 100 AS user_id", "if(id < 100, 'click', 'a\\n\"b\"') AS event_type", "1.0D AS value")
    users.write.parquet(str(tmp_path / "events.parquet"))
    got = files.annotations_read_back(spark, str(tmp_path)).collect()
    assert sorted((int(r["episode"]), r["position"], r["start_frame"], r["end_frame"], r["label"]) for r in got) == sorted((u, p, p, p, label) for u in range(100) for p, label in ((0, "click"), (1, 'a\n"b"')))
    assert len(list((tmp_path / "annotations").rglob("part-*"))) < 50
