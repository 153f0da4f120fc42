"""Queries against their SQL on tables with planted ties, thresholds hit exactly, and short ends."""

import duckdb

from compare import assert_same
from timeloom import queries


def same(folder, spark, names, **tables):
    """The queries on tables given as rows and their DDL, against DuckDB on the same files."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    for name in names:
        assert_same(queries.queries()[name](spark, str(folder)), con, queries.oracle_sql()[name])


VECTORS = "vec_id long, embedding array<float>, label int"


def test_check_bundle_with_a_short_last_recording(spark, tmp_path):
    for n in (120, 149, 150, 256, 299, 306):
        same(tmp_path / str(n), spark, ["check_bundle"], embeddings=([(i, [0.5] * 64, i % 10) for i in range(n)], VECTORS))


def test_boxes_of_equal_score_all_count(spark, tmp_path):
    rows = [(o, n, float(n % 9 + 1), o * 3 + n * (n + o) % 5, 1000.0 + n % 3, o + n) for o in range(40) for n in range(8)]
    same(tmp_path, spark, ["box_nms", "topk_detections"], lineitem=(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_extendedprice double, l_suppkey long"))


def test_entries_just_at_a_threshold_are_not_above_it(spark, tmp_path):
    at = [0.05, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.0]
    rows = [(i, [at[(i * k + k // 8) % 8] for k in range(64)], i % 10) for i in range(60)]
    names = ["bridge_mask_gaps", "split_observations", "ranked_donors", "ranked_donors_all", "mask_diff", "ablation_boxes", "pixel_components", "seeded_components", "check_subset", "dilate_pixels", "occupancy", "visible_fraction"]
    same(tmp_path, spark, names, embeddings=(rows, VECTORS))


def test_frames_without_a_positive_area_have_no_verdict(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 3, ("click", "view")[i % 2], (0.0, 30.0, float(i % 5 > 0) * i)[i % 3]) for i in range(100)]
    same(tmp_path, spark, ["reliable_frames"], events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"))


def test_perceptron_quality_weighs_classes_as_the_fit_does(spark, monkeypatch):
    from timeloom.queries import models

    rows = lambda hit: spark.createDataFrame([(1, 0, 0 if i < hit[0] else 1) for i in range(90)] + [(1, 1, 1 if i < hit[1] else 0) for i in range(10)], "recording int, label int, prediction int")
    for hit, better in (((45, 9), True), ((90, 0), False), ((30, 2), False)):
        monkeypatch.setattr(models, "perceptron", lambda s, d, hit=hit: rows(hit))
        assert [tuple(r) for r in models.perceptron_quality(spark, "").collect()] == [(100, better)]
