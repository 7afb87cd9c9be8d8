"""Literal cases for timelines, search and suggestions."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import search, suggest, timeline
from sightline.sources.reference import checked_reference

SLICES = "asset_id string, slice_pos int, slice_index int, time_seconds double, frame_interval double"
LABELS = "asset_id string, slice_pos int, model_key string, label string, confidence double, item_pos int"


def test_tag_runs_break_on_a_frame_without_the_tag(spark):
    slices = spark.createDataFrame([("a", i, i, float(i), 1.0) for i in range(4)], SLICES)
    labels = spark.createDataFrame([("a", i, "m", "tag-a", 0.9, 0) for i in (0, 1, 3)], LABELS)
    rows = timeline.tag_segments(slices, labels).orderBy("start_seconds").collect()
    assert [(r["start_seconds"], r["end_seconds"]) for r in rows] == [(0.0, 2.0), (3.0, 4.0)]


def test_cutoff_keeps_five_then_the_near_ones(spark):
    hosts = [("q", i, 0.001 * i, i) for i in range(1, 6)] + [("q", 6, 1.0, 6)]
    df = spark.createDataFrame(hosts, "query_id string, host_id int, distance double, embedding_id int")
    assert search.candidate_cutoff(df).count() == 5


def test_bad_interval_fails_the_job(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0)], "asset_id string, start_seconds double, end_seconds double")
    with pytest.raises(Exception):
        timeline.merge_intervals(df, ["asset_id"]).collect()


def test_single_host_with_one_performer_scores_forty(spark):
    faces = spark.createDataFrame([(6,)], "face_id bigint")
    none = spark.createDataFrame([], "face_id bigint, host_type string, host_id bigint")
    seen = spark.createDataFrame([(6, "video", 7101)], none.schema)
    links = spark.createDataFrame([("video", 7101, 78)], "host_type string, host_id bigint, performer_id bigint")
    people = spark.createDataFrame([(78, "Only")], "performer_id bigint, performer_name string")
    evidence = suggest.host_evidence(suggest.linked_hosts(none, seen, links, faces))
    blank = spark.createDataFrame([], "face_id bigint, performer_id bigint")
    rows = suggest.host_only(evidence, blank, people).collect()
    assert [(r["performer_id"], r["confidence"]) for r in rows] == [(78, 40.0)]


def test_reference_rows_must_match_the_manifest(spark):
    manifest = spark.createDataFrame([("p", 2, 2)], "pack_id string, dimension int, identity_count bigint")
    people = spark.createDataFrame([("p", 0), ("p", 1)], "pack_id string, ordinal bigint")
    vectors = spark.createDataFrame([("p", 0, [1.0, 0.0])], "pack_id string, ordinal bigint, vector array<float>")
    with pytest.raises(ValueError):
        checked_reference(manifest, people, vectors)
    both = vectors.union(vectors.withColumn("ordinal", F.lit(1).cast("bigint")))
    assert checked_reference(manifest, people, both).count() == 2
