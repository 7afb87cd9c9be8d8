"""What the payload parser reads as numbers, strings and vectors, and that it reads them once."""

from pyspark.sql import functions as F

from sightline.sources import payload

ANALYSIS = (
    '{"capabilities":{"detection":{"face":[{"bbox":[0,"1","1,000.5",2],"score":true,"A":1,"a":"2","label":"x"},'
    '{"bbox":[0,true,1,2]},{"x":1,"y":2,"w":3,"h":"4","label":"{x}"},{"x":[1,2],"y":2,"w":3,"h":4}]},'
    '"embedding":{"m":[{"vector":[1,"2",null,true,0.5],"norm":"3"},{"vector":[1,2.5,1e3]},{"vector":["a"]},{"vector":[]}]}}}'
)


def _slices(spark):
    return spark.createDataFrame([("a", 0, ANALYSIS)], "asset_id string, slice_pos int, analysis string")


def test_numbers_and_strings(spark):
    rows = payload.explode_detections(_slices(spark)).orderBy("det_index").collect()
    got = [(r["det_index"], tuple(r["bbox"]), r["score"], r["label"], r["metadata"]) for r in rows]
    assert got == [
        (0, (0.0, 1.0, 1000.5, 2.0), 0.0, "x", {"a": "2"}),
        (2, (1.0, 2.0, 4.0, 6.0), 0.0, "{x}", {"x": "1", "y": "2", "w": "3", "h": "4"}),
    ]
    vectors = payload.explode_embeddings(_slices(spark)).orderBy(F.col("item_order")).collect()
    assert [(r["vector"], r["norm"]) for r in vectors] == [([1.0, 2.0, 0.5], 3.0), ([1.0, 2.5, 1000.0], None)]


def test_boxes_and_vectors_are_not_computed_again_by_a_filter(spark):
    for made in (payload.explode_detections(_slices(spark)), payload.explode_embeddings(_slices(spark))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter (" in line]
        assert not any("$.bbox" in line or "$.vector" in line for line in filters)


def test_samples_are_put_together_from_payloads_parsed_once(spark, small):
    """The last scan counts its keys before it runs: what it reads has no parsing below it."""
    import __spark_entry__ as entry

    plan = entry.queries()["face_samples"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan


def test_vectors_are_read_in_one_pass_over_slices_and_one_over_branches(spark, small):
    from sightline.registry.ingest import _slices
    from sightline.session import scratch_dir
    from sightline.sources import payload

    folder = scratch_dir(spark, "slices")
    _slices(spark, small).write.parquet(folder)
    made = payload.explode_embeddings(spark.read.parquet(folder))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
