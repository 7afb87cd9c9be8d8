"""Blocks of queries that walk the corpus, against the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sightline.operators import search, similar, walk
from sightline.operators.knn import nearest, nearest_of_groups

KEPT = "embedding_id bigint, host_type string, host_id bigint, source_key string, kind string, kind_family string, modality string, is_semantic boolean, section_index bigint, start_seconds double, end_seconds double, vector array<float>, created_at timestamp"


@pytest.fixture(scope="module")
def vectors(spark):
    """Ten vectors a host; some hosts hold copies of others, so that distances tie."""
    rng = np.random.default_rng(9)
    made = np.round(rng.normal(size=(900, 8)), 1).astype("float32")
    made[300:400] = made[0:100]
    made[17] = 0
    rows = [
        (
            i, "video" if (i // 10) % 3 else "image", i // 10, "visual", *(("visual.semantic.v1", "semantic.v1") if i // 5 % 2 else ("visual.feature.v1", "feature.v1")),
            "visual", bool(i // 5 % 2), i % 5, float(i % 5) if i % 5 else None, float(i % 5 + 1) if i % 5 else None, made[i].tolist(), None,
        )
        for i in range(900)
    ]
    return spark.createDataFrame(rows, KEPT).repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(walk, "BLOCK_QUERIES", 100)
    monkeypatch.setattr(walk, "LEAST_QUERIES", 10)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def asked_of(vectors):
    return vectors.filter("section_index = 0").withColumnRenamed("embedding_id", "query_id")


def test_nearest_has_the_rows_of_the_gathered_search(spark, vectors):
    options = {"match_on": similar.MATCH_ON, "keep": ["host_id"]}
    walked = nearest(asked_of(vectors), vectors, 70, gathered=0, **options)
    assert rows_of(walked) == rows_of(nearest(asked_of(vectors), vectors, 70, **options))
    # Exact where it is found: nothing is shuffled after the search.
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_nearest_of_groups_is_the_best_of_each_host(spark, vectors):
    options = {"match_on": similar.MATCH_ON}
    best = search.best_per_host(nearest(asked_of(vectors), vectors, 90, keep=["host_id", "section_index", "start_seconds"], **options))
    found = nearest_of_groups(asked_of(vectors), vectors, 90, group="host_id", tie=["section_index", "start_seconds"], **options)
    columns = ["query_id", "host_id", "embedding_id", "distance"]
    assert rows_of(found.select(*columns)) == rows_of(best.select(*columns))
    few = nearest_of_groups(asked_of(vectors), vectors, 90, group="host_id", tie=["section_index", "start_seconds"], most=3, **options)
    assert rows_of(few) == rows_of(found.filter("rank <= 3"))


@pytest.mark.parametrize("host_type", ["video", "image"])
def test_similar_hosts_are_the_blended_matches(spark, vectors, host_type):
    asked = similar.asset_queries(vectors, vectors.select("host_type", "host_id").distinct()).cache()
    # A sum's order may show in the ninth place.
    columns = ["asset_type", "asset_id", "host_id", F.round("distance", 7), "role_count", "embedding_id", "section_index", "role"]
    blended = similar.blend_visual(similar.similar_matches(asked, vectors, host_type=host_type, k=80)).cache()
    found = similar.similar_hosts(asked, vectors, host_type=host_type, k=80)
    assert rows_of(found.select(*columns)) == rows_of(blended.select(*columns))
    few = similar.diversify(similar.similar_hosts(asked, vectors, host_type=host_type, k=80, most=9), 7)
    places = ["asset_type", "asset_id", "host_id", "role", "position"]
    assert rows_of(few.select(*places)) == rows_of(similar.diversify(blended, 7).select(*places))


def test_audio_leaves_no_row_for_each_query_and_host(spark, small):
    plan = entry.queries()["audio_similar"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_page_counts_every_host(spark, tmp_path, monkeypatch):
    """More hosts than a result may have: the page's total still counts them all."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype("float32").tolist(), i % 10) for i in range(5200)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    from sightline.registry import search as registry

    whole = registry._asked
    monkeypatch.setattr(registry, "_asked", lambda s, f: whole(s, f).filter(F.col("query_id") < 20))
    found = entry.queries()["page"](spark, str(tmp_path)).filter("query_id = 0").collect()
    best = entry.queries()["best_per_host"](spark, str(tmp_path)).filter("query_id = 0").count()
    assert len(found) == 12 and {r["total_count"] for r in found} == {best} and best > 500
