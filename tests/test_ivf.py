"""The vector index against the plain search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import ivf
from sightline.operators.ivf import VectorIndex
from sightline.operators.knn import nearest
from sightline.session import scratch_dir

CORPUS = "embedding_id bigint, kind string, vector array<float>, note string"
K = 10


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["embedding_id"], r["distance"], r["note"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    made = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.25
    rows = [(i, "ab"[i % 3 == 0], v.astype("float32").tolist(), f"n{i}") for i, v in enumerate(made)]
    rows += [(9000 + i, "a", rows[0][2], "tie") for i in range(30)]  # ties fall to the smaller id
    rows += [(9100, "a", [0.0] * 24, "zero"), (9101, "b", [], "none"), (9102, "b", None, "none"), (9103, "a", [1.0, 2.0], "short")]
    corpus = spark.createDataFrame(rows, CORPUS).repartition(4)
    asked = [(i, "ab"[i % 2], (made[i * 7] + rng.normal(size=24) * 0.1).astype("float32").tolist()) for i in range(120)]
    asked += [(500, "a", rows[0][2]), (501, "a", [0.0] * 24), (502, "a", [3.0, 1.0]), (503, "c", rows[1][2]), (504, "a", [])]
    queries = spark.createDataFrame(asked, "query_id bigint, kind string, vector array<float>")
    index = VectorIndex.build(corpus, scratch_dir(spark, "index"), match_on=["kind"], keep=["note"])
    return corpus, queries, index


@pytest.mark.parametrize("query_bytes", [64 << 20, 0])
def test_exact_equals_the_plain_search_and_skips_rings(spark, vectors, query_bytes):
    corpus, queries, index = vectors
    plain = nearest(queries, corpus, K, match_on=["kind"], keep=["note"])
    assert rows_of(index.exact(queries, K, query_bytes=query_bytes)) == rows_of(plain)
    read = index.reads(index.bounded(queries, K, 2), probes=None).filter("query_id < 200").agg(F.sum("rows"), F.sum("all_rows")).first()
    assert read[0] < 0.35 * read[1]


@pytest.mark.parametrize("query_bytes", [64 << 20, 0])
def test_recall_of_the_approximate_search(spark, vectors, query_bytes):
    corpus, queries, index = vectors
    truth = {(r[0], r[2]) for r in rows_of(nearest(queries, corpus, K, match_on=["kind"], keep=["note"]))}
    found = rows_of(index.approximate(queries, K, 8, query_bytes=query_bytes))
    assert len({(r[0], r[2]) for r in found} & truth) >= 0.95 * len(truth)
    read = index.reads(queries, probes=8).filter("query_id < 200").agg(F.sum("rows"), F.sum("all_rows")).first()
    assert read[0] < 0.35 * read[1]
    # What is found is ranked by its true distance.
    exact = {(r[0], r[2]): r[3] for r in rows_of(nearest(queries, corpus, 7000, match_on=["kind"], keep=["note"]))}
    assert all(exact[r[0], r[2]] == r[3] for r in found)


def test_every_row_is_indexed_and_small_tables_work(spark, vectors):
    corpus, queries, index = vectors
    assert sum(index.rings["rows"].to_pylist()) == corpus.filter(F.size("vector") > 0).count()
    again = VectorIndex(spark, index.path)
    assert rows_of(again.exact(queries.filter("query_id < 5"), 3)) == rows_of(index.exact(queries.filter("query_id < 5"), 3))
    few = VectorIndex.build(corpus.filter("embedding_id < 2"), scratch_dir(spark, "index"), keep=["note"])
    got = rows_of(few.exact(queries.filter("query_id < 3").drop("kind"), K))
    assert len(got) == 6
    none = VectorIndex.build(corpus.filter("embedding_id < 0"), scratch_dir(spark, "index"), match_on=["kind"], keep=["note"])
    assert none.exact(queries, K).collect() == []


def test_no_matrix_of_all_queries_and_rings():
    rng = np.random.default_rng(3)
    centres = {"s": ivf._matrix(pa.array(rng.normal(size=(6, 4)).tolist(), pa.list_(pa.float64())))}
    table = {"cell": np.repeat(np.arange(6), 5), "ring": np.tile(np.arange(5), 6), "rows": np.full(30, 2), "low": np.tile(np.arange(5) / 5, 6), "high": np.tile(np.arange(5) / 5 + 0.2, 6)}
    asked = pa.table({"_query": np.arange(1500), "_space": ["s"] * 1500, "_vector": pa.array(rng.normal(size=(1500, 4)).tolist(), pa.list_(pa.float64())), "_bound": rng.uniform(0, 0.6, 1500)})
    for probes in (None, 2):
        plan = ivf._Plan(ivf._Cells(centres, {"s": 0}), {"s": table}, probes)
        scan = ivf._RingScan(asked, plan, 3)
        parts = list(scan._needed("s", slice(None)))
        assert [at for at, _ in parts] == list(range(0, 1500, ivf.STEP))
        need = np.concatenate([n for _, n in parts])
        alike = scan.rows["s"] @ centres["s"].T
        for q in range(0, 1500, 50):
            near = np.argsort(-alike[q], kind="stable")[:2]
            angle = np.arccos(np.clip(alike[q], -1, 1))[table["cell"]]
            apart = np.maximum(np.maximum(table["low"] - angle, angle - table["high"]), 0)
            expected = apart <= asked["_bound"][q].as_py() + ivf.SLACK if probes is None else np.isin(table["cell"], near)
            assert (need[q] == expected).all()
        some = np.array([3, 17, 20])
        assert (np.concatenate([n for _, n in scan._needed("s", some)]) == need[:, some]).all()
