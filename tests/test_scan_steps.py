"""Steps that tracks, clusters and emission share: scans of whole keys, sums of vectors, emission by table."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.operators import emit, tracks
from sightline.operators.centroids import vector_sums
from sightline.operators.seams import runs_of_keys, seam_scan
from tests.test_tracks import SAMPLE, sample


def test_sorted_batches_are_cut_between_keys():
    key = ["a"] * 3 + [None] * 2 + ["b"] * 9
    batch = pa.RecordBatch.from_pydict({"k": key, "x": list(range(len(key)))})
    for size in (1, 2, 5, 100):
        pieces = [batch.slice(at, size) for at in range(0, len(key), size)]
        made = list(runs_of_keys(iter(pieces), ["k"]))
        assert sum((m.column("x").to_pylist() for m in made), []) == list(range(len(key)))
        seen = [set(m.column("k").to_pylist()) for m in made]
        assert all(not (a & b) for n, a in enumerate(seen) for b in seen[n + 1 :])


def test_long_and_short_keys_scan_alike(spark):
    rows = [("long", n, 1) for n in range(40)] + [(f"s{k}", n, 1) for k in range(30) for n in range(5)]

    def step(pdf: pd.DataFrame, state, last):
        before = int(state) if state else 0
        total = before + pdf["x"].cumsum()
        end = before + int(pdf["x"].sum())
        return pdf[["k", "n"]].assign(total=total), str(end).encode()

    df = spark.createDataFrame(rows, "k string, n bigint, x bigint")
    made = seam_scan(df, ["k"], ["n"], step, "k string, n bigint, total bigint", bucket=F.col("n"), chunk_rows=7)
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    assert sorted((r["k"], r["n"], r["total"]) for r in made.collect()) == sorted((k, n, n + 1) for k, n, _ in rows)


def test_vectors_are_summed_without_a_row_per_element(spark):
    rng = np.random.default_rng(7)
    rows = [(None if n % 5 == 0 else f"k{n % 3}", n, [float(x) for x in rng.normal(0, 1, 3)], float(n)) for n in range(60)]
    rows.append(("k0", 99, [1.0, 2.0], 9.0))
    df = spark.createDataFrame(rows, "k string, n int, vector array<double>, w double").repartition(5)
    made = vector_sums(df, ["k"], weight=F.col("w"), first=F.col("n"))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: (r["vector_sum"], r["weight_sum"], r["vector_count"]) for r in made.collect()}
    for key in (None, "k0", "k1", "k2"):
        mine = [r for r in rows if r[0] == key and len(r[2]) == 3]
        assert np.allclose(got[key][0], sum(np.array(r[2]) * r[3] for r in mine))
        assert got[key][1:] == (sum(r[3] for r in mine), len(mine))


def test_clusters_see_conflicts_as_before():
    busy = tracks._Busy([[5, 9], [1, 2]])
    busy.add([[2, 4], [20, 20]])
    assert [busy.shares([[n, n]]) for n in (0, 1, 3, 4, 9, 10, 19, 20, 21)] == [
        False, True, True, True, True, False, False, True, False
    ]


def test_emission_builds_the_table_asked_for(spark):
    rows = [sample("a", t, 1, (1, 0)) + ("t",) for t in (1, 2, 30)] + [sample("a", 3, 2, (0, 1)) + ("u",)]
    tracked = spark.createDataFrame(rows, SAMPLE + ", track_key string")
    resolved = spark.createDataFrame([("a", "t", "f")], "asset_id string, track_key string, face_key string")
    vectors = tracked.select(
        "asset_id", "track_key", "frame_order", "sample_pos", F.col("embeddings")[0]["vector"].alias("vector"), F.lit(1.0).alias("quality")
    )
    faces = spark.createDataFrame([("f",), ("g",)], "face_key string")
    each = {n: emit.emit_faces(tracked, resolved, vectors, faces, only=(n,)) for n in emit.TABLES}
    assert {n: list(made) for n, made in each.items()} == {n: [n] for n in emit.TABLES}
    rows = {n: made[n].collect() for n, made in each.items()}
    assert [(r["start_seconds"], r["sample_count"]) for r in sorted(rows["segments"])] == [(1.0, 2), (30.0, 1)]
    assert [(r["segment_count"], r["retained_sample_count"]) for r in rows["appearances"]] == [(2, 2)]
    assert len(rows["embeddings"]) == 1 and len(rows["faces"]) == 1
    assert sorted((r["frame_order"], r["ref_key"]) for r in rows["detections"]) == [(1, "f"), (3, None), (30, "f")]
