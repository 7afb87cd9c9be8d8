"""Greedy selection of unlike vectors: streamed from key to key, and in rounds where a key is large."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators.greedy import greedy_select, pick_dissimilar


def test_streamed_and_in_rounds_alike(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 40, "b": 700, None: 9, "d": 1}
    rows = [
        (k, n, float(rng.integers(0, 9)), rng.normal(size=3).round(2).tolist())
        for k, many in sizes.items()
        for n in range(many)
    ]
    held = [("a", rng.normal(size=3).tolist()), ("b", rng.normal(size=3).tolist()), ("gone", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, n bigint, q double, v array<double>").repartition(5)
    known = spark.createDataFrame(held, "k string, v array<double>")
    how = {"vector": "v", "quality": "q", "tie": ["n"], "threshold": 0.6, "limit": 4}

    def expected(some):
        for k in sizes:
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
            for at in pick_dissimilar([r[3] for r in own], 0.6, 4, [v for key, v in some if key == k]):
                yield (str(k), own[at][1])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for records in (7, 10_000):  # keys end within and across batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            for given, frame in (([], None), (held, known)):
                made = greedy_select(df, ["k"], held=frame, **how)
                assert "MapInArrow" in made._jdf.queryExecution().toString()  # no rounds over all keys
                assert sorted((str(r["k"]), r["n"]) for r in made.collect()) == sorted(expected(given))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    made = greedy_select(df, ["k"], held=known, hot_rows=100, batch=16, **how)
    assert sorted((str(r["k"]), r["n"]) for r in made.collect()) == sorted(expected(held))
    assert greedy_select(df.filter(F.lit(False)), ["k"], **how).isEmpty()
