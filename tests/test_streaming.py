"""Streaming windows per track against the batch operator, samples out of order and late."""

import random

from pyspark.sql import functions as F

from sightline.operators.timeline import observation_windows
from sightline.session import scratch_dir
from sightline.streaming.windows import track_windows_stream

SAMPLE = "asset_id bigint, track_key string, at double, score double, span double"


def run_stream(spark, batches, delay):
    """Batches one after the other; the stream sees each as a micro-batch of its own."""
    folder, out, log = (scratch_dir(spark, n) for n in ("samples", "made", "log"))

    def go():
        stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).json(folder)
        made = track_windows_stream(stream.withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long"))), delay=delay)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
        return made.schema

    for rows in batches:
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").json(folder)
        schema = go()  # the query is stopped and resumed from its state each time
    found = spark.read.schema(schema).parquet(out)
    at = [F.unix_micros(c).alias(c) for c in ("first_at", "end_at")]
    return sorted(tuple(r) for r in found.select("asset_id", "track_key", *at, "sample_count", "top_score").collect())


def test_windows_per_track_equal_the_batch_operator(spark):
    rnd, rows = random.Random(3), []
    for asset, span in ((1, 1.0), (2, 5.0), (3, None)):
        for track in ("a", "b"):
            at = 0.0
            for _ in range(40):
                at += rnd.choice([0.5, 1.0, 2.0, 7.75, 8.0, 8.25, 20.0, 21.0])
                rows.append((asset, track, at, rnd.choice([None, round(rnd.random(), 3)]), span))
    # Samples of up to 30 seconds apart trade places; the last row moves the watermark past all of them.
    rows.sort(key=lambda r: r[2] + rnd.uniform(0, 30))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[(9, "end", 5000.0, 1.0, 1.0)]]
    got = run_stream(spark, batches, "60 seconds")
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SAMPLE + ", frame_order long")
    plain = observation_windows(
        frame.withColumnsRenamed({"at": "time_seconds", "span": "frame_span"}), ("asset_id", "track_key")
    ).collect()
    expected = sorted(
        (r["asset_id"], r["track_key"], round(r["start_seconds"] * 1e6), round(r["end_seconds"] * 1e6), r["sample_count"]) for r in plain
    )
    assert [g[:5] for g in got] == expected and len({r[0] for r in expected}) == 3
    best = {}
    for g in got:
        inside = [r[3] for r in rows if r[:2] == g[:2] and g[2] <= r[2] * 1e6 <= g[3] and r[3] is not None]
        best[g[:3]] = max(inside) if inside else None
    assert [g[5] for g in got] == [best[g[:3]] for g in got]


def test_late_samples_are_dropped_and_gaps_differ_by_track(spark):
    def at(asset, second, score, span=1.0):
        return asset, "t", 1000.0 + second, score, span

    batches = [
        [at(1, 0, 0.1), at(1, 8, 0.2), at(2, 0, 0.3, 5.0), at(2, 19, 0.4, 5.0)],
        [at(7, 100, 0.5)],
        [at(1, 4, 0.9), at(1, 95, 0.6)],  # the watermark stands at 90: the first of them is late
        [at(7, 400, 0.7)],
        [at(7, 800, 0.7)],
    ]
    got = run_stream(spark, batches, "10 seconds")
    made = lambda asset, a, b, n, top: (asset, "t", (1000 + a) * 10**6, (1000 + b) * 10**6, n, top)
    assert got == [made(1, 0, 9, 2, 0.2), made(1, 95, 96, 1, 0.6), made(2, 0, 24, 2, 0.4), made(7, 100, 101, 1, 0.5), made(7, 400, 401, 1, 0.7)]
