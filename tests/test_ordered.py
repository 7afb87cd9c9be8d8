"""Ordered scans: plain and bucketed windows give the same rows, whatever the keys."""

import random

import pytest
from pyspark.sql import functions as F

import sightline.operators.worklist as worklist
from sightline.operators.ordered import RANGE, bucketed_scan, has_hot_key, ranged
from sightline.operators.tags import upsert_tags
from sightline.operators.worklist import batches


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), i, rnd.random()) for i in range(600)]
    return spark.createDataFrame(data, "k string, t long, i long, v double").cache()


def test_plain_and_bucketed_scans_agree(rows):
    order = [F.asc_nulls_first("t"), F.col("i")]
    bucket = F.floor(F.col("t") / 7)

    def scan(hot):
        return bucketed_scan(
            rows, ["k"], bucket, order, rank="r", lag={"before": "v"}, running_sum={"s": "i"},
            running_max_before={"m": "v"}, group_rows="n", hot=hot,
        )

    plain, split = (sorted(map(tuple, scan(hot).collect()), key=str) for hot in (False, True))
    assert plain == split and len(plain) == 600
    assert {r[0] for r in plain} == {"a", "b", None}


def test_hot_keys_are_noticed(rows):
    assert has_hot_key(rows, ["k"], 100) and not has_hot_key(rows, ["k"], 600)
    assert not has_hot_key(rows.limit(0), ["k"], 0)


def test_ranges_follow_the_order_of_texts(spark):
    names = [(f"video:{i:05d}",) for i in range(900)]
    got = ranged(spark.createDataFrame(names, "name string"), ["name"]).groupBy(RANGE).agg(F.min("name"), F.max("name")).orderBy(RANGE).collect()
    assert len(got) > 1 and all(x[2] < y[1] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("hot", [False, True])
def test_batches_take_text_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(worklist, "has_hot_key", lambda *_: hot)
    signatures = spark.createDataFrame([(f"video:{i:04d}", "s" if i % 3 else None) for i in range(200)], "asset_id string, signature string")
    got = {r["asset_id"]: (r["signature"], r["batch_no"]) for r in batches(signatures, 50).collect()}
    for signature in ("s", None):
        own = sorted(a for a, (s, _) in got.items() if s == signature)
        assert [got[a][1] for a in own] == [n // 50 for n in range(len(own))]
    assert len(got) == 200


def test_new_tags_with_a_common_prefix_are_numbered_in_name_order(spark):
    old = spark.createDataFrame([(4, "video:old")], "tag_id long, name string")
    names = spark.createDataFrame([(f"video:{i:03d}",) for i in range(120)], "name string")
    got = {r["name"]: r["tag_id"] for r in upsert_tags(old, names).collect()}
    assert got == {"video:old": 4} | {f"video:{i:03d}": 5 + i for i in range(120)}
