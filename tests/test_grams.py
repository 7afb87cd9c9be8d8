"""The text index against the plain search for seeds."""

import random

import pytest

from sightline.operators.grams import TextIndex
from sightline.operators.search import text_seeds
from sightline.session import scratch_dir

SCHEMA = "host_type string, host_id bigint, title string, code string, updated_at bigint, _n int"


def rows_of(df):
    return sorted(map(str, df.select("host_type", "host_id", "title", "code", "score", "seed_rank").collect()))


@pytest.fixture(scope="module")
def titles(spark):
    rnd = random.Random(2)
    words = ["Garden", "garden gate", "Gate", "Öl", "ab", "the", "  the end ", "x", "日本語", "İstanbul", "end", ""]
    rows = [
        (rnd.choice(["video", "image"]), i, rnd.choice([None, " ".join(rnd.choices(words, k=rnd.randrange(1, 5)))]), rnd.choice([None, f"C-{i:04d}"]), i % 17, 1)
        for i in range(800)
    ]
    rows += [("video", 900, "the garden gate end", "Zq9", 3, 1)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_seeds_equal_the_plain_search(spark, titles):
    index = TextIndex.build(titles, scratch_dir(spark, "titles"), ("title", "code"), buckets=8)
    fields = ("title", "code")
    for text in ("garden", "GATE e", "the end", "c-01", "zq9", "日本語", "öl ", "x", "nowhere at all", "garden gate garden", "End"):
        plain = text_seeds(titles, text, fields, limit=700)
        assert rows_of(index.seeds(text, limit=700)) == rows_of(plain), text
        if len(text.strip()) >= 3:
            scanned, hits = index.matching(text).count(), text_seeds(titles, text, fields, limit=10_000).count()
            assert hits <= scanned <= hits + 80
    with pytest.raises(ValueError):
        index.seeds("  ")
    again = TextIndex(spark, index.path)
    assert rows_of(again.seeds("zq9")) == rows_of(text_seeds(titles, "zq9", fields))


def test_an_empty_table(spark, titles):
    index = TextIndex.build(titles.filter("host_id < 0"), scratch_dir(spark, "titles"), ("title",), buckets=2)
    assert index.seeds("garden").collect() == [] and index.seeds("g").collect() == []


def test_long_lists_are_dealt_out_to_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sightline.operators import grams

    monkeypatch.setattr(grams, "TASK_ROWS", 500, raising=False)
    hosts = spark.range(8000).selectExpr("'video' AS host_type", "id AS host_id", "'same words' AS title", "id % 9 AS updated_at").repartition(4)
    index = TextIndex.build(hosts.unionByName(hosts.limit(50)), scratch_dir(spark, "titles"), ("title",), buckets=2)
    for name in ("rows", "postings"):
        written = spark.read.parquet(f"{index.path}/{name}").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
        assert written < 1000, name
    assert index.candidates("same words").count() == 8000
    assert dict(spark.read.parquet(f"{index.path}/pieces").collect()) == dict.fromkeys(["sam", "ame", "me ", "e w", " wo", "wor", "ord", "rds"], 8000)
