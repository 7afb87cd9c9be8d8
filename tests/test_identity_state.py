"""Stored identities that batches are folded into, against the plain operator over all of them."""

import math
import random

from pyspark.sql import functions as F

from sightline.operators import identity as ident
from sightline.operators.identity_state import SCHEMA, IdentityState
from sightline.session import scratch_dir

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
ASSIGNED = f"face_key string, asset_id string, track_key long, sample_count long, track_quality double, cover_box {BOX}, cover_quality double"
ANCHORS = "face_key string, asset_id string, track_key long, vector_pos long, model_key string, quality double, vector array<float>"


def content(df):
    return {r["face_key"]: r.asDict(recursive=True) for r in df.collect()}


def unit(rnd, close=None):
    angle = rnd.uniform(0, 2 * math.pi) if close is None else close + rnd.uniform(-0.05, 0.05)
    return [math.cos(angle), math.sin(angle)]


def test_batches_fold_like_the_plain_operator(spark):
    rnd = random.Random(9)
    people = [
        (f"p{i}", None, "provisional", None, None, None, None, 1, 0.5, None, None, 0.0, [f"a{i}"], [("m", 0.5, unit(rnd))])
        for i in range(60)
    ]
    state = IdentityState(spark, scratch_dir(spark, "state"), buckets=16)
    state.put(spark.createDataFrame(people, SCHEMA))
    plain = spark.createDataFrame(people, SCHEMA)
    for epoch in range(3):
        # Keys that aren't stored, null keys, one busy identity, assets known by another case.
        keys = [rnd.choice(["p1", "p1", f"p{rnd.randrange(4)}", "nobody", None]) for _ in range(40)]
        tracks = [(k, rnd.choice([f"a{rnd.randrange(50)}", "A1"]), t, rnd.randrange(9), rnd.random(), (0.0, 0.0, 0.4, 0.4), rnd.random()) for t, k in enumerate(keys)]
        vectors = [(k, a, t, i, "m", rnd.random(), unit(rnd, rnd.choice([None, 1.0]))) for k, a, t, *_ in tracks for i in range(2)]
        assigned, fresh = spark.createDataFrame(tracks, ASSIGNED), spark.createDataFrame(vectors, ANCHORS)
        before = set(state.store.snapshot()["tables"]["identities"]["files"])
        assert state.fold(assigned, fresh, "w", epoch)
        assert not state.fold(assigned, fresh, "w", epoch)
        plain = ident.update_identities(plain, assigned, fresh)
        plain = spark.createDataFrame(plain.collect(), SCHEMA)
        assert content(state.read()) == content(plain)
        # Four of sixty identities are written anew; files of other buckets stay as they are.
        added = set(state.store.snapshot()["tables"]["identities"]["files"]) - before
        assert sum(state.store.snapshot()["tables"]["identities"]["files"][f]["rows"] for f in added) <= 4
    assert content(state.known(spark.createDataFrame([("p2",), ("x",)], "face_key string"))).keys() == {"p2"}
    assert max(len(r["anchors"]) for r in content(state.read()).values()) == 12
    assert content(state.read(1)) == content(spark.createDataFrame(people, SCHEMA))


def test_commit_of_changes(spark):
    def person(key, n):
        return (key, None, "promoted", None, None, None, None, n, 0.5, None, None, 0.0, ["a"], [])

    base = spark.createDataFrame([person(k, 1) for k in "abc"], SCHEMA)
    state = IdentityState(spark, scratch_dir(spark, "state"), buckets=2)
    state.put(base, "w", 0)
    after = spark.createDataFrame([person("a", 5), person("d", 1)], SCHEMA)
    changes = ident.commit_identities(state.read(), after, base.filter("face_key <> 'c'"))
    assert state.commit(changes, "w", 1) and not state.commit(changes, "w", 1)
    assert {k: r["observation_count"] for k, r in content(state.read()).items()} == {"a": 5, "c": 1, "d": 1}
    assert content(state.read()) == content(ident.apply_commit(base, changes).select(*base.columns))
    assert state.read(1).filter(F.col("face_key") == "b").count() == 1
