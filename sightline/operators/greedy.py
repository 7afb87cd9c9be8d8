"""Greedy selection of the best, mutually dissimilar vectors per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.vectors import cosine
from sightline.operators.ordered import HOT_ROWS
from sightline.operators.walk import by_space, firsts, unit_rows
from sightline.session import cut_lineage, renamed


def _unit(vectors) -> np.ndarray:
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def pick_dissimilar(vectors, threshold: float, limit: int, held=()) -> list[int]:
    """Positions kept when walking ``vectors`` in order, given those ``held``."""
    units = _unit(vectors) if len(vectors) else np.zeros((0, 0))
    chosen = list(_unit(held)) if len(held) else []
    kept: list[int] = []
    for position in range(len(units)):
        if len(kept) >= limit:
            break
        candidate = units[position]
        same = [c for c in chosen if len(c) == len(candidate)]
        if same and max(float(np.dot(candidate, c)) for c in same) >= threshold:
            continue
        chosen.append(candidate)
        kept.append(position)
    return kept


class _Walk:
    """Rows of sorted keys as they come: what is kept of the key at hand are vectors, ``limit`` new ones at most."""

    def __init__(self, keys: Sequence[str], vector: str, threshold: float, limit: int):
        self.keys, self.vector, self.threshold, self.limit = list(keys), vector, threshold, limit
        self.key, self.kept, self.room = None, [], limit

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        """Positions of the rows kept."""
        codes = [batch[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in self.keys]
        begins = np.flatnonzero(firsts(*codes)).tolist()
        own = batch["_own"].to_numpy(zero_copy_only=False)
        spaces = [(at, unit_rows(batch[self.vector].take(pa.array(at)))) for _, at in by_space(batch["_size"])]
        kept: list[int] = []
        for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
            key = tuple(batch[k][begin].as_py() for k in self.keys)
            if key != self.key:
                self.key, self.kept, self.room = key, [], self.limit
            if self.room:
                kept += self._run(begin, end, own, spaces)
        return np.array(kept, np.int64)

    def _run(self, begin: int, end: int, own: np.ndarray, spaces: list) -> list[int]:
        near = [(at[a:b], rows[a:b]) for at, rows in spaces for a, b in [np.searchsorted(at, (begin, end))] if a < b]
        unlike, found = np.ones(end - begin, bool), []
        for vector in self.kept:
            self._drop(unlike, near, vector, begin)
        given = begin + int(np.searchsorted(own[begin:end], True))  # held rows come first
        for at, rows in near:
            for vector in rows[at < given]:
                self.kept.append(vector)
                self._drop(unlike, near, vector, begin)
        unlike[: given - begin] = False
        while self.room and unlike.any():
            place = int(np.argmax(unlike))
            vector = next(rows[np.searchsorted(at, begin + place)] for at, rows in near if begin + place in at)
            self.kept.append(vector)
            self.room -= 1
            found.append(begin + place)
            self._drop(unlike, near, vector, begin)
            unlike[: place + 1] = False
        return found

    def _drop(self, unlike: np.ndarray, near: list, vector: np.ndarray, begin: int) -> None:
        for at, rows in near:
            if rows.shape[1] == len(vector):
                unlike[at - begin] &= rows @ vector < self.threshold


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    *,
    vector: str,
    quality: str,
    tie: Sequence[str],
    threshold: float,
    limit: int,
    held: DataFrame | None = None,
    batch: int = 64,
    hot_rows: int = HOT_ROWS,
    hot: bool | None = None,
) -> DataFrame:
    """Walk candidates by quality (highest first, then ``tie``) and keep those
    not within ``threshold`` of a kept one, up to ``limit`` per key.

    ``held`` (keys, vector) counts as kept before the walk. A task streams its
    sorted rows from key to key and holds one batch and the vectors kept of
    the key at hand. Keys of more than ``hot_rows`` candidates don't meet in
    one task: they are walked in rounds (``_in_rounds``). ``hot`` false states
    that there are none, where the caller knows; otherwise it is measured.
    """
    keys, tie = list(keys), list(tie)
    how = {"vector": vector, "quality": quality, "tie": tie, "threshold": threshold, "limit": limit}
    if hot is False:
        return _streamed(df, keys, held=held, **how)
    large = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows))
    if large.isEmpty():
        return _streamed(df, keys, held=held, **how)
    named = F.broadcast(large.select(*[F.col(k).alias(f"_large{i}") for i, k in enumerate(keys)]))  # one row for each hot_rows rows at most

    def part(some: DataFrame | None, kind: str) -> DataFrame | None:
        return None if some is None else some.join(named, _same(keys, "_large"), kind)

    cold = _streamed(part(df, "left_anti"), keys, held=part(held, "left_anti"), **how)
    return cold.unionByName(_in_rounds(part(df, "left_semi"), keys, held=part(held, "left_semi"), batch=batch, **how))


def _same(keys: Sequence[str], stem: str) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{stem}{i}")) for i, k in enumerate(keys)])


def _streamed(
    df: DataFrame, keys: list[str], *, vector: str, quality: str, tie: list[str], threshold: float, limit: int, held: DataFrame | None
) -> DataFrame:
    columns = df.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = df.withColumn("_own", F.lit(True))
    if held is not None:
        rows = rows.unionByName(held.select(*keys, vector).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("_size", F.size(vector)).repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, "_own", F.desc(quality), *tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(keys, vector, threshold, limit)
        for some in batches:
            kept = walk.take(some)
            if len(kept):
                yield some.select(columns).take(pa.array(kept))

    return rows.mapInArrow(run, types)


def _in_rounds(
    df: DataFrame,
    keys: list[str],
    *,
    vector: str,
    quality: str,
    tie: list[str],
    threshold: float,
    limit: int,
    held: DataFrame | None = None,
    batch: int = 64,
) -> DataFrame:
    """A key's candidates never meet whole: each round looks at its best
    ``batch`` rows, and only keys with candidates left and room go on, with
    what is similar to a kept vector already dropped. Every round keeps at
    least one row per key, so there are at most ``limit`` rounds.
    """
    columns = df.columns
    order = [F.desc(quality), *[F.col(t) for t in tie]]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left[columns]
        left = left.sort_values("_rank")
        room = limit - int(right["_new"].sum()) if len(right) else limit
        before = list(right["_held"]) if len(right) else []
        kept = pick_dissimilar(list(left[vector]), threshold, room, before)
        return left.iloc[kept][columns]

    source = df.limit(0) if held is None else held
    held_rows = source.select(
        *keys, F.col(vector).alias("_held"), F.lit(0).alias("_new")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool, picked = df, None
    while True:
        window = Window.partitionBy(*keys).orderBy(*order)
        best = pool.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= batch)
        chosen = cut_lineage(
            best.repartition(parts, *keys)
            .groupBy(*keys)
            .cogroup(renamed(held_rows).repartition(parts, *keys).groupBy(*keys))
            .applyInPandas(choose, types)
        )
        picked = chosen if picked is None else picked.unionByName(chosen)
        held_rows = held_rows.unionByName(
            chosen.select(*keys, F.col(vector).alias("_held"), F.lit(1).alias("_new"))
        )

        # Go on with keys that have room and candidates unlike all kept ones.
        # At most a few dozen kept vectors per key ride along with the rows.
        kept = held_rows.groupBy(*keys).agg(
            F.sum("_new").alias("_n"), F.collect_list("_held").alias("_kept")
        )
        open_keys = kept.filter(F.col("_n") < limit)
        pool = (
            pool.join(best.select(*keys, *tie), [*keys, *tie], "left_anti")
            .join(open_keys, keys)
            .filter(~F.exists("_kept", lambda v: cosine(v, F.col(vector)) >= threshold))
            .select(*columns)
        )
        pool = cut_lineage(pool)
        if pool.isEmpty():
            return picked
