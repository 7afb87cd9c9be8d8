"""Exact filtered nearest neighbours for many queries in one job.

Distances are cosine distances, rounded to nine decimals so that ties fall to
the smaller id whatever the summation order. A corpus row meets only queries
equal to it in the filter columns and in dimension.

Two plans, chosen by measured size. A bounded query set travels to the tasks
and the corpus is scanned where it lies: no corpus shuffle, at most a running
top-k per task leaves it. A larger query set, or one with many results, is cut
into blocks that each walk the corpus (``walk.py``) and return results alone.
Scores of groups cut the corpus too: each pair of blocks is one bounded task.
Either way block products are matrix products on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import first_by, top_k
from sightline.operators.walk import NearestRows, walk
from sightline.operators.walk import by_space as _by_space
from sightline.operators.walk import unit_rows as _matrix

QUERY_BYTES = 64 << 20
STATE_BYTES = 256 << 20
#: Results of a query set whose candidates may be gathered from all tasks.
GATHERED = 1 << 20
BLOCK_ROWS = 4096
DECIMALS = 9


@dataclass
class _Queries:
    """Unit query rows and their values of ``query_id`` per space."""

    ids: dict[str, list] = field(default_factory=dict)
    rows: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, table: pa.Table) -> _Queries:
        made = cls()
        for space, positions in _by_space(table["_space"]):
            part = table.take(pa.array(positions))
            made.ids[space] = part["_query"].to_pylist()
            made.rows[space] = _matrix(part["_vector"])
        return made


class _Scan:
    """Top-k candidates of a stream of corpus batches.

    Per query only the k best distances seen so far are remembered; a row
    passes when it is among the k best up to now, so what passes contains the
    k best of the stream.
    """

    def __init__(self, queries: _Queries, k: int):
        self.queries, self.k = queries, k
        self.best: dict[str, np.ndarray] = {}

    def candidates(self, batch: pa.RecordBatch | pa.Table):
        """(query ids, row positions, distances) of passing pairs."""
        for space, positions in _by_space(batch["_space"]):
            queries = self.queries.rows.get(space)
            if queries is None or not len(queries):
                continue
            rows = _matrix(batch["_vector"].take(pa.array(positions)))
            ids = self.queries.ids[space]
            if space not in self.best:
                self.best[space] = np.full((len(queries), self.k), np.inf)
            best = self.best[space]
            for start in range(0, len(queries), 512):
                stop = min(start + 512, len(queries))
                distance = np.round(1.0 - queries[start:stop] @ rows.T, DECIMALS)
                limit = best[start:stop].max(axis=1, keepdims=True)
                merged = np.concatenate([best[start:stop], distance], axis=1)
                cut = np.partition(merged, self.k - 1, axis=1)[:, : self.k]
                best[start:stop] = cut
                bound = np.minimum(limit, cut.max(axis=1, keepdims=True))
                q, r = np.nonzero(distance <= bound)
                if len(q):
                    yield [ids[start + i] for i in q], positions[r], distance[q, r]


def _emit(batch, carried: Sequence[str], query_type: pa.DataType, found):
    query_ids, positions, distances = found
    taken = [batch[c].take(pa.array(positions)) for c in carried]
    taken = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken]
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, query_type), *taken, pa.array(distances, pa.float64())],
        names=["_query", *carried, "distance"],
    )


def space_of(df: DataFrame, match_on: Sequence[str], vector: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in match_on]
    return F.concat_ws("\u001f", *parts, F.size(vector).cast("string"))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "vector",
    vector: str = "vector",
    row_id: str = "embedding_id",
    match_on: Sequence[str] = (),
    keep: Sequence[str] = (),
    query_bytes: int = QUERY_BYTES,
    gathered: int = GATHERED,
) -> DataFrame:
    """The ``k`` nearest corpus rows per query: ``query_id``, ``row_id``,
    ``keep``, ``distance`` and ``rank`` (by distance, then ``row_id``).

    One size check of the query set runs here; the search itself is lazy.
    """
    spark = queries.sparkSession
    carried = [row_id, *[c for c in keep if c != row_id]]
    asked, searched, count, numbers = _prepared(
        queries, corpus, query_id, query_vector, vector, match_on, carried
    )
    query_arrow = _arrow_type(asked, "_query")
    schema = _schema(asked, searched, carried)

    if numbers * 8 > query_bytes or count * k > gathered:
        names = ["_query", *carried, "distance", "rank"]
        found = walk(
            asked, searched, F.col("_query"), [row_id], lambda left: NearestRows(left, k, names), schema + ", rank int", count
        )
        return found.withColumnRenamed("_query", query_id)
    held = spark.sparkContext.broadcast(_Queries.of(asked.toArrow()))

    def scan(batches):
        state = _Scan(held.value, k)
        for batch in batches:
            for found in state.candidates(batch):
                yield _emit(batch, carried, query_arrow, found)

    found = searched.mapInArrow(scan, schema)
    ranked = top_k(
        found, ["_query"], [F.col("distance"), F.col(row_id)], k, salt=F.col(row_id)
    )
    return ranked.withColumnRenamed("_query", query_id)


def nearest_of_groups(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    group: str,
    tie: Sequence[str],
    most: int | None = None,
    query_id: str = "query_id",
    row_id: str = "embedding_id",
    match_on: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Of each query's ``k`` nearest rows the best of every ``group`` (ties by
    ``tie``, nulls last, then ``row_id``) with its ``rank`` by distance and
    group; the first ``most`` of them where given.
    """
    carried = list(dict.fromkeys([row_id, group, *tie, *keep]))
    asked, searched, count, _ = _prepared(queries, corpus, query_id, "vector", "vector", match_on, carried)
    names, ties = ["_query", *carried, "distance", "rank"], [*tie, row_id]
    found = walk(
        asked, searched, F.col("_query"), [row_id],
        lambda left: NearestRows(left, k, names, group, ties, most), _schema(asked, searched, carried) + ", rank int", count,
    )
    return found.withColumnRenamed("_query", query_id)


class _GroupScan:
    """Nearest row of each corpus group per query, one batch at a time."""

    def __init__(self, queries: _Queries, group: str, tie: Sequence[str]):
        self.queries, self.group, self.tie = queries, group, list(tie)

    def candidates(self, batch: pa.RecordBatch | pa.Table):
        table = pa.table({c: batch[c] for c in ("_space", "_vector", self.group, *self.tie)})
        for space, positions in _by_space(table["_space"]):
            queries = self.queries.rows.get(space)
            if queries is None or not len(queries):
                continue
            part = table.take(pa.array(positions))
            keys = [(c, "ascending") for c in (self.group, *self.tie)]
            order = pc.sort_indices(part, sort_keys=keys, null_placement="at_end")
            part, positions = part.take(order), positions[order.to_numpy()]
            rows = _matrix(part["_vector"])
            codes = part[self.group].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            lengths = np.diff(np.r_[starts, len(codes)])
            ids = self.queries.ids[space]
            for start in range(0, len(queries), 256):
                stop = min(start + 256, len(queries))
                distance = np.round(1.0 - queries[start:stop] @ rows.T, DECIMALS)
                least = np.minimum.reduceat(distance, starts, axis=1)
                at = np.where(
                    distance == np.repeat(least, lengths, axis=1), np.arange(len(codes)), len(codes)
                )
                first = np.minimum.reduceat(at, starts, axis=1)
                q = np.repeat(np.arange(stop - start), len(starts))
                yield [ids[start + i] for i in q], positions[first.ravel()], least.ravel()


def nearest_per_group(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    group: str,
    tie: Sequence[str],
    query_id: str = "query_id",
    query_vector: str = "vector",
    vector: str = "vector",
    match_on: Sequence[str] = (),
    keep: Sequence[str] = (),
    query_bytes: int = QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each query the nearest row of every corpus group, without a limit
    on the number of neighbours (ties by ``tie``, nulls last).

    Rows of a group lie together in each task's input, so what leaves a task
    is about one row per query and group.
    """
    spark = queries.sparkSession
    carried = list(dict.fromkeys([group, *tie, *keep]))
    asked, searched, count, numbers = _prepared(
        queries, corpus, query_id, query_vector, vector, match_on, carried
    )
    searched = searched.sortWithinPartitions(group)
    query_arrow = _arrow_type(asked, "_query")
    schema = _schema(asked, searched, carried)
    if numbers * 8 <= query_bytes:
        held = spark.sparkContext.broadcast(_Queries.of(asked.toArrow()))

        def scan(batches):
            state = _GroupScan(held.value, group, tie)
            for batch in batches:
                for found in state.candidates(batch):
                    yield _emit(batch, carried, query_arrow, found)

        found = searched.mapInArrow(scan, schema)
    else:

        def scanner(left: pa.Table):
            return _GroupScan(_Queries.of(left), group, tie)

        found = _blocks(asked, searched, scanner, count, carried, query_arrow, schema, block_rows)
    order = [F.col("distance"), *[F.coalesce(F.col(t), _last(searched, t)) for t in tie]]
    return first_by(found, ["_query", group], order).withColumnRenamed("_query", query_id)


class _MeanScan:
    """Best corpus rows per group of query vectors, one batch at a time.

    A row's score for a group is the mean of the group's two best positive
    similarities to it (the best alone when only one is positive).
    """

    def __init__(self, queries: _Queries, k: int):
        self.queries, self.k = queries, k
        self.groups = {}
        for space, ids in queries.ids.items():
            codes = {g: n for n, g in enumerate(dict.fromkeys(ids))}
            numbers = np.array([codes[g] for g in ids])
            order = np.argsort(numbers, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(numbers[order]) != 0])
            self.groups[space] = (list(codes), order, starts)

    def candidates(self, batch: pa.RecordBatch | pa.Table):
        for space, positions in _by_space(batch["_space"]):
            if space not in self.groups:
                continue
            names, order, starts = self.groups[space]
            rows = _matrix(batch["_vector"].take(pa.array(positions)))
            queries = self.queries.rows[space][order]
            lengths = np.diff(np.r_[starts, len(order)])
            similar = queries @ rows.T
            similar = np.where(similar > 0, similar, -np.inf)
            best = np.maximum.reduceat(similar, starts, axis=0)
            at = np.where(similar == np.repeat(best, lengths, axis=0), np.arange(len(order))[:, None], len(order))
            first = np.minimum.reduceat(at, starts, axis=0)
            usable = np.isfinite(best)
            columns = np.broadcast_to(np.arange(rows.shape[0]), first.shape)
            similar[first[usable], columns[usable]] = -np.inf
            second = np.maximum.reduceat(similar, starts, axis=0)
            score = np.where(np.isfinite(second), (best + np.where(np.isfinite(second), second, 0)) / 2, best)
            score = np.where(usable, np.round(score, DECIMALS), -np.inf)
            k = min(self.k, score.shape[1])
            limit = np.partition(score, -k, axis=1)[:, -k][:, None]
            g, r = np.nonzero(usable & (score >= limit))
            if len(g):
                yield [names[i] for i in g], positions[r], score[g, r]


def best_groups(
    vectors: DataFrame,
    corpus: DataFrame,
    *,
    group: str,
    row_id: str,
    keep: Sequence[str] = (),
    k: int = 2,
    query_bytes: int = QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` corpus rows with the highest mean of two best similarities
    to the vectors of each group: group, row_id, keep, score, rank.

    A group (the few vectors of one track or identity) stays in one block.
    """
    spark = vectors.sparkSession
    carried = [row_id, *keep]
    asked, searched, count, numbers = _prepared(vectors, corpus, group, "vector", "vector", (), carried)
    query_arrow = _arrow_type(asked, "_query")
    schema = _schema(asked, searched, carried)
    if numbers * 8 <= query_bytes:
        held = spark.sparkContext.broadcast(_Queries.of(asked.toArrow()))

        def scan(batches):
            state = _MeanScan(held.value, k)
            for batch in batches:
                for found in state.candidates(batch):
                    yield _emit(batch, carried, query_arrow, found)

        found = searched.mapInArrow(scan, schema)
    else:

        def scanner(left: pa.Table):
            return _MeanScan(_Queries.of(left), k)

        found = _blocks(asked, searched, scanner, count, carried, query_arrow, schema, block_rows)
    ranked = top_k(found, ["_query"], [F.desc("distance"), F.col(row_id)], k)
    return ranked.withColumnsRenamed({"_query": group, "distance": "score"})


class _PairScan:
    """Scores of pairs of groups: for each left vector its best cosine among the right group's, mean of the best two.

    With ``margin`` groups are named ``name``, ``APART``, ``mark``: one doesn't meet itself or another mark, and
    only what comes within the margin of a group's best leaves.
    """

    STEP = 256

    def __init__(self, left: pa.Table, least: float, margin: float | None = None):
        self.margin = margin
        names = left["_query"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        left = left.take(pa.array(order, pa.int64()))
        self.names, self.starts = np.unique(np.array([names[i] for i in order], dtype=object), return_index=True)
        self.spaces = {s: (at, _matrix(left["_vector"].take(pa.array(at)))) for s, at in _by_space(left["_space"])}
        self.rows, self.least = left.num_rows, least

    def candidates(self, right: pa.Table):
        group = right.schema.names[0]
        order = pc.sort_indices(right, sort_keys=[(group, "ascending")])
        keys = right[group].take(order).combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        first = order.to_numpy()[starts]
        spaces = [(s, at, _matrix(right["_vector"].take(order).take(pa.array(at)))) for s, at in _by_space(right["_space"].take(order))]
        ends = np.append(self.starts[1:], self.rows)
        if self.margin is not None:
            names, marks = _named(right[group].take(pa.array(first)).to_pylist())
        begin = 0
        while begin < len(self.names):
            stop = begin + 1
            while stop < len(self.names) and ends[stop] - self.starts[begin] <= self.STEP:
                stop += 1
            low, high = self.starts[begin], ends[stop - 1]
            best = np.zeros((high - low, len(starts)))  # a negative cosine, or none, counts as 0
            for space, at, vectors in spaces:
                if space not in self.spaces:
                    continue
                mine, rows = self.spaces[space]
                inside = np.flatnonzero((mine >= low) & (mine < high))
                if not len(inside):
                    continue
                # Vectors of one space need not fill every group.
                owner = np.searchsorted(starts, at, side="right") - 1
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                top = np.maximum.reduceat(np.minimum(rows[inside] @ vectors.T, 1.0), cuts, axis=1)
                place = np.ix_(mine[inside] - low, owner[cuts])
                best[place] = np.maximum(best[place], top)
            cuts = self.starts[begin:stop] - low
            sizes = np.diff(np.append(cuts, high - low))
            one = np.maximum.reduceat(best, cuts, axis=0)
            at = np.where(best == np.repeat(one, sizes, axis=0), np.arange(high - low)[:, None], high - low)
            holder = np.minimum.reduceat(at, cuts, axis=0)
            best[holder, np.arange(len(starts))] = -1.0
            two = np.maximum.reduceat(best, cuts, axis=0)
            score = np.round(np.where((sizes > 1)[:, None], (one + two) / 2, one), DECIMALS)
            if self.margin is not None:
                own, mark = _named(self.names[begin:stop])
                score[(own[:, None] == names) | ((mark != "")[:, None] & (marks != "") & (mark[:, None] != marks))] = -1.0
                score[score < score.max(axis=1, keepdims=True) - self.margin - 1e-9] = -1.0
            q, r = np.nonzero(score >= self.least)
            if len(q):
                yield [self.names[begin + i] for i in q], first[r], score[q, r]
            begin = stop


#: Between a group's name and its mark.
APART = "\u001f"


def _named(groups: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [g.rpartition(APART) for g in groups]
    return np.array([p[0] for p in parts], str), np.array([p[2] for p in parts], str)


def group_scores(
    left: DataFrame, right: DataFrame, *, group: str, least: float, margin: float | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(source, other, score) of every pair of vector groups with a score of ``least`` or more.

    A group's few vectors stay in one block; each pair of blocks is one
    bounded task, and only pairs that reach ``least`` leave it. With ``margin``
    (see ``_PairScan``) at least all pairs within it of a group's best are
    found, and few others; blocks then follow the number of vectors.
    """
    if least <= 0:
        raise ValueError("least must be positive: every pair reaches zero")
    asked, searched, count, _ = _prepared(left, right, group, "vector", "vector", (), [group])
    schema = _schema(asked, searched, [group])
    if margin is not None:
        block_rows = min(4 * block_rows, max(block_rows // 4, count // 12))
    found = _blocks(
        asked, searched, lambda t: _PairScan(t, least, margin), count, [group], _arrow_type(asked, "_query"), schema, block_rows
    )
    return found.select(F.col("_query").alias("source"), F.col(group).alias("other"), F.col("distance").alias("score"))


def _last(df: DataFrame, column: str) -> Column:
    """A value that sorts a missing number or text last."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "string":
        return F.lit("\U0010ffff")
    return F.lit(float("inf")) if kind in ("double", "float") else F.lit((1 << 63) - 1 if kind == "bigint" else (1 << 31) - 1)


def _prepared(queries, corpus, query_id, query_vector, vector, match_on, carried):
    asked = queries.filter(F.size(query_vector) > 0).select(
        F.col(query_id).alias("_query"),
        space_of(queries, match_on, query_vector).alias("_space"),
        F.col(query_vector).cast("array<float>").alias("_vector"),
    )
    searched = corpus.filter(F.size(vector) > 0).select(
        *carried,
        space_of(corpus, match_on, vector).alias("_space"),
        F.col(vector).cast("array<float>").alias("_vector"),
    )
    size = asked.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("_vector").cast("bigint")), F.lit(0))
    ).first()
    return asked, searched, int(size[0]), int(size[1])


def _schema(asked: DataFrame, searched: DataFrame, carried: Sequence[str]) -> str:
    fields = [f"_query {asked.schema['_query'].dataType.simpleString()}"]
    fields += [f"`{c}` {searched.schema[c].dataType.simpleString()}" for c in carried]
    return ", ".join([*fields, "distance double"])


def _blocks(asked, searched, scanner, count, carried, query_arrow, schema, block_rows):
    """Every pair of a query block and a corpus block as one bounded task."""
    rows = searched.count()
    query_blocks = max(1, -(-count // block_rows))
    row_blocks = max(1, -(-rows // (4 * block_rows)))

    def spread(df: DataFrame, value: Column, own: int, other: int, names) -> DataFrame:
        # Both sides must hash the block numbers as the same type.
        mine = F.pmod(F.xxhash64(value), F.lit(own)).cast("int").alias(names[0])
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1])
        return df.select("*", mine, every)

    left = spread(asked, F.col("_query"), query_blocks, row_blocks, ("_qb", "_rb"))
    right = spread(searched, F.col(carried[0]), row_blocks, query_blocks, ("_rb", "_qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_query", *carried, "distance"]
        types = [query_arrow, *[right.schema.field(c).type for c in carried], pa.float64()]
        target = pa.schema(list(zip(names, types)))
        parts = []
        if left.num_rows and right.num_rows:
            state = scanner(left)
            for found in state.candidates(right):
                parts.append(_emit(right, carried, query_arrow, found))
        return pa.Table.from_batches(parts, schema=target) if parts else target.empty_table()

    return (
        left.groupBy("_qb", "_rb")
        .cogroup(right.groupBy("_qb", "_rb"))
        .applyInArrow(cell, schema)
    )


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
