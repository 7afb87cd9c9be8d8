"""Nearest rows for many queries: blocks of queries walk the whole corpus.

A block's queries lie in one task, where the corpus comes past in batches.
Each query keeps its best rows as sorted numbers (rounded distance, then place
in the walk), so what leaves a task are results and nothing has to be merged.
A task holds its block, one batch and the corpus's columns without vectors;
disk takes the corpus once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block at most, and those that a block is worth having.
BLOCK_QUERIES, LEAST_QUERIES = 8192, 256
#: Queries compared with a batch at a time, and queries of one batch of results.
STEP, OUT = 256, 64
UNIT = 1e9
NONE = np.iinfo(np.int64).max


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of one dimension as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def by_space(spaces: pa.Array):
    """Row positions for each distinct space."""
    encoded = spaces.combine_chunks() if isinstance(spaces, pa.ChunkedArray) else spaces
    encoded = encoded.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    for i, space in enumerate(encoded.dictionary.to_pylist()):
        yield space, order[cuts[i] : cuts[i + 1]]


def ranks(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Place of each value among the distinct values in ascending order."""
    encoded = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    encoded = encoded.dictionary_encode()
    place = np.empty(len(encoded.dictionary), np.int64)
    place[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(place))
    return place[encoded.indices.to_numpy(zero_copy_only=False)]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns begins a new combination."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return changed


def walk(
    left: DataFrame,
    right: DataFrame,
    key: Column,
    order: Sequence[str],
    make: Callable[[pa.Table], Best],
    schema: str,
    count: int,
) -> DataFrame:
    """Each block of ``left`` (rows of one ``key`` together, ``count`` rows in all) walks ``right`` in ``order``."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-count // BLOCK_QUERIES), min(2 * cores, -(-count // LEAST_QUERIES)))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    mine = left.select(
        own.alias("_block"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.schema).alias("_right"),
    )
    theirs = right.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_side"),
        F.lit(None).cast(left.schema).alias("_left"), F.struct(*right.columns).alias("_right"),
    )
    places = [F.col(f"_right.{c}").asc_nulls_last() for c in order]
    dealt = mine.unionByName(theirs).repartitionById(blocks, F.col("_block")).sortWithinPartitions("_side", *places)

    def run(batches):
        held, state = [], None
        for batch in batches:
            cut = int(np.searchsorted(batch["_side"].to_numpy(), 1))
            if cut:
                held.append(pa.RecordBatch.from_struct_array(batch["_left"].slice(0, cut)))
            if cut < batch.num_rows:
                if not held:
                    return
                state = state or make(pa.Table.from_batches(held))
                state.add(pa.table(pa.RecordBatch.from_struct_array(batch["_right"].slice(cut))))
        if state:
            yield from state.results()

    return dealt.mapInArrow(run, schema)


class Best:
    """The ``k`` best rows of each target, as numbers: distance in units of 1e-9, then place in the walk."""

    def __init__(self, targets: int, k: int):
        self.k, self.seen, self.payload = k, 0, []
        self.best = np.full((targets, k), NONE)

    def keep(self, rows: pa.Table) -> int:
        """Hold what results need of ``rows``; the place of their first."""
        self.payload.append(rows.drop_columns(["_space", "_vector"]))
        self.seen += rows.num_rows
        return self.seen - rows.num_rows

    def offer(self, targets: np.ndarray, numbers: np.ndarray) -> None:
        merged = np.concatenate([self.best[targets], numbers], axis=1)
        self.best[targets] = np.partition(merged, self.k - 1, axis=1)[:, : self.k]

    def found(self, step: int = OUT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(targets, places, distances in units) of some targets at a time, best first."""
        for start in range(0, len(self.best), step):
            numbers = np.sort(self.best[start : start + step], axis=1)
            at, column = np.nonzero(numbers != NONE)
            numbers = numbers[at, column]
            yield start + at, numbers & 0xFFFFFFFF, numbers >> 32

    def rows(self) -> pa.Table:
        return pa.concat_tables(self.payload).combine_chunks()


def numbered(units: np.ndarray, places: np.ndarray) -> np.ndarray:
    numbers = units.astype(np.int64)
    numbers <<= 32
    numbers |= places
    return numbers


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine distances, rounded to nine decimals, in units of 1e-9."""
    made = queries @ rows.T
    np.subtract(1.0, made, out=made)
    made *= UNIT
    return np.rint(made, out=made)


class NearestRows(Best):
    """The ``k`` nearest rows of each query; ties fall to the earlier row of the walk.

    ``per``: of those, the best row of each value of that column, ties by
    ``tie``; ``most`` of them, by distance and value.
    """

    def __init__(
        self, left: pa.Table, k: int, names: Sequence[str], per: str | None = None, tie: Sequence[str] = (), most: int | None = None
    ):
        super().__init__(left.num_rows, k)
        self.names, self.per, self.tie, self.most = names, per, tie, most
        self.left = left.drop_columns(["_space", "_vector"]).combine_chunks()
        self.spaces = {s: (at, unit_rows(left["_vector"].take(pa.array(at)))) for s, at in by_space(left["_space"])}

    def add(self, rows: pa.Table) -> None:
        base = self.keep(rows)
        for space, at in by_space(rows["_space"]):
            if space not in self.spaces:
                continue
            mine, queries = self.spaces[space]
            vectors = unit_rows(rows["_vector"].take(pa.array(at)))
            for start in range(0, len(mine), STEP):
                units = distances(queries[start : start + STEP], vectors)
                self.offer(mine[start : start + STEP], numbered(units, base + at))

    def results(self):
        rows = self.rows()
        if self.per:
            order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in self.tie], null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            owner = ranks(rows[self.per])
        for targets, places, units in self.found():
            if self.per:
                order = np.lexsort((place[places], units, owner[places], targets))
                order = order[firsts(targets[order], owner[places[order]])]
                order = order[np.lexsort((owner[places[order]], units[order], targets[order]))]
                targets, places, units = targets[order], places[order], units[order]
            begins = np.flatnonzero(firsts(targets))
            rank = np.arange(len(targets)) - np.repeat(begins, np.diff(np.append(begins, len(targets)))) + 1
            if self.most:
                few = rank <= self.most
                targets, places, units, rank = targets[few], places[few], units[few], rank[few]
            taken = rows.take(pa.array(places))
            ids = self.left["_query"].combine_chunks().take(pa.array(targets))
            columns = {"_query": ids} | {c: taken[c].combine_chunks() for c in taken.schema.names}
            columns |= {"distance": pa.array(units / UNIT), "rank": pa.array(rank.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=list(self.names))
