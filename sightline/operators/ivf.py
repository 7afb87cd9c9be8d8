"""A vector index of cells and rings: approximate search by probing cells, exact search by skipping what can't matter.

Every row lies in the cell of its nearest centroid, and in a ring of that
cell by its angle to the centroid. Cells are folders of a Parquet table, rows
within them sorted by angle. Centroids are fitted on a bounded sample; every
row is indexed.

Approximate search reads the cells nearest to each query and ranks what is in
them by true distance. Exact search starts from that: the k-th distance found
bounds what can still be among the k best, and as angles between vectors are a
metric, a ring whose angles to its centroid differ from the query's by more
than the bound holds nothing. Skipping rings loses no row; both searches
return the columns and the order of ``knn.nearest``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.operators.knn import DECIMALS, QUERY_BYTES, STATE_BYTES, _arrow_type, _by_space, _emit, _matrix, _prepared, _schema
from sightline.operators.ordered import top_k
from sightline.session import cut_lineage

#: Numbers of the sample that centroids are fitted on, cells of one space at most, rings from 0 to pi.
SAMPLE_NUMBERS, MOST_CELLS, RINGS = 8 << 20, 4096, 128
ROUNDS = 10
_CELLS = "space string, cell int, centroid array<double>"
_RINGS = "space string, cell int, ring int, rows bigint, low double, high double"
#: Queries planned and compared at a time.
STEP = 512
#: Rows of a cell that one task holds against a large query set.
CHUNK_ROWS = 1 << 15
#: Angles are compared with this much to spare: twice what rounding distances to nine decimals can move one near zero.
SLACK = 1e-4


def _fitted(rows: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Unit centroids by spherical k-means from rows drawn without repetition."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.permutation(len(rows))[: min(cells, len(rows))]].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(rows[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


@dataclass
class _Cells:
    """Centroids of every space and where their numbers begin; a space the sample missed has one cell about an axis."""

    centroids: dict[str, np.ndarray]
    first: dict[str, int]

    def of(self, space: str, dim: int) -> np.ndarray:
        return self.centroids[space] if space in self.centroids else np.eye(1, dim)

    def start(self, space: str) -> int:
        return self.first.get(space, -1)  # cell -1 holds all spaces without centroids


@dataclass
class _Plan:
    """Which rings a query needs, worked out for some queries and some rings at a time."""

    cells: _Cells
    rings: dict[str, dict[str, np.ndarray]]
    probes: int | None

    def probed(self, space: str, queries: np.ndarray) -> np.ndarray | None:
        """The cells that an approximate search reads for each query."""
        if self.probes is None or space not in self.rings:
            return None
        centres, out = self.cells.of(space, queries.shape[1]), []
        for at in range(0, len(queries), STEP):
            order = np.argsort(-(queries[at : at + STEP] @ centres.T), axis=1, kind="stable")
            out.append(order[:, : self.probes].astype(np.int32))
        return np.concatenate(out) if out else None

    def needed(self, space: str, queries: np.ndarray, bound: np.ndarray, probed: np.ndarray | None, some: np.ndarray | slice) -> np.ndarray:
        """Of unit queries with their bounds in angle (or cells ``probed``): which need which of ``some`` rings of the space."""
        own = {c: self.rings[space][c][some] for c in ("cell", "low", "high")}
        column = own["cell"] - self.cells.start(space)
        centres = self.cells.of(space, queries.shape[1])
        if probed is not None:
            near = np.zeros((len(queries), len(centres)), bool)
            np.put_along_axis(near, probed.astype(np.int64), True, axis=1)
            return near[:, column]
        cell, at = np.unique(column, return_inverse=True)
        angle = np.arccos(np.clip(queries @ centres[cell].T, -1, 1))[:, at]
        far = own["low"][None, :] - angle
        np.maximum(far, np.subtract(angle, own["high"][None, :], out=angle), out=far)
        return np.maximum(far, 0, out=far) <= bound[:, None] + SLACK


class VectorIndex:
    """An index in a folder: ``rows`` by cell, ``rings`` with their sizes and angles, ``cells`` with the centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        self.row_id, self.keep, self.match_on = info["row_id"], info["keep"], info["match_on"]
        self.schema = StructType.fromJson(info["schema"])
        held = spark.read.schema(_CELLS).parquet(f"{path}/cells").toArrow()  # at most MOST_CELLS a space, bounded by the sample
        centroids, first = {}, {}
        for space, at in _by_space(held["space"]):
            part = held.take(pa.array(at)).sort_by("cell")
            centroids[space] = _matrix(part["centroid"])
            first[space] = part["cell"][0].as_py()
        self.cells = _Cells(centroids, first)
        self.rings = spark.read.schema(_RINGS).parquet(f"{path}/rings").toArrow()  # at most RINGS a cell

    @classmethod
    def build(
        cls,
        corpus: DataFrame,
        path: str,
        *,
        vector: str = "vector",
        row_id: str = "embedding_id",
        match_on: Sequence[str] = (),
        keep: Sequence[str] = (),
        cells: int | None = None,
        seed: int = 7,
    ) -> VectorIndex:
        """Index every row of ``corpus`` with a vector under ``path``; ``cells`` a space, by default the root of its rows."""
        spark = corpus.sparkSession
        carried = [row_id, *[c for c in keep if c != row_id]]
        _, rows, _, _ = _prepared(corpus, corpus, row_id, vector, vector, match_on, carried)
        spaces = rows.groupBy("_space").agg(F.count(F.lit(1)).alias("rows"), F.first(F.size("_vector")).alias("dim")).collect()
        widest = max([r["dim"] for r in spaces], default=1)
        sample = rows.orderBy(F.xxhash64(row_id)).limit(max(1, SAMPLE_NUMBERS // widest)).select("_space", "_vector").toArrow()
        wanted = {r["_space"]: min(MOST_CELLS, cells or max(1, round(r["rows"] ** 0.5))) for r in spaces}
        centroids, first, total = {}, {}, 0
        for space, at in _by_space(sample["_space"]):
            own = _matrix(sample["_vector"].take(pa.array(at)))
            centroids[space] = _fitted(own, wanted[space], seed)
            first[space], total = total, total + len(centroids[space])
        held = spark.sparkContext.broadcast(_Cells(centroids, first))

        def place(batches):
            for batch in batches:
                cell, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for space, at in _by_space(batch["_space"]):
                    own = _matrix(batch["_vector"].take(pa.array(at)))
                    centres = held.value.of(space, own.shape[1])
                    alike = own @ centres.T
                    best = np.argmax(alike, axis=1)
                    cell[at] = held.value.start(space) + best
                    angle[at] = np.arccos(np.clip(alike[np.arange(len(at)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
        placed = rows.mapInArrow(place, ", ".join([*kinds, "cell int", "angle double"]))
        # Ranges of cell and angle: a crowded cell is split by angle.
        placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/rows")
        ring = F.least(F.floor(F.col("angle") * (RINGS / np.pi)), F.lit(RINGS - 1)).cast("int").alias("ring")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        stored.groupBy(F.col("_space").alias("space"), "cell", ring).agg(
            F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
        ).coalesce(1).write.parquet(f"{path}/rings")
        listed = [(s, first[s] + i, c.tolist()) for s, own in centroids.items() for i, c in enumerate(own)]
        spark.createDataFrame(listed, _CELLS).coalesce(1).write.parquet(f"{path}/cells")
        info = json.dumps({"row_id": row_id, "keep": carried[1:], "match_on": list(match_on), "schema": placed.schema.jsonValue()})
        spark.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{path}/info")
        return cls(spark, path)

    def _planner(self, probes: int | None) -> _Plan:
        table = {}
        for space, at in _by_space(self.rings["space"]):
            part = self.rings.take(pa.array(at))
            table[space] = {c: part[c].to_numpy() for c in ("cell", "ring", "rows", "low", "high")}
        return _Plan(self.cells, table, probes)

    def _searched(self, queries: DataFrame, k: int, query_id: str, query_vector: str, probes: int | None, query_bytes: int) -> DataFrame:
        carried = [self.row_id, *self.keep]
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        bound = F.col("_bound") if "_bound" in queries.columns else F.lit(float(np.pi))
        asked, _, count, numbers = _prepared(queries, queries, query_id, query_vector, query_vector, self.match_on, [query_id])
        if "_bound" in queries.columns:
            asked = asked.join(queries.select(F.col(query_id).alias("_query"), "_bound"), "_query")
        else:
            asked = asked.withColumn("_bound", bound)
        query_arrow, schema = _arrow_type(asked, "_query"), _schema(asked, stored, carried)
        plan = self._planner(probes)
        if numbers * 8 <= query_bytes and count * k * 8 <= STATE_BYTES:
            table = asked.toArrow()
            cells = sorted({c for s in [_RingScan(table, plan, k)] for c in s.cells()})
            if len(cells) < 10_000:
                stored = stored.filter(F.col("cell").isin(cells))
            held = self.spark.sparkContext.broadcast(table)

            def scan(batches):
                state = _RingScan(held.value, plan, k)
                for batch in batches:
                    for found in state.candidates(batch):
                        yield _emit(batch, carried, query_arrow, found)

            found = stored.select(*carried, "_space", "_vector", "cell", "angle").mapInArrow(scan, schema)
        else:
            found = self._cogrouped(asked, stored, carried, plan, k, query_arrow, schema)
        ranked = top_k(found, ["_query"], [F.col("distance"), F.col(self.row_id)], k, salt=F.col(self.row_id))
        return ranked.withColumnRenamed("_query", query_id)

    def _cogrouped(self, asked, stored, carried, plan, k, query_arrow, schema) -> DataFrame:
        """A large query set: queries go to the chunks of the cells they need, chunks are bounded."""

        def wanted(batches):
            for batch in batches:
                scan = _RingScan(pa.Table.from_batches([batch]), plan, 1)
                rows, cells = scan.wanted()
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(rows)) for c in batch.columns], pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"]
                )

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
        chunks = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
        sent = asked.mapInArrow(wanted, f"{kinds}, cell int").join(chunks, "cell")
        left = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        rows = stored.select(*carried, "_space", "_vector", "cell", "angle").join(chunks, "cell")
        right = rows.withColumn("chunk", F.pmod(F.xxhash64(self.row_id), F.col("chunks")).cast("int")).drop("chunks")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            types = [query_arrow, *[right.schema.field(c).type for c in carried], pa.float64()]
            target = pa.schema(list(zip(["_query", *carried, "distance"], types)))
            parts = []
            if left.num_rows and right.num_rows:
                parts = [_emit(right, carried, query_arrow, f) for f in _RingScan(left, plan, k).candidates(right)]
            return pa.Table.from_batches(parts, schema=target) if parts else target.empty_table()

        return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(meet, schema)

    # Searches

    def approximate(
        self, queries: DataFrame, k: int, probes: int, *, query_id: str = "query_id", query_vector: str = "vector", query_bytes: int = QUERY_BYTES
    ) -> DataFrame:
        """The ``k`` nearest rows per query among those of its ``probes`` nearest cells, by true distance."""
        return self._searched(queries, k, query_id, query_vector, probes, query_bytes)

    def exact(
        self, queries: DataFrame, k: int, *, probes: int = 2, query_id: str = "query_id", query_vector: str = "vector", query_bytes: int = QUERY_BYTES
    ) -> DataFrame:
        """The ``k`` nearest rows per query among all, equal to ``knn.nearest``; rings beyond the bound are skipped."""
        return self._searched(self.bounded(queries, k, probes, query_id, query_vector, query_bytes), k, query_id, query_vector, None, query_bytes)

    def bounded(self, queries, k, probes, query_id="query_id", query_vector="vector", query_bytes=QUERY_BYTES) -> DataFrame:
        """``queries`` with the angle ``_bound`` of their ``k``-th match in the cells probed: no better than the true one."""
        near = self._searched(queries, k, query_id, query_vector, probes, query_bytes)
        last = near.filter(F.col("rank") == k).select(query_id, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))).alias("_bound"))
        return cut_lineage(queries.select(query_id, query_vector, *self.match_on).join(last, query_id, "left").fillna(float(np.pi), ["_bound"]))

    def reads(self, queries: DataFrame, *, probes: int | None, query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
        """What a search would compare: ``query_id``, ``rings``, ``rows``, and ``all_rows`` of its space.

        With ``probes`` for an approximate search; without, ``queries`` come from ``bounded``.
        """
        asked, *_ = _prepared(queries, queries, query_id, query_vector, query_vector, self.match_on, [query_id])
        if "_bound" in queries.columns:
            asked = asked.join(queries.select(F.col(query_id).alias("_query"), "_bound"), "_query")
        else:
            asked = asked.withColumn("_bound", F.lit(float(np.pi)))
        plan = self._planner(probes)

        def count(batches):
            for batch in batches:
                yield _RingScan(pa.Table.from_batches([batch]), plan, 1).sizes()

        kind = asked.schema["_query"].dataType.simpleString()
        return asked.mapInArrow(count, f"{query_id} {kind}, rings bigint, rows bigint, all_rows bigint")


class _RingScan:
    """Top-k candidates of batches of indexed rows; a query meets only the rings its plan names."""

    def __init__(self, asked: pa.Table, plan, k: int):
        self.k, self.asked, self.plan = k, asked, plan
        self.at, self.ids, self.rows, self.bound, self.probed, self.place = {}, {}, {}, {}, {}, {}
        for space, at in _by_space(asked["_space"]):
            part = asked.take(pa.array(at))
            self.at[space], self.ids[space], self.rows[space] = at, part["_query"].to_pylist(), _matrix(part["_vector"])
            self.bound[space], self.probed[space] = part["_bound"].to_numpy(), plan.probed(space, self.rows[space])
            own = plan.rings.get(space)
            self.place[space] = {} if own is None else {key: i for i, key in enumerate(zip(own["cell"].tolist(), own["ring"].tolist()))}
        self.best: dict[str, np.ndarray] = {}

    def _needed(self, space: str, rings: np.ndarray | slice) -> Iterator[tuple[int, np.ndarray]]:
        """Where some queries begin, and which of ``rings`` they need: no matrix of all queries and all rings is held."""
        probed = self.probed[space]
        for at in range(0, len(self.rows[space]), STEP):
            some = slice(at, at + STEP)
            yield at, self.plan.needed(space, self.rows[space][some], self.bound[space][some], None if probed is None else probed[some], rings)

    def cells(self) -> Iterator[int]:
        for space, rows in self.rows.items():
            own = self.plan.rings.get(space)
            if own is not None and len(rows):
                wanted = np.zeros(len(own["cell"]), bool)
                for _, need in self._needed(space, slice(None)):
                    wanted |= need.any(axis=0)
                yield from np.unique(own["cell"][wanted]).tolist()

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the queries, cells): each cell once for each query that needs a ring of it."""
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for space in self.rows:
            own = self.plan.rings.get(space)
            for at, need in self._needed(space, slice(None)) if own is not None else ():
                q, r = np.nonzero(need)
                both = np.unique(np.stack([self.at[space][at + q], own["cell"][r]]), axis=1)
                rows.append(both[0]), cells.append(both[1].astype(np.int32))
        return np.concatenate(rows), np.concatenate(cells)

    def sizes(self) -> pa.RecordBatch:
        ids, rings, rows, every = [], [], [], []
        for space, asked in self.rows.items():
            own = self.plan.rings.get(space)
            size = own["rows"] if own is not None else np.zeros(0, np.int64)
            ids += self.ids[space]
            if own is None:
                rings += [0] * len(asked)
                rows += [0] * len(asked)
            else:
                for _, need in self._needed(space, slice(None)):
                    rings += need.sum(axis=1).tolist()
                    rows += (need @ size).tolist()
            every += [int(size.sum())] * len(asked)
        kind = self.asked.schema.field("_query").type
        names = [self.asked.schema.names[0], "rings", "rows", "all_rows"]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, pa.int64()) for c in (rings, rows, every)]], names=names)

    def candidates(self, batch: pa.RecordBatch | pa.Table):
        cell = batch["cell"].to_numpy()
        ring = np.minimum((batch["angle"].to_numpy() * (RINGS / np.pi)).astype(np.int64), RINGS - 1)
        for space, positions in _by_space(batch["_space"]):
            if space not in self.rows:
                continue
            key = cell[positions].astype(np.int64) * RINGS + ring[positions]
            order = np.argsort(key, kind="stable")
            positions, key = positions[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            best = self.best.setdefault(space, np.full((len(self.rows[space]), self.k), np.inf))
            found = [(self.place[space].get((int(key[a] // RINGS), int(key[a] % RINGS))), positions[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(key)])]
            found = [(place, own, _matrix(batch["_vector"].take(pa.array(own)))) for place, own in found if place is not None]
            if not found:
                continue
            for at, need in self._needed(space, np.array([place for place, *_ in found])):
                for column, (_, own, rows) in enumerate(found):
                    some = at + np.flatnonzero(need[:, column])
                    if not len(some):
                        continue
                    distance = np.round(1.0 - self.rows[space][some] @ rows.T, DECIMALS)
                    limit = best[some].max(axis=1, keepdims=True)
                    cut = np.partition(np.concatenate([best[some], distance], axis=1), self.k - 1, axis=1)[:, : self.k]
                    best[some] = cut
                    q, r = np.nonzero(distance <= np.minimum(limit, cut.max(axis=1, keepdims=True)))
                    if len(q):
                        yield [self.ids[space][i] for i in some[q]], own[r], distance[q, r]
