"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` virtual nodes on a ring of 64-bit positions. A
document starts at the first node clockwise of the hash of its id. A shard
takes documents up to its capacity; those that find it full go on clockwise
to the next node whose shard has room. Capacities differ by at most one row
and sum to the number of documents, so every shard ends exactly full: the law
``rows`` holds, counts are at most one apart.

Only counts per arc of the ring (shards x points, a fixed number) reach the
driver. It settles how many documents of an arc each shard takes; the rows
themselves find their place by their rank within the arc, in one shuffle of
ids.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import quoted
from sightline.session import cut_lineage


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; positions are signed 64-bit."""
    nodes = []
    for shard in range(shards):
        for point in range(points):
            digest = hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(nodes)


def capacities(rows: int, shards: int) -> list[int]:
    """Room of each shard: equal, the first ``rows % shards`` have one more."""
    each, over = divmod(rows, shards)
    return [each + (s < over) for s in range(shards)]


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank, number, shard) that place every document.

    Works on counts alone. In each round what waits at a node asks its shard
    for room, nodes in ring order; what finds none moves on to the next node
    clockwise. Nodes of full shards are linked out of the ring, so a round
    trip never visits them twice. The ranks of an arc are handed out from
    zero: those placed first are the ones nearest to where the arc begins.
    """
    n, left = len(nodes), list(room)
    onward = list(range(n))  # the node itself, or a node clockwise that may have room

    def open_node(at: int) -> int:
        path = []
        while left[nodes[at][1]] == 0:
            path.append(at)
            at = onward[at] if onward[at] != at else (at + 1) % n
            if len(path) > 2 * n:
                raise ValueError("no shard has room left")
        for p in path:
            onward[p] = at
        return at

    pieces, waiting = [], [(0, arc, 0, count) for arc, count in sorted(counts.items()) if count]
    heapq.heapify(waiting)  # (rounds travelled, arc, first rank, number): short ways are served first
    while waiting:
        travelled, arc, first, number = heapq.heappop(waiting)
        start = (arc + travelled) % n
        at = open_node(start)
        step = (at - start) % n
        if step:
            heapq.heappush(waiting, (travelled + step, arc, first, number))
            continue
        shard = nodes[at][1]
        taken = min(number, left[shard])
        left[shard] -= taken
        pieces.append((arc, first, taken, shard))
        if taken < number:
            heapq.heappush(waiting, (travelled + 1, arc, first + taken, number - taken))
    return pieces


def numbers(values: list[int], kind: str) -> Column:
    """A constant array; written as one text, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def assign(docs: DataFrame, key: str, shards: int, points: int = 128) -> DataFrame:
    """Rows of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard).

    ``docs`` should be narrow: its rows are shuffled once, by arc. A null key
    starts at one fixed place of the ring; rows that repeat a key start at
    the same place and overflow clockwise like any others. An empty table
    gives no rows. Columns called ``shard`` or ``slot`` are replaced. Rows of
    one key are told apart by their other columns; which of two wholly equal
    rows gets the smaller slot is open.
    """
    nodes = ring(shards, points)
    positions = [p for p, _ in nodes]
    others = [c for c in docs.columns if c not in ("shard", "slot")]
    # The arc of a position: number of nodes before it; behind the last node the ring closes.
    # Positions are near uniform, so a short table by leading bits leaves a handful of nodes to compare.
    lead = 10
    starts = [bisect.bisect_left(positions, (b << (64 - lead)) - (1 << 63)) for b in range((1 << lead) + 1)]
    widest = max(b - a for a, b in zip(starts, starts[1:]))
    table = numbers(positions + [(1 << 63) - 1] * (widest + 1), "bigint")
    begun = numbers(starts[:-1], "int")
    at = F.xxhash64(F.col(key))
    cell = (F.shiftright(at, 64 - lead) + F.lit(1 << (lead - 1))).cast("int")
    # The rows are known by their position, their arc and the rest as one value: no name of theirs can clash.
    hashed = docs.select(F.struct(*map(quoted, others)).alias("row"), at.alias("at"), F.element_at(begun, cell + 1).alias("first"))
    within = sum((F.element_at(table, F.col("first") + 1 + i) < F.col("at")).cast("int") for i in range(widest))
    placed = cut_lineage(hashed.select("row", "at", ((F.col("first") + within) % len(nodes)).cast("int").alias("arc")))
    counts = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}  # at most shards x points rows
    pieces = settle(counts, nodes, capacities(sum(counts.values()), shards))
    filled = [0] * shards
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for arc, first, number, shard in sorted(pieces):
        by_arc.setdefault(arc, []).append((first, shard, filled[shard]))
        filled[shard] += number
    plan = docs.sparkSession.createDataFrame(
        [(arc, [f for f, _, _ in own], [s for _, s, _ in own], [b for _, _, b in own]) for arc, own in by_arc.items()],
        "arc int, firsts array<bigint>, shards array<int>, bases array<bigint>",
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("at", "row")).cast("long") - 1)
    # Pieces of an arc: at most a few; the last that begins at or before the rank is the row's own.
    joined = ranked.join(F.broadcast(plan), "arc")
    own = F.size(F.filter("firsts", lambda f: f <= F.col("rank")))
    return joined.withColumn("own", own).select(
        "row.*",
        F.element_at("shards", F.col("own")).alias("shard"),
        (F.element_at("bases", F.col("own")) + F.col("rank") - F.element_at("firsts", F.col("own"))).alias("slot"),
    )
