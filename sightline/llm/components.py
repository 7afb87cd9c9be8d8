"""Connected components of a graph given by its links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for every node of ``links`` (``a``, ``b``).

    Alternates two steps: every node hands its larger neighbours, then its
    smaller ones and itself, to the smallest of them. Both keep components
    as they are, and the number of links never grows; after a number of
    rounds about logarithmic in the size of a component every node is linked
    to the smallest one alone. Nodes of any degree are fine: the smallest
    neighbour is an aggregate that is summed up before the shuffle, and no
    list of neighbours is ever built. Repeated links, loops and nulls in the
    links are ignored; without links there are no rows.
    """

    def smaller_first(pairs: DataFrame) -> DataFrame:
        return (
            pairs.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(
            F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        return tuple(row)

    now = cut_lineage(smaller_first(links))
    seen = mark(now)
    while seen[0]:
        # Large step: larger neighbours of a node go to the smallest of all its neighbours and itself.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = smaller_first(
            both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = cut_lineage(large)
        # Small step: smaller neighbours of a node, and the node itself, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = cut_lineage(
            smaller_first(
                small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                    low.select("a", F.col("m").alias("b"))
                )
            )
        )
        before, seen = seen, mark(now)
        if seen == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
