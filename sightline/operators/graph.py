"""Closing chains of replacements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut_lineage


def close_merge_map(merges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Resolve (duplicate -> target) chains to the last target.

    Pointer jumping: each round doubles the length followed, so a chain of
    length n takes log2(n) rounds. A cycle is an error.
    """
    keys = list(keys)
    current = cut_lineage(merges.select(*keys, "duplicate", "target").distinct())
    for _ in range(64):
        onward = current.select(*keys, F.col("duplicate").alias("target"), F.col("target").alias("_next"))
        jumped = current.join(onward, [*keys, "target"], "left")
        if jumped.filter(F.col("_next").isNotNull()).isEmpty():
            return current
        if not jumped.filter(F.col("_next") == F.col("duplicate")).isEmpty():
            raise ValueError("the merge map contains a cycle")
        current = cut_lineage(
            jumped.select(*keys, "duplicate", F.coalesce("_next", "target").alias("target"))
        )
    raise ValueError("the merge map contains a cycle")
