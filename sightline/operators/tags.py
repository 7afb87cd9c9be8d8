"""Tag links, renames, the tag dimension and tag evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import clean, is_blank, key_of
from sightline.operators.ordered import RANGE, bucketed_scan, first_by, ranged
from sightline.operators.timeline import confidence_floor


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Settings-table clean-up: trim the key columns, drop rows with a blank
    one, and keep the first row per case-insensitive key.
    """
    trimmed = df.withColumns({k: F.trim(k) for k in key})
    for k in key:
        trimmed = trimmed.filter(~is_blank(k))
    keyed = trimmed.withColumns({f"_k{i}": key_of(k) for i, k in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    return first_by(keyed, names, list(order)).drop(*names)


def image_tag_links(predictions: DataFrame) -> DataFrame:
    """Links from asset-level predictions at or above the confidence floor."""
    return confidence_floor(predictions).select(
        "asset_id", F.col("label").alias("tag"), "confidence", "model_key"
    )


def apply_tag_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rename ``tag`` by ``overrides`` (source_tag, target_tag).

    Where ``df`` has a ``title``, it follows the tag when blank or equal to
    the old name.
    """
    table = overrides.filter(~is_blank("source_tag") & ~is_blank("target_tag")).select(
        key_of("source_tag").alias("_key"), F.trim("target_tag").alias("_target")
    )
    joined = df.withColumn("_key", key_of("tag")).join(table, "_key", "left")
    renamed = F.when(is_blank("tag"), F.col("tag")).otherwise(
        F.coalesce(F.col("_target"), F.trim("tag"))
    )
    columns = {"tag": renamed}
    if "title" in df.columns:
        follows = is_blank("title") | (key_of("title") == key_of("tag"))
        columns["title"] = F.when(follows, renamed).otherwise(F.col("title"))
    return joined.withColumns(columns).select(*df.columns)


def upsert_tags(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The tag dimension (tag_id, name) with unknown names added.

    Names compare case-insensitively; new ones get the ids after the highest,
    in name order, numbered without a global sort.
    """
    fresh = (
        names.select(clean("name").alias("name"))
        .filter(F.col("name").isNotNull())
        .groupBy(key_of("name").alias("_key"))
        .agg(F.min("name").alias("name"))
        .join(dimension.select(key_of("name").alias("_key")), "_key", "left_anti")
        .withColumn("_all", F.lit(0))
    )
    top = dimension.agg(F.coalesce(F.max("tag_id"), F.lit(0)).cast("bigint").alias("_top"))
    top = top.withColumn("_all", F.lit(0))
    numbered = bucketed_scan(ranged(fresh, ["name"]), ["_all"], F.col(RANGE), ["name"], rank="_rank", hot=True)
    added = numbered.join(top, "_all").select(
        (F.col("_top") + F.col("_rank")).cast("bigint").alias("tag_id"), "name"
    )
    return dimension.select(F.col("tag_id").cast("bigint").alias("tag_id"), "name").unionByName(added)


def tag_evidence(links: DataFrame, segments: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per (host, tag, source, model): best confidence, summed segment
    seconds (null when none), and the host's own duration.
    """
    columns = ["host_id", "tag", "source_key", "model_key", "confidence"]
    length = F.col("end_seconds") - F.col("start_seconds")
    linked = links.select(*columns, F.lit(None).cast("double").alias("_seconds"))
    timed = segments.select(*columns, F.when(length > 0, length).alias("_seconds"))
    grouped = (
        linked.unionByName(timed)
        .filter(~is_blank("tag"))
        .groupBy("host_id", key_of("tag").alias("_tag"), "source_key", clean("model_key").alias("model_key"))
        .agg(
            F.min(F.trim("tag")).alias("tag"),
            F.max("confidence").alias("confidence"),
            F.sum("_seconds").alias("_seconds"),
        )
    )
    return grouped.join(hosts.select("host_id", "host_duration"), "host_id", "left").select(
        "host_id",
        "tag",
        "source_key",
        "model_key",
        "confidence",
        F.when(F.col("_seconds") > 0, F.col("_seconds")).alias("total_duration"),
        "host_duration",
    )


def upsert_evidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence rows with new ones taking the place of stored ones per
    (host, tag, source, model).
    """
    key = ["host_id", "tag", "source_key", "model_key"]
    match = [stored[k].eqNullSafe(fresh[k]) for k in key]
    return stored.join(fresh, match, "left_anti").unionByName(fresh)


def drop_unsupported_links(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Host-tag links that still have a piece of evidence."""
    return links.join(evidence.select("host_id", "tag").distinct(), ["host_id", "tag"], "left_semi")
