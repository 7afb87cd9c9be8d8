"""Path mapping and target resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import base_name, clean, normalize_path
from sightline.operators.ordered import first_by


def map_paths(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rewrite ``path`` by the longest matching prefix -> ``mapped_path``.

    ``paths`` (path_id, path), ``prefixes`` (prefix_pos, from_prefix,
    to_prefix). A prefix matches, ignoring case, only at a segment boundary.
    Every boundary of a path is an equality candidate, so prefixes are looked
    up by hash join instead of being compared with every path.
    """
    normal = paths.withColumn("_path", normalize_path("path"))
    ends = F.expr(
        "array_distinct(concat(array(length(_path)), flatten(transform("
        "filter(sequence(1, greatest(length(_path), 1)), i -> substr(_path, i, 1) = '/'), "
        "i -> array(i - 1, i)))))"
    )
    candidates = normal.select("path_id", "_path", F.explode(ends).alias("_end")).withColumn(
        "_key", F.lower(F.expr("substr(_path, 1, _end)"))
    )
    table = prefixes.select(
        F.lower(normalize_path("from_prefix")).alias("_key"),
        F.length("from_prefix").alias("_length"),
        "prefix_pos",
        "to_prefix",
    ).filter(F.col("_key") != "")
    hits = candidates.filter(F.col("_end") > 0).join(table, "_key")
    best = first_by(hits, ["path_id"], [-F.col("_length"), F.col("prefix_pos")]).select(
        "path_id", "_end", "to_prefix"
    )
    joined = normal.join(best, "path_id", "left")
    suffix = F.regexp_replace(F.expr("substr(_path, _end + 1)"), "^/+", "")
    back = F.contains(F.col("to_prefix"), F.lit("\\"))
    separator = F.when(back, F.lit("\\")).otherwise(F.lit("/"))
    mapped = F.when(F.trim(suffix) == "", F.col("to_prefix")).otherwise(
        F.concat("to_prefix", separator, F.replace(suffix, F.lit("/"), separator))
    )
    return joined.withColumn(
        "mapped_path", F.when(F.col("_end").isNull(), F.col("_path")).otherwise(mapped)
    ).select(*paths.columns, "mapped_path")


def resolve_targets(files: DataFrame, requested: DataFrame, paths: DataFrame) -> DataFrame:
    """Files to analyse: explicit paths first, then the best file per entity.

    ``files`` (entity_type, entity_id, title, path, duration, width, height),
    ``requested`` (entity_type, entity_id, request_pos), ``paths`` (path,
    request_pos). A video is represented by its longest file, an image by its
    largest; ties fall to the path. Each path appears once.
    """
    preference = F.when(F.col("entity_type") == "video", F.col("duration")).otherwise(
        F.col("width").cast("double") * F.col("height")
    )
    best = first_by(
        files.filter(clean("path").isNotNull()),
        ["entity_type", "entity_id"],
        [-F.coalesce(preference, F.lit(0.0)), F.lower("path"), F.col("path")],
    )
    entity_path = normalize_path("path")
    title_case = F.initcap(F.col("entity_type"))
    entities = requested.join(best, ["entity_type", "entity_id"]).select(
        F.concat_ws(":", "entity_type", F.col("entity_id").cast("string")).alias("unit_id"),
        F.coalesce(
            F.when(clean("title").isNotNull(), F.col("title")),
            clean(base_name(entity_path)),
            F.concat_ws(" ", title_case, F.col("entity_id").cast("string")),
        ).alias("label"),
        entity_path.alias("path"),
        F.col("entity_id").cast("bigint").alias("entity_id"),
        "entity_type",
        F.lit(1).alias("_group"),
        "request_pos",
    )
    plain = normalize_path("path")
    explicit = paths.select(
        F.concat(F.lit("path:"), plain).alias("unit_id"),
        F.coalesce(clean(base_name(plain)), plain).alias("label"),
        plain.alias("path"),
        F.lit(None).cast("bigint").alias("entity_id"),
        F.lit(None).cast("string").alias("entity_type"),
        F.lit(0).alias("_group"),
        "request_pos",
    )
    every = explicit.unionByName(entities).withColumn("_key", F.lower("path"))
    return first_by(every, ["_key"], [F.col("_group"), F.col("request_pos")]).drop("_key", "_group")
