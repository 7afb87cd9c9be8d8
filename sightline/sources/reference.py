"""Reference sets of known people: read, validate, precompute norms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.vectors import l2norm


def checked_reference(manifest: DataFrame, identities: DataFrame, centroids: DataFrame) -> DataFrame:
    """Identities with their centroid and its norm, or an error.

    ``manifest`` (pack_id, dimension, identity_count), ``identities``
    (pack_id, ordinal, ...), ``centroids`` (pack_id, ordinal, vector). Each
    pack must hold as many identities and centroids as its manifest says, all
    centroids of the stated dimension and one per ordinal. One aggregation
    checks this before anything is returned.
    """
    listed = identities.groupBy("pack_id").agg(F.count(F.lit(1)).alias("_listed"))
    stored = centroids.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("_stored"),
        F.min(F.size("vector")).alias("_least"),
        F.max(F.size("vector")).alias("_most"),
    )
    paired = identities.join(centroids, ["pack_id", "ordinal"]).groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("_paired")
    )
    facts = manifest.join(listed, "pack_id", "left").join(stored, "pack_id", "left").join(paired, "pack_id", "left")
    wanted = F.col("identity_count")
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in ("_listed", "_stored", "_paired")]
    bad = (
        (counts[0] != wanted)
        | (counts[1] != wanted)
        | (counts[2] != wanted)
        | ((wanted > 0) & ((F.col("_least") != F.col("dimension")) | (F.col("_most") != F.col("dimension"))))
    )
    broken = facts.filter(bad).select("pack_id").limit(5).collect()
    if broken:
        raise ValueError(f"reference sets do not match their manifest: {[r[0] for r in broken]}")
    norms = centroids.withColumn("norm", l2norm("vector").cast("float"))
    return identities.join(norms, ["pack_id", "ordinal"])


def load_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(packs, identities)`` from a folder with ``manifest`` and
    ``identities`` as JSON lines and ``centroids`` as Parquet.
    """
    packs = spark.read.schema(
        "pack_id string, version string, embedder string, dimension int, endpoint string, "
        "identity_count bigint, created_at string"
    ).json(f"{path}/manifest")
    identities = spark.read.schema(
        "pack_id string, ordinal bigint, external_id string, display_name string, "
        "disambiguation string, aliases array<string>, image_url string"
    ).json(f"{path}/identities")
    centroids = spark.read.parquet(f"{path}/centroids").select("pack_id", "ordinal", "vector")
    named = F.coalesce(F.col("display_name"), F.col("external_id"))
    return packs, checked_reference(packs, identities.withColumn("display_name", named), centroids)
