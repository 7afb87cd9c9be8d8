"""From face samples of many assets to evidence rows and updated identities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import emit, identity, tracks
from sightline.operators.graph import close_merge_map
from sightline.session import cut_lineage


@dataclass
class FaceBatch:
    """Outcome of one batch: evidence tables, identities and merges."""

    evidence: dict[str, DataFrame]
    identities: DataFrame
    merges: DataFrame


def prepare_faces(
    samples: DataFrame,
    assets: DataFrame,
    identities: DataFrame,
    *,
    reference: DataFrame | None = None,
    pack_id: str | None = None,
    next_ordinal: int = 1,
) -> FaceBatch:
    """Tracks of all assets are matched against the identities as they stand;
    unmatched ones become identities, and consolidation then joins new and old
    ones of the same person. ``assets`` (asset_id, media_kind,
    duration_seconds, frame_interval).
    """
    key = ["asset_id", "track_key"]
    images = assets.filter(F.col("media_kind") == "image").select("asset_id")
    # A face of an image is a track of its own; only videos are tracked through their frames.
    tracked = tracks.build_tracks(samples.join(images, "asset_id", "left_anti")).unionByName(
        tracks.image_tracks(samples.join(images, "asset_id", "left_semi"))
    )
    clustered = tracks.cluster_tracks(tracked).select("asset_id", "track_no", "cluster_key")
    tracked = cut_lineage(
        tracked.drop("track_key")
        .join(clustered, ["asset_id", "track_no"])
        .withColumnRenamed("cluster_key", "track_key")
    )
    vectors = cut_lineage(tracks.representatives_by_quality(tracked))
    graded = vectors.groupBy(*key).agg(
        F.max((F.col("passes_hard") & F.col("is_anchor")).cast("int")).alias("_anchor"),
        F.max(F.col("passes_identity").cast("int")).alias("_identity"),
    )
    used = vectors.join(graded.filter(F.col("_identity") == 1), key).filter(
        F.when(F.col("_anchor") == 1, F.col("passes_hard") & F.col("is_anchor")).otherwise(F.col("passes_identity"))
    )
    used = cut_lineage(
        used.withColumn("vector_id", F.concat_ws("|", "asset_id", "track_key", "frame_order", "sample_pos", "vector_pos"))
    )
    # At most six vectors per track.
    bundles = used.groupBy(*key).agg(F.collect_list("vector").alias("vectors"), F.max("_anchor").alias("anchor_grade"))

    none = bundles.select(*key).limit(0)
    matched = none.withColumns({c: F.lit(None).cast("string") for c in ("external_id", "display_name")})
    if reference is not None:
        grouped = used.withColumn("_track", F.concat_ws("|", *key))
        found = identity.match_reference(grouped.select("_track", "vector"), reference, key="_track")
        matched = grouped.select("_track", *key).distinct().join(found, "_track").select(
            *key, "external_id", "display_name"
        )
    references = matched.select(*key, F.col("external_id").alias("reference_id"))
    pairs = identity.candidates(used, identities, references)
    by_vector = identity.match_identity(bundles, pairs, identities).select(*key, "face_key")
    known = identities.filter(F.col("reference_id").isNotNull()).groupBy(
        F.lower("reference_id").alias("_ref")
    ).agg(F.min("face_key").alias("_by_reference"))
    joined = (
        bundles.join(by_vector, key, "left")
        .join(references, key, "left")
        .withColumn("_ref", F.lower("reference_id"))
        .join(known, "_ref", "left")
        .join(identities.select("face_key", F.col("reference_id").alias("_held")), "face_key", "left")
    )
    clash = (
        F.col("_by_reference").isNull()
        & F.col("reference_id").isNotNull()
        & F.col("_held").isNotNull()
        & (F.lower("_held") != F.lower("reference_id"))
    )
    settled = F.when(clash, F.lit(None)).otherwise(F.coalesce("_by_reference", "face_key"))
    resolved = cut_lineage(
        joined.select(*key, "anchor_grade", "reference_id", settled.alias("face_key"))
    )

    best = tracks.best_sample(tracked).select(*key, F.col("bbox").alias("cover_box"), "cover_quality")
    quality = tracked.groupBy(*key).agg(
        F.max(tracks.identity_score(F.col("score"), F.col("bbox"), F.col("embeddings"))).alias("track_quality"),
        F.count(F.lit(1)).alias("sample_count"),
        F.min("time_seconds").alias("start_seconds"),
        F.max("time_seconds").alias("end_seconds"),
        F.max("frame_span").alias("_span"),
    )
    facts = cut_lineage(
        quality.join(best, key)
        .join(assets, "asset_id")
        .withColumn("frame_interval", F.coalesce("_span", "frame_interval"))
    )
    fresh = resolved.filter(
        F.col("face_key").isNull() & ((F.col("anchor_grade") == 1) | F.col("reference_id").isNotNull())
    )
    made = identity.create_identities(
        fresh.join(facts, key).join(matched.select(*key, "display_name"), key, "left").select(
            *key,
            "track_quality",
            "cover_box",
            "reference_id",
            F.col("display_name").alias("reference_name"),
            F.when(F.col("reference_id").isNotNull(), F.lit(pack_id)).alias("reference_pack"),
        ),
        next_ordinal,
    )
    made = cut_lineage(made)
    assigned = resolved.join(made.select(*key, F.col("face_key").alias("_new")), key, "left").select(
        *key, F.coalesce("face_key", "_new").alias("face_key")
    )
    assigned = cut_lineage(assigned.join(facts, key))
    current = identities.select(*identity.COLUMNS).unionByName(made.select(*identity.COLUMNS))
    held = assigned.filter(F.col("face_key").isNotNull())
    anchors = used.join(held.select(*key, "face_key"), key).select(
        "face_key", "asset_id", "track_key", F.struct("frame_order", "sample_pos", "vector_pos").alias("vector_pos"), "model_key", "quality", "vector"
    )
    current = identity.update_identities(current, held, anchors)
    current = identity.promote_by_tracks(current, held)
    remaining, merges = identity.consolidate(current)
    remaining = cut_lineage(identity.promote_by_evidence(remaining))
    final = close_merge_map(merges)
    # Tracks without an identity keep their place in the presence estimate.
    shown = identity.repoint(assigned, "face_key", final)
    brief = identity.brief_presence(shown).select("asset_id", "face_key")
    visible = (
        shown.filter(F.col("face_key").isNotNull())
        .join(brief, ["asset_id", "face_key"], "left_anti")
        .join(remaining.select("face_key", "lifecycle", "promotion_reason", "reference_id", "asset_ids"), "face_key")
        .withColumn("asset_count", F.lit(1))
        .filter(emit.should_emit())
        .select(*key, "face_key")
    )
    evidence = emit.emit_faces(tracked, cut_lineage(visible), used, remaining)
    return FaceBatch(evidence, remaining, final)
