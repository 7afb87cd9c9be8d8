"""Evidence rows of resolved face tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.config import FACE_FAMILY, FACE_KIND, IDENTITY, IdentitySettings
from sightline.functions.text import is_blank
from sightline.operators.centroids import centroid
from sightline.operators.identity import VIDEO_EVIDENCE, promotion_reason
from sightline.operators.ordered import first_by
from sightline.operators.timeline import sample_windows, window_rows
from sightline.operators.tracks import cover_order, select_keyframes, with_cover_score
from sightline.session import stored

_TRACK = ["asset_id", "track_key"]


def should_emit(cfg: IdentitySettings = IDENTITY) -> Column:
    """A promoted identity shows on an asset; one promoted on video evidence
    alone needs a reference, another asset, or enough evidence on this track.

    Reads lifecycle, promotion_reason, reference_id, asset_ids, asset_id and
    the columns of ``promotion_reason``.
    """
    elsewhere = F.exists(
        "asset_ids", lambda a: F.lower(a) != F.lower(F.col("asset_id").cast("string"))
    )
    enough = F.coalesce(promotion_reason(cfg) == VIDEO_EVIDENCE, F.lit(False))
    alone = (F.col("media_kind") == "video") & (F.lower("promotion_reason") == VIDEO_EVIDENCE)
    return (F.lower("lifecycle") == "promoted") & (
        ~F.coalesce(alone, F.lit(False)) | ~is_blank("reference_id") | elsewhere | enough
    )


TABLES = ("detections", "segments", "appearances", "embeddings", "faces")


def emit_faces(
    tracked: DataFrame,
    resolved: DataFrame,
    vectors: DataFrame,
    identities: DataFrame,
    only: Sequence[str] = TABLES,
) -> dict[str, DataFrame]:
    """Detections, segments, appearances, embeddings and identity rows, or
    those of them named in ``only``.

    ``tracked`` are the samples of clustered tracks, ``resolved`` (asset_id,
    track_key, face_key) the tracks of shown identities, ``vectors``
    (asset_id, track_key, vector, quality, frame_order, sample_pos) the vectors
    they were matched on. Detections of other tracks come without a face.
    """
    made = {}
    # Only detections speak of tracks without a face.
    shown = tracked.join(resolved.select(*_TRACK), _TRACK, "left_semi")
    samples = tracked if "detections" in only else shown
    if {"detections", "segments", "appearances"} & set(only):
        placed, best = _placed(samples)
        windows = window_rows(placed)
        segments = None
    if {"detections", "segments"} & set(only):
        described = windows.join(_window_facts(placed, best), [*_TRACK, "window_no"])
        segments = described.join(resolved, _TRACK).filter(F.col("start_seconds").isNotNull()).select(
            *_TRACK,
            "start_seconds",
            "end_seconds",
            F.col("face_key").alias("title"),
            F.col("_best.score").alias("confidence"),
            F.col("face_key").alias("ref_key"),
            "group_key",
            "sample_count",
        )
    if {"detections", "appearances"} & set(only):
        keyframes = stored(select_keyframes(samples).select(*_TRACK, "frame_order", "sample_pos"), "keyframes")
    if "detections" in only:
        made["detections"] = _detections(placed, keyframes, described, resolved)
    if "segments" in only:
        made["segments"] = segments
    if {"appearances", "embeddings"} & set(only):
        totals = shown.groupBy(*_TRACK).agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min("time_seconds").alias("first_seen"),
            F.max("time_seconds").alias("last_seen"),
            F.max("score").alias("top_confidence"),
        )
    if "appearances" in only:
        retained = keyframes.groupBy(*_TRACK).agg(F.count(F.lit(1)).alias("retained_sample_count"))
        parts = windows.filter(F.col("start_seconds").isNotNull()).groupBy(*_TRACK).agg(
            F.count(F.lit(1)).alias("segment_count")
        )
        made["appearances"] = (
            totals.join(resolved, _TRACK)
            .join(retained, _TRACK)
            .join(parts, _TRACK, "left")
            .join(best.select(*_TRACK, F.col("_bt").alias("representative_seconds")), _TRACK)
            .withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))
            .withColumnsRenamed({"face_key": "ref_key"})
        )
    if "embeddings" in only:
        means = centroid(
            vectors.join(resolved.select(*_TRACK), _TRACK, "left_semi"),
            _TRACK,
            weight=F.greatest(F.col("quality"), F.lit(1e-6)),
            first=F.struct("frame_order", "sample_pos"),
            norm_rule="before",
        )
        made["embeddings"] = means.join(resolved, _TRACK).join(totals, _TRACK).select(
            *_TRACK,
            F.col("face_key").alias("ref_key"),
            F.lit(FACE_KIND).alias("kind"),
            F.lit(FACE_FAMILY).alias("kind_family"),
            "vector",
            "norm",
            F.col("first_seen").alias("start_seconds"),
            F.col("last_seen").alias("end_seconds"),
        )
    if "faces" in only:
        made["faces"] = first_by(
            identities.join(resolved.select("face_key").distinct(), "face_key", "left_semi"), ["face_key"], [F.col("face_key")]
        )
    return made


def _placed(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples without their vectors in their observation windows, written out once, and each track's best."""
    scored = with_cover_score(samples).drop("embeddings")
    placed = stored(sample_windows(scored), "placed")
    narrow = placed.select(*_TRACK, "frame_order", "sample_pos", "time_seconds", "bbox", "cover_quality")
    order = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cover_order())])
    first = narrow.groupBy(*_TRACK).agg(F.min_by(F.struct("frame_order", "sample_pos", "time_seconds"), order).alias("_b"))
    best = first.select(
        *_TRACK,
        F.col("_b.frame_order").alias("_bf"),
        F.col("_b.sample_pos").alias("_bp"),
        F.col("_b.time_seconds").alias("_bt"),
    )
    return placed, best


def _window_facts(placed: DataFrame, best: DataFrame) -> DataFrame:
    """First, last and best sample of each window."""
    in_window = placed.select(*_TRACK, "window_no", "frame_order", "sample_pos", "score", "time_seconds").join(best, _TRACK).withColumn(
        "_is_best", (F.col("frame_order") == F.col("_bf")) & (F.col("sample_pos") == F.col("_bp"))
    )
    edge = F.struct("frame_order", "sample_pos")
    return in_window.groupBy(*_TRACK, "window_no").agg(
        F.min(edge).alias("_first"),
        F.max(edge).alias("_last"),
        F.min_by(
            F.struct("frame_order", "sample_pos", "score"),
            F.struct(~F.col("_is_best"), -F.col("score"), F.col("time_seconds"), F.col("frame_order"), F.col("sample_pos")),
        ).alias("_best"),
    )


def _detections(placed: DataFrame, keyframes: DataFrame, described: DataFrame, resolved: DataFrame) -> DataFrame:
    edge = F.struct("frame_order", "sample_pos")
    kept = placed.join(keyframes, [*_TRACK, "frame_order", "sample_pos"], "left_semi").join(
        described.select(*_TRACK, "window_no", "group_key", "_first", "_last", "_best"), [*_TRACK, "window_no"]
    )
    at_best = (F.col("frame_order") == F.col("_best.frame_order")) & (F.col("sample_pos") == F.col("_best.sample_pos"))
    role = (
        F.when(edge == F.col("_first"), "first")
        .when(at_best, "best")
        .when(edge == F.col("_last"), "last")
        .otherwise("motion-keyframe")
    )
    return kept.join(resolved, _TRACK, "left").select(
        *_TRACK,
        F.col("time_seconds").alias("observed_at"),
        "score",
        "bbox",
        F.col("det_model").alias("model_key"),
        F.col("face_key").alias("ref_key"),
        "group_key",
        role.alias("role"),
        "frame_order",
        "sample_pos",
    )
