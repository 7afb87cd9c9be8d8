"""Quality of face samples: evidence for an identity and fitness as a cover.

A sample has ``score``, a ``bbox`` struct and ``embeddings``: an array of
struct<model_key, vector, norm, metadata>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.config import TRACKS
from sightline.functions.geometry import area, scaled_area
from sightline.functions.vectors import cosine

# Fixed metadata names.
POSE, IMAGE, SHARPNESS = "pose_quality", "image_quality", "sharpness"
BRIGHTNESS, BRIGHTNESS_QUALITY = "brightness", "brightness_quality"
OCCLUSION, OCCLUSION_QUALITY = "occlusion", "occlusion_quality"


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _measured(embedding: Column, name: str) -> Column:
    """Metadata number clamped to [0, 1]; null when missing or no number."""
    number = F.trim(F.try_element_at(embedding["metadata"], F.lit(name))).try_cast("double")
    return F.when(number.isNotNull(), _clamp(number, 0.0, 1.0))


def metadata_quality(embedding: Column, name: str) -> Column:
    value = _measured(embedding, name)
    return F.when(value.isNull(), F.lit(1.0)).otherwise(value)


def _brightness(embedding: Column) -> Column:
    stated, measured = metadata_quality(embedding, BRIGHTNESS_QUALITY), _measured(embedding, BRIGHTNESS)
    derived = _clamp(1.0 - F.abs(measured - 0.55) / 0.55, 0.25, 1.0)
    return F.when(stated < 1.0, stated).when(measured.isNull(), 1.0).otherwise(derived)


def _occlusion(embedding: Column) -> Column:
    stated, measured = metadata_quality(embedding, OCCLUSION_QUALITY), _measured(embedding, OCCLUSION)
    return F.when(stated < 1.0, stated).when(measured.isNull(), 1.0).otherwise(_clamp(1.0 - measured, 0.15, 1.0))


def _best(embeddings: Column, read, default: float) -> Column:
    return F.coalesce(F.array_max(F.transform(embeddings, read)), F.lit(default))


def _norm(embedding: Column) -> Column:
    return F.coalesce(embedding["norm"], F.lit(0.0))


def identity_score(score: Column, bbox: Column, embeddings: Column) -> Column:
    """Evidence a sample gives for an identity (track quality is its maximum)."""
    size = F.least(F.lit(24.0), F.sqrt(F.greatest(F.lit(1.0), scaled_area(bbox))))
    return (
        score
        * F.greatest(F.lit(1.0), _best(embeddings, _norm, 0.0))
        * _best(embeddings, lambda e: metadata_quality(e, POSE), 1.0)
        * _best(embeddings, lambda e: metadata_quality(e, IMAGE), 1.0)
        * size
    )


def cover_score(score: Column, bbox: Column, embeddings: Column, centroid: Column) -> Column:
    """Fitness of a sample as the cover of a track with this centroid."""
    size = _clamp(F.sqrt(F.greatest(F.lit(1.0), scaled_area(bbox))) / 10.0, 0.35, 2.25)
    likeness = _best(embeddings, lambda e: cosine(e["vector"], centroid, "unit"), 0.0)
    typical = F.when(centroid.isNull(), 1.0).otherwise(_clamp(0.55 + 0.45 * likeness, 0.55, 1.0))
    strength = F.log(F.greatest(F.lit(1.0), _best(embeddings, _norm, 1.0))) / F.log(F.lit(32.0))
    return (
        score
        * size
        * _best(embeddings, lambda e: metadata_quality(e, POSE), 1.0)
        * _best(embeddings, lambda e: metadata_quality(e, IMAGE), 1.0)
        * _best(embeddings, lambda e: metadata_quality(e, SHARPNESS), 1.0)
        * _best(embeddings, _brightness, 1.0)
        * _best(embeddings, _occlusion, 1.0)
        * typical
        * _clamp(strength, 0.35, 1.15)
    )


def sample_flags(score: Column, bbox: Column, norm: Column) -> dict[str, Column]:
    """Hard floor, identity floor and anchor grade of one embedding."""
    strength = F.coalesce(norm, F.lit(0.0))
    hard = (score >= TRACKS.hard_score) & (strength >= TRACKS.hard_norm)
    identity = (score >= TRACKS.anchor_score) & (strength >= TRACKS.anchor_norm)
    size = area(bbox)
    enough = size >= F.when(size <= 1.0, TRACKS.anchor_area_fraction).otherwise(TRACKS.anchor_area_pixels)
    return {"passes_hard": hard, "passes_identity": identity, "is_anchor": hard & identity & enough}
