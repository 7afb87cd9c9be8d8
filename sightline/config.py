"""Default thresholds and limits.

Fixed values: results must agree with the analysis service these tables come
from, so its defaults are stated here as they are. Each can be overridden.
"""

from __future__ import annotations

from dataclasses import dataclass

# Kinds and families of stored vectors.
FEATURE_KIND, FEATURE_FAMILY = "visual.feature.v1", "feature.v1"
SEMANTIC_KIND, SEMANTIC_FAMILY = "visual.semantic.v1", "semantic.v1"
AUDIO_KIND, AUDIO_FAMILY = "audio.embed.v1", "audio.v1"
FACE_KIND, FACE_FAMILY = "face.embed.v1", "face.v1"

# Sound types that carry a voice.
VOICE_SOUND_TYPES = ("moan", "speech")
VOICE_FLOOR = 0.45

TAG_CONFIDENCE_FLOOR = 0.35
DEFAULT_SLICE_SPAN = 0.5
MINIMUM_SLICE_SPAN = 0.25


@dataclass(frozen=True)
class SectionSettings:
    split_similarity: float = 0.92
    minimum_frames: int = 3
    minimum_seconds: float = 1.0


@dataclass(frozen=True)
class SearchSettings:
    knn_limit: int = 2000
    distance_window: float = 0.03
    minimum_results: int = 5
    maximum_results: int = 500
    part_queries: int = 4
    interval_limit: int = 64
    weight_overall_visual: float = 1.0
    weight_overall_semantic: float = 0.42
    weight_part_visual: float = 0.7
    weight_part_semantic: float = 0.25
    audio_asset_weight: float = 1.0
    audio_section_weight: float = 0.65
    role_bonus: float = 0.012
    role_bonus_cap: float = 0.04
    seed_limit: int = 48
    search_page_size: int = 40
    search_page_max: int = 500
    similar_page_size: int = 12
    similar_page_max: int = 48


@dataclass(frozen=True)
class TrackSettings:
    max_gap_frames: int = 3
    max_embedding_gap_frames: int = 12
    iou_match: float = 0.5
    embedding_match: float = 0.68
    long_gap_embedding_match: float = 0.82
    iou_weight: float = 0.35
    embedding_weight: float = 0.65
    gap_penalty_step: float = 0.025
    gap_penalty_cap: float = 0.25
    cluster_similarity: float = 0.48
    cluster_margin: float = 0.02
    cluster_minimum_norm: float = 10.0
    cluster_minimum_score: float = 0.3
    hard_score: float = 0.3
    hard_norm: float = 10.0
    anchor_score: float = 0.65
    anchor_norm: float = 18.0
    anchor_area_fraction: float = 0.01
    anchor_area_pixels: float = 4096.0
    representative_similarity: float = 0.96
    representative_limit: int = 6
    keyframe_iou: float = 0.86
    keyframe_limit: int = 18
    keyframe_gap: float = 2.5
    window_gap_floor: float = 8.0
    window_gap_spans: float = 4.0


@dataclass(frozen=True)
class IdentitySettings:
    match: float = 0.50
    ambiguity: float = 0.05
    same_asset_relaxation: float = 0.07
    reference_match: float = 0.58
    reference_margin: float = 0.03
    consolidation: float = 0.54
    consolidation_same_asset: float = 0.72
    consolidation_promoted: float = 0.70
    consolidation_margin: float = 0.03
    not_present_split: float = 0.50
    presence_seconds: float = 8.0
    promotion_samples: int = 24
    promotion_seconds: float = 24.0
    sparse_interval: float = 10.0
    sparse_samples: int = 2
    sparse_coverage: float = 0.10
    anchor_duplicate: float = 0.975
    anchor_limit: int = 12
    asset_limit: int = 32
    candidate_k: int = 20
    cover_margin: float = 0.02


@dataclass(frozen=True)
class SuggestSettings:
    source_vectors: int = 4
    local_k: int = 40
    reference_k: int = 12
    conflict_confidence: float = 55.0
    conflict_damping: float = 0.85
    max_results: int = 10


SECTIONS = SectionSettings()
SEARCH = SearchSettings()
TRACKS = TrackSettings()
IDENTITY = IdentitySettings()
SUGGEST = SuggestSettings()
