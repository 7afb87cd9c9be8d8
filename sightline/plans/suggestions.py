"""The suggestion path end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.config import SUGGEST
from sightline.operators import suggest


def suggest_faces(
    faces: DataFrame,
    embeddings: DataFrame,
    performers: DataFrame,
    appearances: DataFrame,
    detections: DataFrame,
    host_performers: DataFrame,
    *,
    reference: DataFrame | None = None,
    packs: DataFrame | None = None,
    rejections: DataFrame | None = None,
    resolved: DataFrame | None = None,
    max_results: int = SUGGEST.max_results,
) -> DataFrame:
    """Ranked suggestions for every unlinked face: neighbours and reference
    matches (conflicts damped), raised and completed by host evidence.
    """
    limit = min(max(max_results, 1), SUGGEST.max_results)
    sources = suggest.suggestion_sources(faces, embeddings)
    parts = [suggest.local_suggestions(sources, embeddings, faces, performers)]
    if reference is not None:
        matched = suggest.reference_suggestions(
            sources, reference, packs, rejections, resolved, performers
        )
        damped = suggest.damp_conflicts(matched)
        order = [F.desc("confidence"), F.col("performer_name"), F.col("suggestion_key")]
        parts.append(suggest.best_suggestions(damped, limit, order))
    ranked = suggest.rank_suggestions(*parts).drop("rank")
    eligible = faces.filter(F.col("performer_id").isNull() & F.col("merged_into").isNull())
    linked = suggest.linked_hosts(appearances, detections, host_performers, eligible)
    evidence = suggest.host_evidence(linked)
    boosted = suggest.boost(ranked, evidence, suggest.name_evidence(linked, performers))
    added = suggest.host_only(evidence, boosted, performers)
    return suggest.rank_suggestions(boosted, added, limit=limit)
