"""Identities: matching, promotion, consolidation, merging and upkeep.

``identities``: face_key, label, lifecycle, promotion_reason, reference_id,
reference_name, reference_pack, observation_count, quality, cover_asset,
cover_box, cover_quality, asset_ids (newest first, 32 at most), anchors
(array of model_key, quality, vector; 12 at most).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import IDENTITY, IdentitySettings
from sightline.functions.text import clean, is_blank, key_of
from sightline.functions.vectors import cosine
from sightline.operators.centroids import centroid
from sightline.operators.graph import close_merge_map
from sightline.operators.greedy import greedy_select
from sightline.operators.knn import APART, best_groups, group_scores, nearest
from sightline.operators.ordered import RANGE, bucketed_scan, first_by, ranged, top_k
from sightline.session import cut_lineage, forget, stored

PROMOTED, PROVISIONAL = "promoted", "provisional"
REFERENCE, MULTI_ASSET, VIDEO_EVIDENCE, IMAGE = "reference", "multi-asset", "video-evidence", "image"
COLUMNS = (
    "face_key",
    "label",
    "lifecycle",
    "promotion_reason",
    "reference_id",
    "reference_name",
    "reference_pack",
    "observation_count",
    "quality",
    "cover_asset",
    "cover_box",
    "cover_quality",
    "asset_ids",
    "anchors",
)


# -- scores ------------------------------------------------------------------


def pair_score(left: Column, right: Column, mode: str = "unit") -> Column:
    """For each left vector its best cosine on the right; mean of the best two. Zero where a side is empty or null.

    Both sides are short arrays of vectors (12 anchors at most); a batch of
    pairs is scored at once, as products of its unit vectors.
    """
    if mode not in ("raw", "unit"):
        raise ValueError(f"no pair score of mode {mode!r}")

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(_pair_means(left, right, mode == "unit"))

    return score(left.cast("array<array<double>>"), right.cast("array<array<double>>"))


def _unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Of lists of vectors: sizes of the lists, each vector's length and place among those of its length, unit rows by length."""
    lists = lists.fill_null([]) if lists.null_count else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = lists.flatten()
    vectors = vectors.fill_null([]) if vectors.null_count else vectors
    dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    place, rows = np.zeros(len(dims), np.int64), {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        own = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        norms = np.sqrt((own * own).sum(axis=1, keepdims=True))
        place[at], rows[dim] = np.arange(len(at)), np.divide(own, norms, out=np.zeros_like(own), where=norms > 0)
    return sizes, dims, rows, place


def _pair_means(left: pa.Array, right: pa.Array, clamp: bool, step: int = 1 << 22) -> np.ndarray:
    n_left, dim_left, rows_left, place_left = _unit_rows(left)
    n_right, dim_right, rows_right, place_right = _unit_rows(right)
    out = np.zeros(len(n_left))
    both = (n_left > 0) & (n_right > 0)
    # One line for each left vector of a scored pair, one cell for each right vector it meets.
    owner = np.repeat(np.flatnonzero(both), n_left[both])
    if not len(owner):
        return out
    first_left, first_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    starts = np.cumsum(n_left[both]) - n_left[both]
    line = np.repeat(first_left[both] - starts, n_left[both]) + np.arange(len(owner))
    cells = n_right[owner]
    heads = np.cumsum(cells) - cells
    a = np.repeat(line, cells)
    b = np.repeat(first_right[owner] - heads, cells) + np.arange(len(a))
    value = np.zeros(len(a))
    for dim in set(rows_left) & set(rows_right) - {0}:
        at = np.flatnonzero((dim_left[a] == dim) & (dim_right[b] == dim))
        for low in range(0, len(at), max(1, step // dim)):
            some = at[low : low + max(1, step // dim)]
            value[some] = np.einsum("ij,ij->i", rows_left[dim][place_left[a[some]]], rows_right[dim][place_right[b[some]]])
    if clamp:
        value = np.clip(value, 0.0, 1.0)
    best = np.maximum.reduceat(value, heads)
    # The best two of each pair's lines.
    order = np.lexsort((-best, owner))
    top = best[order]
    second = np.where(n_left[both] > 1, top[np.minimum(starts + 1, len(top) - 1)], np.nan)
    out[both] = np.where(np.isnan(second), top[starts], (top[starts] + second) / 2)
    return out


def _vectors(anchors: Column) -> Column:
    return F.transform(anchors, lambda a: a["vector"])


def _same_text(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def _conflict(a: Column, b: Column) -> Column:
    return ~is_blank(a) & ~is_blank(b) & ~_same_text(a, b)


def _is_promoted(lifecycle: Column) -> Column:
    return _same_text(lifecycle, F.lit(PROMOTED))


def _anchor_rows(identities: DataFrame) -> DataFrame:
    exploded = identities.select("face_key", F.posexplode("anchors").alias("_at", "a"))
    return exploded.select(
        "face_key",
        F.concat_ws("#", "face_key", "_at").alias("anchor_id"),
        F.col("a.vector").alias("vector"),
    )


def candidates(
    vectors: DataFrame,
    identities: DataFrame,
    references: DataFrame | None = None,
    *,
    key: Sequence[str] = ("asset_id", "track_key"),
    k: int = IDENTITY.candidate_k,
) -> DataFrame:
    """(key, face_key) pairs worth scoring: identities of the 20 nearest
    anchors of each vector, and those linked to a reference the key matched.

    ``vectors`` (key, vector_id, vector); ``references`` (key, reference_id).
    """
    key = list(key)
    found = nearest(
        vectors, _anchor_rows(identities), k, query_id="vector_id", row_id="anchor_id", keep=["face_key"]
    )
    near = found.join(vectors.select(*key, "vector_id"), "vector_id").select(*key, "face_key")
    if references is None:
        return near.distinct()
    linked = identities.filter(~is_blank("reference_id")).select(
        "face_key", F.lower("reference_id").alias("_ref")
    )
    named = references.withColumn("_ref", F.lower("reference_id")).join(linked, "_ref")
    return near.unionByName(named.select(*key, "face_key")).distinct()


def match_identity(
    tracks: DataFrame,
    pairs: DataFrame,
    identities: DataFrame,
    *,
    key: Sequence[str] = ("asset_id", "track_key"),
    cfg: IdentitySettings = IDENTITY,
) -> DataFrame:
    """The identity each track belongs to, if one stands out.

    ``tracks`` (key, asset_id, vectors). The best score must reach the
    threshold (lower when the identity was seen in the same asset) and lead by
    the margin, unless every rival within it looks like the same person as the
    best.
    """
    key = list(key)
    known = identities.select("face_key", "reference_id", "asset_ids", _vectors(F.col("anchors")).alias("_anchors"))
    scored = (
        pairs.join(tracks.select(*key, *[c for c in ("asset_id",) if c not in key], "vectors"), key)
        .join(known, "face_key")
        .withColumn("score", F.round(pair_score(F.col("vectors"), F.col("_anchors"), "raw"), 9))
        .filter(F.col("score") > 0)
    )
    best = first_by(
        scored.select(*key, *[c for c in ("asset_id",) if c not in key], "face_key", "score", "reference_id", "asset_ids", "_anchors"),
        key,
        [-F.col("score"), F.col("face_key")],
    )
    seen = F.exists("asset_ids", lambda a: _same_text(a, F.col("asset_id").cast("string")))
    needed = F.when(seen, max(0.0, cfg.match - cfg.same_asset_relaxation)).otherwise(cfg.match)
    chosen = best.filter(F.col("score") >= needed)
    rivals = scored.select(*key, F.col("face_key").alias("_rival"), F.col("score").alias("_score"), F.col("reference_id").alias("_ref"), F.col("_anchors").alias("_theirs"))
    close = chosen.join(rivals, key).filter(
        (F.col("_rival") != F.col("face_key")) & ((F.col("score") - F.col("_score")) < cfg.ambiguity)
    )
    same = ~_conflict(F.col("reference_id"), F.col("_ref")) & (
        pair_score(F.col("_anchors"), F.col("_theirs")) >= cfg.consolidation
    )
    blocked = close.groupBy(*key).agg(F.bool_and(same).alias("_same")).filter(~F.col("_same"))
    return chosen.join(blocked, key, "left_anti").select(*key, "face_key", "score")


def match_reference(
    vectors: DataFrame,
    reference: DataFrame,
    *,
    key: str,
    cfg: IdentitySettings = IDENTITY,
) -> DataFrame:
    """The reference identity of each key, accepted at 0.58 with a lead of
    0.03: the mean of its two best positive similarities counts.

    ``vectors`` (key, vector), ``reference`` (ordinal, external_id,
    display_name, vector).
    """
    top = best_groups(vectors, reference, group=key, row_id="ordinal", keep=["external_id", "display_name"], k=2)
    judged = top.groupBy(key).agg(
        F.max_by(F.struct("ordinal", "external_id", "display_name"), -F.col("rank")).alias("_best"),
        F.max("score").alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"),
    )
    lead = F.round(F.col("score") - F.coalesce(F.col("_second"), F.lit(0.0)), 9)
    return judged.filter(
        (F.col("score") >= cfg.reference_match) & (lead >= cfg.reference_margin)
    ).select(key, "_best.*", "score")


# -- creation and update -----------------------------------------------------


def _remember(front: Column, back: Column, limit: int = IDENTITY.asset_limit) -> Column:
    """Newest first, each asset once (ignoring case), at most 32."""
    older = F.filter(back, lambda b: ~F.exists(front, lambda f: _same_text(f, b)))
    return F.slice(F.concat(front, older), 1, limit)


def _usable(box: Column) -> Column:
    corners = [box[c].cast("double") for c in ("x1", "y1", "x2", "y2")]
    finite = F.lit(True)
    for c in corners:
        finite = finite & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(finite & (corners[2] > corners[0]) & (corners[3] > corners[1]), F.lit(False))


def create_identities(tracks: DataFrame, next_ordinal: int) -> DataFrame:
    """New identities for unmatched tracks with an anchor-grade vector or a
    reference match, named face-NNNN in (asset, track) order.

    ``tracks`` (asset_id, track_key, track_quality, cover_box, reference_id,
    reference_name, reference_pack).
    """
    order = [F.col("asset_id").cast("string"), F.col("track_key")]
    every = ranged(tracks.withColumn("_all", F.lit(0)), order)
    ranked = bucketed_scan(every, ["_all"], F.col(RANGE), order, rank="_rank", hot=True)
    number = F.col("_rank") + F.lit(next_ordinal - 1)
    padded = F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    none = F.lit(None)
    return ranked.select(
        "asset_id",
        "track_key",
        F.concat(F.lit("face-"), padded).alias("face_key"),
        F.when(~is_blank("reference_id"), F.col("reference_name")).alias("label"),
        F.lit(PROVISIONAL).alias("lifecycle"),
        none.cast("string").alias("promotion_reason"),
        clean("reference_id").alias("reference_id"),
        "reference_name",
        "reference_pack",
        F.lit(0).cast("bigint").alias("observation_count"),
        F.col("track_quality").alias("quality"),
        F.col("asset_id").cast("string").alias("cover_asset"),
        "cover_box",
        F.lit(0.0).alias("cover_quality"),
        F.array().cast("array<string>").alias("asset_ids"),
        F.array().cast("array<struct<model_key:string,quality:double,vector:array<float>>>").alias("anchors"),
    )


def update_identities(
    identities: DataFrame, assignments: DataFrame, anchors: DataFrame, cfg: IdentitySettings = IDENTITY
) -> DataFrame:
    """Fold matched tracks into their identities.

    ``assignments`` (face_key, asset_id, track_key, sample_count,
    track_quality, cover_box, cover_quality), ``anchors`` (face_key, asset_id,
    track_key, vector_pos, model_key, quality, vector). Counts add up, the 32
    latest assets (by ``assigned_order`` where given, else by id) stay, a better cover wins, and new anchors are added best
    first unless within 0.975 of one already there; the best 12 stay.
    """
    counts = assignments.groupBy("face_key").agg(
        F.sum("sample_count").alias("_samples"),
        F.max("track_quality").alias("_quality"),
        F.min_by(
            F.struct("asset_id", "cover_box", "cover_quality"),
            F.struct(-F.col("cover_quality"), F.col("asset_id"), F.col("track_key")),
        ).alias("_cover"),
    )
    asset = F.col("asset_id").cast("string")
    when = F.col("assigned_order") if "assigned_order" in assignments.columns else asset
    assets = assignments.groupBy("face_key", F.lower(asset).alias("_k")).agg(
        F.max(asset).alias("asset_id"), F.max(when).alias("_when")
    )
    latest = top_k(assets, ["face_key"], [F.desc("_when"), F.desc("_k")], cfg.asset_limit).groupBy("face_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_id"))), lambda a: a["asset_id"]).alias("_assets")
    )
    held = identities.select("face_key", F.explode("anchors").alias("a")).select(
        "face_key", F.col("a.vector").alias("vector")
    )
    fresh = greedy_select(
        anchors,
        ["face_key"],
        vector="vector",
        quality="quality",
        tie=["asset_id", "track_key", "vector_pos"],
        threshold=cfg.anchor_duplicate,
        limit=cfg.anchor_limit,
        held=held,
    )
    added = fresh.groupBy("face_key").agg(
        F.collect_list(F.struct("model_key", "quality", "vector")).alias("_new")
    )
    joined = (
        identities.join(counts, "face_key", "left").join(latest, "face_key", "left").join(added, "face_key", "left")
    )
    empty = F.array().cast(identities.schema["anchors"].dataType.simpleString())
    refresh = F.col("_cover").isNotNull() & (
        is_blank("cover_asset")
        | ~_usable(F.col("cover_box"))
        | (F.col("_cover.cover_quality") > F.coalesce(F.col("cover_quality"), F.lit(0.0)))
    )
    return joined.withColumns(
        {
            "observation_count": F.col("observation_count") + F.coalesce(F.col("_samples"), F.lit(0)),
            "quality": F.greatest("quality", "_quality"),
            "cover_asset": F.when(refresh, F.col("_cover.asset_id").cast("string")).otherwise(F.col("cover_asset")),
            "cover_box": F.when(refresh, F.col("_cover.cover_box")).otherwise(F.col("cover_box")),
            "cover_quality": F.when(refresh, F.col("_cover.cover_quality")).otherwise(F.col("cover_quality")),
            "asset_ids": _remember(F.coalesce("_assets", F.array().cast("array<string>")), F.col("asset_ids"), cfg.asset_limit),
            "anchors": _capped(F.concat(F.col("anchors"), F.coalesce("_new", empty)), cfg.anchor_limit),
        }
    ).select(*identities.columns)


def _capped(anchors: Column, limit: int) -> Column:
    """All anchors when they fit, else the best by quality (earlier on a tie)."""
    indexed = F.transform(anchors, lambda a, i: F.struct((-a["quality"]).alias("q"), i.alias("i"), a.alias("a")))
    best = F.transform(F.slice(F.array_sort(indexed), 1, limit), lambda s: s["a"])
    return F.when(F.size(anchors) <= limit, anchors).otherwise(best)


# -- promotion ---------------------------------------------------------------


def represented_seconds(cfg: IdentitySettings = IDENTITY) -> Column:
    """Seconds of the asset a track stands for: samples times interval, or its
    span plus one interval, neither beyond the duration.
    """
    interval = F.greatest(F.lit(1.0), F.coalesce(F.col("frame_interval"), F.lit(0.5)))
    by_count = F.col("sample_count") * interval
    start, end = F.col("start_seconds"), F.col("end_seconds")
    by_span = F.when(end >= start, end - start + interval).otherwise(F.lit(0.0))
    by_span = F.coalesce(by_span, F.lit(0.0))
    limit = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return F.greatest(F.least(by_count, limit), F.least(by_span, limit))


def promotion_reason(cfg: IdentitySettings = IDENTITY) -> Column:
    """Why an identity may be promoted on a track, or null.

    Reads media_kind, reference_id, asset_count, sample_count, frame_interval,
    duration_seconds, start_seconds, end_seconds.
    """
    interval = F.greatest(F.lit(1.0), F.coalesce(F.col("frame_interval"), F.lit(0.5)))
    duration = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    samples = F.col("sample_count")
    estimate = F.greatest(F.lit(1.0), F.ceil(duration / interval).cast("double"))
    coverage = F.coalesce(F.ceil(estimate * cfg.sparse_coverage), F.lit(0))
    required = F.least(F.lit(cfg.promotion_samples), F.greatest(F.lit(cfg.sparse_samples), coverage))
    short = (samples == 1) & F.coalesce(duration <= interval, F.lit(False))
    sparse = (interval >= cfg.sparse_interval) & (
        short | ((samples >= required) & (represented_seconds(cfg) >= cfg.promotion_seconds))
    )
    return (
        F.when(~is_blank("reference_id"), REFERENCE)
        .when(F.col("media_kind") == "image", IMAGE)
        .when(F.col("asset_count") > 1, MULTI_ASSET)
        .when((F.col("media_kind") == "video") & ((samples >= cfg.promotion_samples) | sparse), VIDEO_EVIDENCE)
    )


def promote_by_tracks(identities: DataFrame, assignments: DataFrame, cfg: IdentitySettings = IDENTITY) -> DataFrame:
    """Promote identities some assigned track gives a reason for (the
    strongest reason counts; promoted ones stay as they are).
    """
    order = F.array(*[F.lit(r) for r in (REFERENCE, IMAGE, MULTI_ASSET, VIDEO_EVIDENCE)])
    facts = assignments.join(
        identities.select("face_key", "reference_id", F.size("asset_ids").alias("asset_count")), "face_key"
    )
    reasons = (
        facts.withColumn("_why", promotion_reason(cfg))
        .filter(F.col("_why").isNotNull())
        .groupBy("face_key")
        .agg(F.min_by("_why", F.array_position(order, F.col("_why"))).alias("_why"))
    )
    due = ~_is_promoted(F.col("lifecycle")) & F.col("_why").isNotNull()
    return identities.join(reasons, "face_key", "left").withColumns(
        {
            "lifecycle": F.when(due, PROMOTED).otherwise(F.col("lifecycle")),
            "promotion_reason": F.when(due, F.col("_why")).otherwise(F.col("promotion_reason")),
        }
    ).select(*identities.columns)


def promote_by_evidence(identities: DataFrame) -> DataFrame:
    """Promote identities with a reference or seen in two assets."""
    distinct = F.size(F.array_distinct(F.transform("asset_ids", lambda a: F.lower(a))))
    why = F.when(~is_blank("reference_id"), REFERENCE).when(distinct >= 2, MULTI_ASSET)
    due = ~_is_promoted(F.col("lifecycle")) & why.isNotNull()
    return identities.withColumns(
        {
            "lifecycle": F.when(due, PROMOTED).otherwise(F.col("lifecycle")),
            "promotion_reason": F.when(due, why).otherwise(F.col("promotion_reason")),
        }
    )


def brief_presence(assignments: DataFrame, cfg: IdentitySettings = IDENTITY) -> DataFrame:
    """(asset_id, face_key) of video identities on screen for less than 8
    seconds in all, or less than half of a shorter video.

    ``assignments`` (asset_id, face_key, media_kind, sample_count,
    frame_interval, duration_seconds, start_seconds, end_seconds); unresolved
    tracks (null face_key) count for the span an unknown duration is read from.
    """
    videos = assignments.filter(F.col("media_kind") == "video")
    spans = videos.groupBy("asset_id").agg(
        F.max("duration_seconds").alias("_duration"),
        (F.max("end_seconds") - F.min("start_seconds")).alias("_span"),
    )
    span = F.when(F.col("_span") > 0, F.col("_span"))
    length = F.coalesce(F.col("_duration"), span)
    floor = F.when(length > 0, F.least(F.lit(cfg.presence_seconds), length * 0.5)).otherwise(cfg.presence_seconds)
    shown = (
        videos.filter(F.col("face_key").isNotNull())
        .groupBy("asset_id", "face_key")
        .agg(F.sum(represented_seconds(cfg)).alias("seconds"))
    )
    return (
        shown.join(spans.select("asset_id", floor.alias("floor")), "asset_id")
        .filter((F.col("floor") > 0) & (F.col("seconds") < F.col("floor")))
        .select("asset_id", "face_key", "seconds", "floor")
    )


# -- consolidation -----------------------------------------------------------


def _threshold(l: dict[str, Column], r: dict[str, Column], cfg: IdentitySettings) -> Column:
    shared = F.exists(l["asset_ids"], lambda a: F.exists(r["asset_ids"], lambda b: _same_text(a, b)))
    both = _is_promoted(l["lifecycle"]) & _is_promoted(r["lifecycle"])
    same_reference = ~is_blank(l["reference_id"]) & _same_text(l["reference_id"], r["reference_id"])
    referenced = ~is_blank(l["reference_id"]) | ~is_blank(r["reference_id"])

    def anonymous(x: dict[str, Column]) -> Column:
        return (
            _is_promoted(x["lifecycle"])
            & is_blank(x["reference_id"])
            & _same_text(x["promotion_reason"], F.lit(VIDEO_EVIDENCE))
        )

    relaxed = min(cfg.consolidation_same_asset, cfg.match)
    apart = F.when(both & ~same_reference, max(cfg.consolidation, cfg.consolidation_promoted)).otherwise(cfg.consolidation)
    together = F.when(referenced | (anonymous(l) & anonymous(r)), relaxed).otherwise(cfg.consolidation_same_asset)
    return F.when(shared, together).otherwise(apart)


_FACTS = ("lifecycle", "promotion_reason", "reference_id", "asset_ids", "observation_count", "quality")


def _least_score(cfg: IdentitySettings) -> float:
    """Below this a pair neither merges nor comes within the margin of one that does."""
    lowest = min(cfg.consolidation, cfg.consolidation_same_asset, cfg.match)
    return max(1e-9, lowest - cfg.consolidation_margin)


#: Identities whose facts are sent to the pairs, and merges that are sent to the identities, instead of a shuffle of both.
FEW_FACTS, FEW_MERGES = 4096, 512


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _sides(pairs: DataFrame, identities: DataFrame, few: bool = False) -> DataFrame:
    left = identities.select(F.col("face_key").alias("source"), F.struct(*_FACTS).alias("_l"))
    right = identities.select(F.col("face_key").alias("other"), F.struct(*_FACTS).alias("_r"))
    return pairs.join(_sent(left, few), "source").join(_sent(right, few), "other")


def _struct_fields(name: str) -> dict[str, Column]:
    return {f: F.col(f"{name}.{f}") for f in _FACTS}


def pair_scores(
    identities: DataFrame, others: DataFrame | None = None, cfg: IdentitySettings = IDENTITY
) -> DataFrame:
    """(source, other, score) of all pairs of identities whose score can matter for merging, both ways.

    Every identity is held against every other one, block by block. With
    ``others`` only pairs between the two sets.
    """

    def vectors(df: DataFrame) -> DataFrame:
        return df.select("face_key", F.explode("anchors").alias("a")).select("face_key", F.col("a.vector").alias("vector"))

    mine = vectors(identities)
    if others is None:
        found = group_scores(mine, mine, group="face_key", least=_least_score(cfg))
    else:
        rest = vectors(others)
        # The score of a pair depends on its direction: each side is asked in turn.
        found = group_scores(mine, rest, group="face_key", least=_least_score(cfg)).unionByName(
            group_scores(rest, mine, group="face_key", least=_least_score(cfg))
        )
    return found.filter(F.col("source") != F.col("other")).distinct()


def near_scores(
    identities: DataFrame, cfg: IdentitySettings = IDENTITY, others: DataFrame | None = None, depth: float = 1.0
) -> DataFrame:
    """(source, other, score): of ``pair_scores`` at least what comes within ``depth`` margins of a source's best, and few others.

    Every pair is scored; what a round of merges doesn't ask for never leaves
    its task. With ``others`` the identities are held against those alone.
    """

    def vectors(df: DataFrame) -> DataFrame:
        mark = F.when(is_blank("reference_id"), F.lit("")).otherwise(F.lower("reference_id"))
        return df.select(F.concat("face_key", F.lit(APART), mark).alias("named"), F.explode("anchors").alias("a")).select(
            "named", F.col("a.vector").alias("vector")
        )

    right = vectors(identities if others is None else others)
    margin = depth * cfg.consolidation_margin
    found = group_scores(vectors(identities), right, group="named", least=_least_score(cfg), margin=margin)
    return found.select(*[F.substring_index(c, APART, 1).alias(c) for c in ("source", "other")], "score")


def merge_proposals(
    identities: DataFrame, scores: DataFrame, cfg: IdentitySettings = IDENTITY, *, complete: bool = True, few: bool = False
) -> DataFrame:
    """For each identity the best one it should merge with, if any
    (source, other, score): the score reaches the pair's threshold and leads
    the runner-up, or every rival within the margin could itself merge with
    the best. Conflicting references never pair. ``scores`` as by
    ``pair_scores``; not ``complete`` as by ``near_scores``: pairs of a best
    one and a rival are then scored where they are missing. ``few``: the
    identities are at most ``FEW_FACTS``.
    """
    l, r = _struct_fields("_l"), _struct_fields("_r")
    scored = cut_lineage(
        _sides(scores, identities, few)
        .filter(~_conflict(l["reference_id"], r["reference_id"]))
        .select("source", "other", "score", (F.col("score") >= _threshold(l, r, cfg)).alias("merges"))
    )
    # Equal scores fall to a hash of the pair: copies of one face then pair off among themselves, where the smallest
    # key would draw all of them to one.
    order = F.struct((-F.col("score")).alias("down"), _pair_hash("source", "other").alias("hash"), "other")
    best = (
        scored.groupBy("source")
        .agg(F.min(order).alias("first"), F.min_by("merges", order).alias("merges"))
        .filter("merges")
        .select("source", F.col("first.other").alias("other"), (-F.col("first.down")).alias("score"))
    )
    rivals = scored.select("source", F.col("other").alias("rival"), F.col("score").alias("near"))
    close = best.join(rivals, "source").filter(
        (F.col("rival") != F.col("other")) & ((F.col("score") - F.col("near")) < cfg.consolidation_margin)
    )
    # A rival that has no score with the best one, or conflicts with it, can't merge with it.
    judged = scored.filter("merges").select(F.col("source").alias("other"), F.col("other").alias("rival"))
    blocked = close.join(judged, ["other", "rival"], "left_anti")
    if not complete:
        blocked = cut_lineage(blocked)
        open_ones = blocked.select(F.col("other").alias("source"), F.col("rival").alias("other")).distinct()
        anchors = identities.select("face_key", F.transform("anchors", lambda a: a["vector"]).alias("_v"))
        sides = _sides(open_ones, identities, few).filter(~_conflict(l["reference_id"], r["reference_id"]))
        sides = sides.join(anchors.toDF("source", "_lv"), "source").join(anchors.toDF("other", "_rv"), "other")
        own = F.round(pair_score(F.col("_lv"), F.col("_rv")), 9)
        merging = sides.withColumn("_own", own).filter(F.col("_own") >= _threshold(l, r, cfg))
        blocked = blocked.join(merging.select(F.col("source").alias("other"), F.col("other").alias("rival")), ["other", "rival"], "left_anti")
    blocked = blocked.select("source").distinct()
    return best.join(blocked, "source", "left_anti")


def _pair_hash(a: str, b: str) -> Column:
    return F.md5(F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def independent_merges(proposals: DataFrame) -> DataFrame:
    """Proposals that are the strongest at both of their ends, so that all of
    them can be merged at once (source, other).

    Of equally strong ones a hash of the pair decides: among many equal
    proposals a constant share is chosen in each round.
    """
    edges = proposals.select(
        F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "score"
    ).groupBy("a", "b").agg(F.max("score").alias("score"))
    turn = F.struct((-F.col("score")).alias("down"), _pair_hash("a", "b").alias("hash"), "a", "b")
    edges = edges.withColumn("turn", turn)
    ends = edges.select("a", "b", "turn", F.explode(F.array("a", "b")).alias("end"))
    top = ends.groupBy("end").agg(F.min("turn").alias("top"))
    agreed = ends.join(top, "end").filter(F.col("turn") == F.col("top"))
    return (
        agreed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2)
        .select(F.col("a").alias("source"), F.col("b").alias("other"))
    )


def chosen_merges(identities: DataFrame, chosen: DataFrame, few: bool = False) -> DataFrame:
    """(duplicate, target) of pairs to merge."""
    keep_left = choose_target(_struct_fields("_l"), _struct_fields("_r"))
    return _sides(chosen, identities, few).select(
        F.when(keep_left, F.col("other")).otherwise(F.col("source")).alias("duplicate"),
        F.when(keep_left, F.col("source")).otherwise(F.col("other")).alias("target"),
    )


def choose_target(l: dict[str, Column], r: dict[str, Column]) -> Column:
    """True where the left one is kept: promoted, then referenced, then more
    observations, then quality.
    """
    lp, rp = _is_promoted(l["lifecycle"]), _is_promoted(r["lifecycle"])
    lr, rr = ~is_blank(l["reference_id"]), ~is_blank(r["reference_id"])
    return (
        F.when(lp != rp, lp)
        .when(lr != rr, lr)
        .when(l["observation_count"] != r["observation_count"], l["observation_count"] > r["observation_count"])
        .otherwise(l["quality"] >= r["quality"])
    )


def merge_into(identities: DataFrame, merges: DataFrame, cfg: IdentitySettings = IDENTITY, few: bool = False) -> DataFrame:
    """Fold each duplicate into its target (one duplicate per target).

    ``merges`` (duplicate, target); ``few``: they are at most ``FEW_MERGES``.
    """
    merges = _sent(merges, few)
    row = F.struct(*[F.col(c) for c in COLUMNS])
    duplicates = identities.select(F.col("face_key").alias("duplicate"), row.alias("_d"))
    joined = identities.join(merges, identities["face_key"] == merges["duplicate"], "left_anti").join(
        _sent(duplicates.join(merges, "duplicate").withColumnRenamed("target", "face_key"), few), "face_key", "left"
    )
    d = {c: F.col(f"_d.{c}") for c in COLUMNS}
    has = F.col("_d").isNotNull()
    adopt = has & is_blank("reference_id")
    promote = has & _is_promoted(d["lifecycle"]) & ~_is_promoted(F.col("lifecycle"))
    cover = has & d["cover_box"].isNotNull() & (
        F.col("cover_box").isNull() | (d["cover_quality"] > F.col("cover_quality"))
    )
    order = F.array_sort(
        F.transform(d["anchors"], lambda a, i: F.struct((-a["quality"]).alias("q"), i.alias("i"), a.alias("a")))
    )
    merged = F.aggregate(
        order,
        F.col("anchors"),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: cosine(k["vector"], s["a"]["vector"], "unit") >= cfg.anchor_duplicate), kept
        ).otherwise(F.concat(kept, F.array(s["a"]))),
    )

    def either(condition: Column, name: str) -> Column:
        return F.when(condition, d[name]).otherwise(F.col(name))

    return joined.withColumns(
        {
            "label": either(has & is_blank("label"), "label"),
            **{c: either(adopt, c) for c in ("reference_id", "reference_name", "reference_pack")},
            "lifecycle": either(promote, "lifecycle"),
            "promotion_reason": either(promote, "promotion_reason"),
            "observation_count": F.col("observation_count") + F.coalesce(d["observation_count"], F.lit(0)),
            "quality": F.greatest("quality", d["quality"]),
            **{c: either(cover, c) for c in ("cover_asset", "cover_box", "cover_quality")},
            "asset_ids": F.when(has, _remember(d["asset_ids"], F.col("asset_ids"), cfg.asset_limit)).otherwise(
                F.col("asset_ids")
            ),
            "anchors": F.when(has, _capped(merged, cfg.anchor_limit)).otherwise(F.col("anchors")),
        }
    ).select(*COLUMNS)


#: Margins below a source's best down to which its scores are kept from round to round.
DEPTH = 2.0


def _kept_scores(scores: DataFrame, cfg: IdentitySettings) -> DataFrame:
    """``scores`` of each source down to its floor, with ``open``: whether a score within the margin may be missing.

    A row without ``other`` states a floor: above it the source's scores are
    complete. The floor rises with the best score, as what lies ``DEPTH``
    margins below it isn't needed now.
    """
    own = Window.partitionBy("source")
    named = F.col("other").isNotNull()
    best = F.max(F.when(named, F.col("score"))).over(own)
    known = F.max(F.when(~named, F.col("score"))).over(own)
    floor = F.greatest(known, best - DEPTH * cfg.consolidation_margin)
    short = (known > _least_score(cfg)) & (F.coalesce(best - cfg.consolidation_margin, F.lit(0.0)) < known + 1e-9)
    return scores.select("source", "other", "score", floor.alias("floor"), short.alias("open")).select(
        "source", "other", F.when(named, F.col("score")).otherwise(F.col("floor")).alias("score"), "floor", "open"
    ).filter("score >= floor").drop("floor")


def consolidate(identities: DataFrame, cfg: IdentitySettings = IDENTITY) -> tuple[DataFrame, DataFrame]:
    """Merge identities of the same person until none qualifies.

    Returns the remaining identities and the closed merge map (duplicate,
    target). Each round merges, at once, all proposals that are the strongest
    at both ends; the strongest of all is among them, so every round merges
    and the rounds end when no identity has a valid proposal. One-at-a-time
    merging in list order may pick other pairs on larger graphs; the stopping
    rule is the same.

    From round to round only the scores near each identity's best are kept.
    Identities that a round has changed are scored again, and those whose
    kept scores no longer reach as far down as the margin asks for. What goes
    from round to round is read back from files: a checkpoint keeps what the
    planner knows of its columns, which would grow with every round.
    """
    current = stored(identities.select(*COLUMNS), "identities")
    left = current.count()
    names = ["source", "other", "score"]

    def scored(some: DataFrame) -> DataFrame:
        """Of ``some`` identities the scores with all that are left, and the least score as a floor."""
        floors = some.select(F.col("face_key").alias("source"), F.lit(None).cast("string").alias("other"), F.lit(_least_score(cfg)).alias("score"))
        found = near_scores(some, cfg, current, DEPTH).unionByName(floors)
        # The floor of all scores follows from the best: none of these is open.
        return _kept_scores(found, cfg).select(*names)

    scores = stored(scored(current), "scores")
    history = None
    while True:
        few = left <= FEW_FACTS
        proposals = merge_proposals(current, scores.filter("other IS NOT NULL"), cfg, complete=False, few=few)
        merges = stored(chosen_merges(current, independent_merges(proposals), few), "merges")
        merged = merges.count()
        if not merged:
            break
        left, few = left - merged, merged <= FEW_MERGES
        history = merges if history is None else history.unionByName(merges)
        before, current = current, stored(merge_into(current, merges, cfg, few), "identities")
        forget(before)
        stale = _sent(merges.select(F.explode(F.array("duplicate", "target")).alias("face_key")), few)
        changed = current.join(stale, "face_key", "left_semi")
        kept = scores.join(stale.withColumnRenamed("face_key", "source"), "source", "left_anti").join(
            stale.withColumnRenamed("face_key", "other"), "other", "left_anti"
        )
        added = near_scores(current.join(stale, "face_key", "left_anti"), cfg, changed, DEPTH)
        known = cut_lineage(_kept_scores(kept.select(*names).unionByName(added), cfg))
        again = known.filter("open AND other IS NULL").select(F.col("source").alias("face_key"))
        again = cut_lineage(current.join(again.unionByName(merges.select(F.col("target").alias("face_key"))), "face_key", "left_semi"))
        before, scores = scores, stored(known.filter("NOT open").select(*names).unionByName(scored(again)), "scores")
        forget(before)
    if history is None:
        history = current.select(F.col("face_key").alias("duplicate"), F.col("face_key").alias("target")).limit(0)
    return current, close_merge_map(history)


def backfill(identities: DataFrame, reference: DataFrame, pack_id: str, cfg: IdentitySettings = IDENTITY) -> DataFrame:
    """Match every identity without a reference against a reference set,
    label and promote those that match.
    """
    open_ones = identities.filter(is_blank("reference_id") & (F.size("anchors") > 0))
    vectors = open_ones.select("face_key", F.explode("anchors").alias("a")).select(
        "face_key", F.col("a.vector").alias("vector")
    )
    matched = match_reference(vectors, reference, key="face_key", cfg=cfg).select(
        "face_key", F.col("external_id").alias("_id"), F.col("display_name").alias("_name")
    )
    hit = F.col("_id").isNotNull()
    promote = hit & ~_is_promoted(F.col("lifecycle"))
    return identities.join(matched, "face_key", "left").withColumns(
        {
            "reference_id": F.coalesce("_id", "reference_id"),
            "reference_name": F.when(hit, F.col("_name")).otherwise(F.col("reference_name")),
            "reference_pack": F.when(hit, F.lit(pack_id)).otherwise(F.col("reference_pack")),
            "label": F.when(hit & is_blank("label"), F.col("_name")).otherwise(F.col("label")),
            "lifecycle": F.when(promote, PROMOTED).otherwise(F.col("lifecycle")),
            "promotion_reason": F.when(promote, REFERENCE).otherwise(F.col("promotion_reason")),
        }
    ).select(*identities.columns)


# -- stored rows -------------------------------------------------------------


def repoint(table: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Rows of merged-away faces point at the face that took them over."""
    map_ = merges.select(F.col("duplicate").alias(column), F.col("target").alias("_to"))
    return table.join(map_, column, "left").withColumn(column, F.coalesce("_to", column)).select(*table.columns)


def merge_faces(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Mark merged faces and let targets take over a missing performer and a
    missing or generated label. ``faces`` (face_id, face_key, label,
    performer_id, merged_into).
    """
    gone = merges.select(F.col("duplicate").alias("face_id"), F.col("target").alias("_to"))
    carried = faces.join(gone, "face_id").groupBy(F.col("_to").alias("face_id")).agg(
        F.min_by("performer_id", F.when(F.col("performer_id").isNotNull(), F.col("face_id"))).alias("_performer"),
        F.max_by("label", F.when(~is_blank("label"), F.col("face_id"))).alias("_label"),
    )
    joined = faces.join(gone, "face_id", "left").join(carried, "face_id", "left")
    generated = is_blank("label") | _same_text(F.col("label"), F.col("face_key"))
    return joined.withColumns(
        {
            "performer_id": F.coalesce("performer_id", "_performer"),
            "label": F.when(generated & F.col("_label").isNotNull(), F.col("_label")).otherwise(F.col("label")),
            "merged_into": F.coalesce("_to", "merged_into"),
        }
    ).select(*faces.columns)


def face_stats(detections: DataFrame, appearances: DataFrame) -> DataFrame:
    """Per face: detections, distinct hosts by type, and sampled frames; faces
    without appearances fall back to their detections.
    """

    def hosts(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("host_type") == kind, F.col("host_id")))

    found = detections.groupBy("face_id").agg(
        F.count(F.lit(1)).alias("_detections"), hosts("video").alias("_dv"), hosts("image").alias("_di")
    )
    seen = appearances.groupBy("face_id").agg(
        F.sum("sample_count").alias("_samples"), hosts("video").alias("_av"), hosts("image").alias("_ai")
    )
    joined = found.join(seen, "face_id", "full_outer")
    videos = F.coalesce("_av", "_dv", F.lit(0))
    images = F.coalesce("_ai", "_di", F.lit(0))
    return joined.select(
        "face_id",
        F.coalesce("_detections", F.lit(0)).alias("detection_count"),
        (videos + images).alias("appearance_count"),
        F.coalesce("_samples", "_detections", F.lit(0)).alias("frame_sample_count"),
        videos.alias("video_count"),
        images.alias("image_count"),
    )


def suppress(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Rows of faces not marked absent from their host (face_key, host)."""
    marks = suppressions.select(key_of("face_key").alias("_key"), "host_type", "host_id").distinct()
    return rows.withColumn("_key", key_of("face_key")).join(
        marks, ["_key", "host_type", "host_id"], "left_anti"
    ).drop("_key")


def persistable(identities: DataFrame) -> DataFrame:
    """Identities that may be stored: provisional ones are not."""
    return identities.filter(_is_promoted(F.col("lifecycle")))


def propagate_links(
    appearances: DataFrame, faces: DataFrame, host_performers: DataFrame, owned: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give hosts the performers of the faces on them, and take back what we
    gave when nothing supports it any more.

    ``owned`` (face_id, performer_id, host_type, host_id): links we added.
    Links that existed before are never owned, so never taken back. Returns
    the host links and the owned rows after the change.
    """
    key = ["performer_id", "host_type", "host_id"]
    linked = faces.filter(F.col("performer_id").isNotNull() & F.col("merged_into").isNull())
    wanted = (
        appearances.select("face_id", "host_type", "host_id")
        .distinct()
        .join(linked.select("face_id", "performer_id"), "face_id")
    )
    kept = owned.join(wanted, ["face_id", *key], "left_semi")
    dropped = owned.join(wanted, ["face_id", *key], "left_anti").select(*key).distinct()
    organic = host_performers.select(*key).distinct().join(owned.select(*key).distinct(), key, "left_anti")
    fresh = wanted.join(organic, key, "left_anti").join(owned.select("face_id", *key), ["face_id", *key], "left_anti")
    owned_after = kept.select("face_id", *key).unionByName(fresh.select("face_id", *key))
    unsupported = dropped.join(owned_after.select(*key).distinct(), key, "left_anti")
    links = (
        host_performers.select(*key)
        .unionByName(owned_after.select(*key))
        .distinct()
        .join(unsupported, key, "left_anti")
    )
    return links, owned_after


def split_not_present(
    marks: DataFrame,
    faces: DataFrame,
    appearances: DataFrame,
    embeddings: DataFrame,
    cfg: IdentitySettings = IDENTITY,
) -> tuple[DataFrame, DataFrame]:
    """Move the occurrences of wrong persons away from a face.

    ``marks`` (face_id, host_type, host_id) says a face is not on a host;
    ``appearances`` and ``embeddings`` share ``run_id`` (one run, one host).
    The marked host leaves, and so do hosts that resemble it (0.50) clearly
    more than the rest of the face. They go to the most similar other face
    (0.54 or more, not merged or ignored) or to a new one.

    Returns moves (face_id, host_type, host_id, target_key, is_new) and the
    suppressions (face_key, host_type, host_id). ``target_key`` is a face id
    as text or, for a new face, ``split:<face>:<host>``.
    """
    host, mark = ["host_type", "host_id"], ["face_id", "mark_type", "mark_id"]
    seen = appearances.select("face_id", *host).distinct()
    runs = appearances.filter(~is_blank("run_id")).select("face_id", "run_id", *host).distinct()
    vectors = embeddings.select(F.col("host_id").alias("face_id"), "run_id", "embedding_id", "vector").join(
        runs, ["face_id", "run_id"]
    )
    by_host = cut_lineage(
        centroid(vectors, ["face_id", *host], first=F.col("embedding_id"), norm_rule="required").select(
            "face_id", *host, "vector"
        )
    )
    asked = marks.join(seen, ["face_id", *host], "left_semi").select(
        "face_id", F.col("host_type").alias("mark_type"), F.col("host_id").alias("mark_id")
    ).distinct()
    is_mark = (F.col("host_type") == F.col("mark_type")) & (F.col("host_id") == F.col("mark_id"))
    around = asked.join(by_host, "face_id")
    others = around.filter(~is_mark)
    exemplar = around.filter(is_mark).select(*mark, F.col("vector").alias("_mark"))
    rest = centroid(others, mark, first=F.struct(*host), norm_rule="required").select(
        *mark, F.col("vector").alias("_rest")
    )
    compared = others.join(exemplar, mark).join(rest, mark, "left")
    to_mark = cosine("vector", "_mark", "signed")
    to_rest = F.when(F.col("_rest").isNull(), 0.0).otherwise(cosine("vector", "_rest", "signed"))
    along = compared.filter((to_mark >= cfg.not_present_split) & (to_mark > to_rest + cfg.ambiguity))
    leaving = asked.select(*mark, F.col("mark_type").alias("host_type"), F.col("mark_id").alias("host_id")).unionByName(
        along.select(*mark, *host)
    )
    moved = centroid(
        leaving.join(by_host, ["face_id", *host]), mark, first=F.struct(*host), norm_rule="required"
    ).select(*mark, F.concat_ws(":", *mark).alias("query_id"), "vector")
    near = nearest(moved, embeddings, 20, row_id="embedding_id", keep=["host_id"]).select(
        "query_id", F.col("host_id").alias("_face"), (1 - F.col("distance")).alias("_similarity")
    )
    open_faces = faces.filter(F.col("merged_into").isNull() & ~F.col("ignored")).select(F.col("face_id").alias("_face"))
    homes = (
        near.join(moved.select("query_id", *mark), "query_id")
        .filter((F.col("_face") != F.col("face_id")) & (F.col("_similarity") >= cfg.consolidation))
        .join(open_faces, "_face")
        .groupBy(*mark)
        .agg(F.min_by("_face", F.struct(-F.col("_similarity"), F.col("_face"))).alias("_home"))
    )
    placed = leaving.join(homes, mark, "left")
    new_key = F.concat_ws(":", F.lit("split"), F.col("face_id"), F.col("mark_type"), F.col("mark_id"))
    moves = placed.select(
        "face_id",
        *host,
        F.coalesce(F.col("_home").cast("string"), new_key).alias("target_key"),
        F.col("_home").isNull().alias("is_new"),
    )
    once = first_by(moves, ["face_id", *host], [F.col("is_new"), F.col("target_key")])
    suppressed = once.join(faces.select("face_id", "face_key"), "face_id").filter(~is_blank("face_key"))
    return once, suppressed.select("face_key", *host)


def apply_moves(table: DataFrame, moves: DataFrame, runs: DataFrame) -> DataFrame:
    """Re-point rows (face_id, run_id) of moved hosts by their run.

    ``runs`` (face_id, run_id, host_type, host_id). Adds ``target_key``.
    """
    by_run = moves.join(runs, ["face_id", "host_type", "host_id"]).select("face_id", "run_id", "target_key").distinct()
    joined = table.join(by_run, ["face_id", "run_id"], "left")
    return joined.withColumn("target_key", F.coalesce("target_key", F.col("face_id").cast("string")))


def cover_winner(faces: DataFrame, offered: DataFrame, margin: float = IDENTITY.cover_margin) -> DataFrame:
    """Covers to (re)generate: faces without one, or whose offered quality
    beats the stored one by more than the margin. ``faces`` (face_key,
    has_cover, cover_quality), ``offered`` (face_key, candidate, cover_quality).
    """
    best = offered.groupBy("face_key").agg(
        F.max_by("candidate", F.struct("cover_quality", -F.col("candidate"))).alias("candidate"),
        F.max("cover_quality").alias("offered_quality"),
    )
    stored = F.col("cover_quality")
    due = ~F.col("has_cover") | (
        F.col("offered_quality").isNotNull() & (stored.isNull() | (F.col("offered_quality") > stored + margin))
    )
    return faces.join(best, "face_key").filter(due).select("face_key", "candidate", "offered_quality")


def commit_identities(base: DataFrame, snapshot: DataFrame, loaded: DataFrame) -> DataFrame:
    """Changes between the stored identities and a worked-on snapshot:
    ``action`` insert, update or delete per face key. Only ``loaded`` keys,
    the part of the base the work started from, can be deleted.
    """
    stored = base.select("face_key", F.struct(*[c for c in COLUMNS if c != "face_key"]).alias("_old"))
    current = snapshot.select("face_key", F.struct(*[c for c in COLUMNS if c != "face_key"]).alias("_new"))
    joined = stored.join(loaded.select("face_key"), "face_key", "left_semi").join(current, "face_key", "full_outer")
    old_in_base = F.col("_old").isNotNull()
    action = (
        F.when(~old_in_base, "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    )
    return joined.withColumn("action", action).select("face_key", "action", "_new.*")


def apply_commit(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored identities after the changes."""
    kept = base.select(*COLUMNS).join(changes.select("face_key"), "face_key", "left_anti")
    written = changes.filter(F.col("action") != "delete").select(*COLUMNS)
    return kept.unionByName(written)


def purge(identities: DataFrame, *, face_keys: DataFrame | None = None, entire_source: bool = False) -> DataFrame:
    """Identities left after deleting single keys, or all for a whole source."""
    if entire_source:
        return identities.limit(0)
    if face_keys is None:
        return identities
    return identities.join(face_keys.select("face_key").distinct(), "face_key", "left_anti")
