"""More-like-this: query sets of an asset or time range, and their blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import (
    AUDIO_FAMILY,
    AUDIO_KIND,
    FEATURE_FAMILY,
    FEATURE_KIND,
    SEARCH,
    SEMANTIC_FAMILY,
    SEMANTIC_KIND,
)
from sightline.operators.centroids import centroid
from sightline.operators.blend import BlendedHosts, MeanHosts
from sightline.operators.knn import nearest, space_of
from sightline.operators.ordered import first_by, time_bucket, top_k
from sightline.operators.search import best_per_host
from sightline.operators.timeline import interval_weights, merge_intervals, representatives
from sightline.operators.walk import walk
from sightline.session import cut_lineage

MATCH_ON = ("kind", "kind_family", "modality", "is_semantic", "source_key")
OVERALL_VISUAL, OVERALL_SEMANTIC = "overall_visual", "overall_semantic"
PART_VISUAL, PART_SEMANTIC = "part_visual", "part_semantic"
# Order in which roles take turns in the diversified result.
ROLE_TURNS = (PART_VISUAL, OVERALL_VISUAL, OVERALL_SEMANTIC, PART_SEMANTIC)
# An asset is known by its type and its id: an image and a video may share a number.
_ASSET = ("asset_type", "asset_id")
_QUERY = (*_ASSET, "query_pos", "role", "weight", "scope", *MATCH_ON, "vector")
from sightline.session import cut_lineage


def _visual(embeddings: DataFrame) -> DataFrame:
    feature = (F.col("kind") == FEATURE_KIND) & (F.col("kind_family") == FEATURE_FAMILY)
    semantic = (F.col("kind") == SEMANTIC_KIND) & (F.col("kind_family") == SEMANTIC_FAMILY)
    wanted = (feature & ~F.col("is_semantic")) | (semantic & F.col("is_semantic"))
    return embeddings.filter((F.col("modality") == "visual") & wanted)


def _sections_in_order() -> list[Column]:
    return [
        F.coalesce(F.col("start_seconds"), F.lit(float("inf"))),
        F.col("section_index"),
        F.col("embedding_id"),
    ]


def _by_semantic(semantic, other) -> Column:
    return F.when(F.col("is_semantic"), F.lit(semantic)).otherwise(F.lit(other))


def with_query_id(queries: DataFrame) -> DataFrame:
    return queries.withColumn(
        "query_id", F.concat_ws(":", "asset_type", F.col("asset_id").cast("string"), F.col("query_pos"))
    )


def asset_queries(
    embeddings: DataFrame,
    hosts: DataFrame,
    *,
    scope: str = "asset",
    include_sections: bool = True,
) -> DataFrame:
    """Weighted query vectors of each host in ``hosts`` (host_type, host_id):
    its latest overall feature and semantic vectors, and for videos up to four
    evenly spaced section vectors of each kind.
    """
    mine = _visual(embeddings).join(hosts, ["host_type", "host_id"], "left_semi")
    key = ["host_type", "host_id", "is_semantic"]
    overall = first_by(
        mine.filter(F.col("section_index") == 0),
        key,
        [-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("embedding_id")],
    ).select(
        F.col("host_type").alias("asset_type"),
        F.col("host_id").alias("asset_id"),
        _by_semantic(1, 0).cast("bigint").alias("query_pos"),
        _by_semantic(OVERALL_SEMANTIC, OVERALL_VISUAL).alias("role"),
        _by_semantic(SEARCH.weight_overall_semantic, SEARCH.weight_overall_visual).alias("weight"),
        F.lit(scope).alias("scope"),
        *MATCH_ON,
        "vector",
    )
    if not include_sections:
        return overall
    sections = mine.filter((F.col("host_type") == "video") & (F.col("section_index") > 0))
    bucket = F.coalesce(time_bucket("start_seconds"), F.lit(1 << 40))
    parts = representatives(sections, key, _sections_in_order(), SEARCH.part_queries, bucket)
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*_sections_in_order()))
    parts = parts.withColumn("_turn", turn).select(
        F.col("host_type").alias("asset_type"),
        F.col("host_id").alias("asset_id"),
        (_by_semantic(2 + SEARCH.part_queries, 2) + F.col("_turn") - 1)
        .cast("bigint")
        .alias("query_pos"),
        _by_semantic(PART_SEMANTIC, PART_VISUAL).alias("role"),
        _by_semantic(SEARCH.weight_part_semantic, SEARCH.weight_part_visual).alias("weight"),
        F.lit("section").alias("scope"),
        *MATCH_ON,
        "vector",
    )
    return overall.unionByName(parts)


def _section_vectors(sections: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One vector per (keys, kind): the weighted mean of the sections its
    intervals cover, or the section nearest the first interval's middle.
    """
    keys, kind = list(keys), [*MATCH_ON]
    weights = interval_weights(
        sections.join(intervals.select(*keys).distinct(), "asset_id"),
        intervals,
        keys,
        "embedding_id",
    )
    covered = sections.join(weights, ["asset_id", "embedding_id"])
    mean = centroid(
        covered,
        [*keys, *kind],
        weight=F.col("weight"),
        first=F.struct(*_sections_in_order()),
        normalized=False,
    ).select(*keys, *kind, "vector")

    start = F.greatest(F.lit(0.0), F.col("start_seconds"))
    end = F.greatest(start, F.coalesce(F.col("end_seconds"), start))
    first = intervals.groupBy(*keys).agg(
        F.min_by(F.when(end > start, (start + end) / 2).otherwise(start), F.col("start_seconds")).alias(
            "_middle"
        )
    )
    s_start = F.coalesce(F.col("start_seconds"), F.lit(0.0))
    s_end = F.coalesce(F.col("end_seconds"), s_start)
    away = (
        F.when(F.col("_middle").between(s_start, s_end), F.lit(0.0))
        .when(F.col("_middle") < s_start, s_start - F.col("_middle"))
        .otherwise(F.col("_middle") - s_end)
    )
    missed = sections.join(first, "asset_id").join(mean, [*keys, *kind], "left_anti")
    closest = first_by(
        missed, [*keys, *kind], [away, F.col("section_index"), F.col("embedding_id")]
    ).select(*keys, *kind, "vector")
    return mean.unionByName(closest)


def segment_queries(
    embeddings: DataFrame,
    intervals: DataFrame,
    interval_limit: int | None = SEARCH.interval_limit,
    part_limit: int = SEARCH.part_queries,
) -> DataFrame:
    """Query vectors for time ranges of videos (asset_id, start_seconds,
    end_seconds): one over all ranges per kind, and where there are several
    ranges, one per evenly spaced range. ``interval_limit`` ranges of an asset
    count, evenly spaced (``None``: all); ``part_limit`` get a query.
    """
    sections = (
        _visual(embeddings)
        .filter((F.col("host_type") == "video") & (F.col("section_index") > 0))
        .withColumn("asset_id", F.col("host_id"))
    )
    # Six branches follow: merged once, and small from here on.
    merged = cut_lineage(merge_intervals(intervals, ["asset_id"], interval_limit))
    counts = merged.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = merged.withColumn("part", F.lit(0))
    few = representatives(
        merged, ["asset_id"], ["start_seconds"], part_limit, time_bucket("start_seconds"),
        hot=None if interval_limit is None else False,
    )
    turn = F.row_number().over(Window.partitionBy("asset_id").orderBy("start_seconds"))
    parts = few.withColumn("part", turn).join(
        counts.filter(F.col("_n") > 1).select("asset_id"), "asset_id", "left_semi"
    )
    every = whole.unionByName(parts)
    vectors = _section_vectors(sections, every, ["asset_id", "part"])
    is_part = F.col("part") > 0
    return vectors.select(
        F.lit("video").alias("asset_type"),
        "asset_id",
        (F.col("part") * 2 + _by_semantic(1, 0)).cast("bigint").alias("query_pos"),
        _by_semantic(PART_SEMANTIC, PART_VISUAL).alias("role"),
        F.when(is_part, _by_semantic(SEARCH.weight_part_semantic, SEARCH.weight_part_visual))
        .otherwise(_by_semantic(SEARCH.weight_overall_semantic, SEARCH.weight_overall_visual))
        .alias("weight"),
        F.lit("section").alias("scope"),
        *MATCH_ON,
        "vector",
    )


def _in_scope() -> Column:
    return (
        F.when(F.col("scope") == "asset", F.col("section_index") == 0)
        .when(F.col("scope") == "section", F.col("section_index") > 0)
        .otherwise(F.lit(True))
    )


def similar_matches(
    queries: DataFrame,
    embeddings: DataFrame,
    *,
    host_type: str = "video",
    exclude_self: bool = True,
    k: int = SEARCH.knn_limit,
) -> DataFrame:
    """Best match per (query, host). The neighbour limit applies first; own
    host and wrong sections are dropped after it. A host of another type is
    never the own one, whatever its id.
    """
    asked = with_query_id(queries.filter(F.col("weight") > 0))
    found = nearest(
        asked,
        embeddings.filter(F.col("host_type") == host_type),
        k,
        match_on=MATCH_ON,
        keep=["host_id", "section_index", "start_seconds", "end_seconds", "kind"],
    ).drop("rank")
    joined = found.join(asked.select("query_id", *_ASSET, "query_pos", "role", "weight", "scope"), "query_id")
    kept = joined.filter(_in_scope())
    if exclude_self:
        kept = kept.filter((F.col("host_id") != F.col("asset_id")) | (F.col("asset_type") != F.lit(host_type)))
    return best_per_host(kept)


def blend_visual(matches: DataFrame) -> DataFrame:
    """One row per (asset, host): weighted mean similarity over the queries
    that hit, a bonus for several roles, and the match and role of the
    strongest weighted similarity (earlier query on a tie).
    """
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))
    weighted = similarity * F.col("weight")
    best = F.struct("embedding_id", "kind", "section_index", "start_seconds", "end_seconds", "role")
    grouped = matches.groupBy(*_ASSET, "host_id").agg(
        F.sum(weighted).alias("_score"),
        F.sum("weight").alias("_weight"),
        F.size(F.collect_set("role")).alias("role_count"),
        F.min_by(best, F.struct(-weighted, F.col("query_pos"))).alias("_best"),
    )
    mean = F.when(F.col("_weight") > 0, F.col("_score") / F.col("_weight")).otherwise(F.lit(0.0))
    bonus = F.least(
        F.lit(SEARCH.role_bonus_cap),
        F.greatest(F.lit(0), F.col("role_count") - 1) * SEARCH.role_bonus,
    )
    distance = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - mean - bonus))
    return grouped.select(
        *_ASSET,
        "host_id",
        F.round(distance, 9).alias("distance"),
        F.col("role_count").cast("bigint").alias("role_count"),
        F.col("_best.*"),
    )


def _compared(df: DataFrame, columns: Sequence[str], *also: str) -> DataFrame:
    """``columns``, the vector, and what must be equal for two vectors to be compared."""
    vector = F.col("vector").cast("array<float>").alias("_vector")
    return df.filter(F.size("vector") > 0).select(*columns, space_of(df, [*MATCH_ON, *also], "vector").alias("_space"), vector)


def _typed(names: Sequence[str], *sources: DataFrame) -> str:
    known = {"distance": "double", "role_count": "bigint", "position": "int"}
    for df in sources:
        known |= {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{n}` {known[n]}" for n in names)


def similar_hosts(
    queries: DataFrame,
    embeddings: DataFrame,
    *,
    host_type: str = "video",
    exclude_self: bool = True,
    k: int = SEARCH.knn_limit,
    most: int | None = None,
) -> DataFrame:
    """The rows of ``blend_visual(similar_matches(...))``, blended where an asset's queries meet the corpus, so that no
    match leaves a task. ``most``: only so many of each asset and role, the nearest by distance and host.
    """
    asked = _compared(queries.filter(F.col("weight") > 0), [*_ASSET, "query_pos", "role", "weight", "scope"])
    found = ["embedding_id", "kind", "section_index", "start_seconds", "end_seconds"]
    searched = _compared(embeddings.filter(F.col("host_type") == host_type), ["host_id", *found])
    names = [*_ASSET, "host_id", "distance", "role_count", *found, "role"]
    options = {"host_type": host_type if exclude_self else None, "bonus": (SEARCH.role_bonus, SEARCH.role_bonus_cap), "most": most}
    return walk(
        asked, searched, F.struct(*_ASSET), ["embedding_id"], lambda left: BlendedHosts(left, k, names, **options),
        _typed(names, asked, searched), asked.count(),
    )


def diversify(blended: DataFrame, limit: int = SEARCH.maximum_results) -> DataFrame:
    """``position`` in the mixed order: the two nearest, then the roles taking
    turns. Closed form of the turn-taking: order by turn within the role.
    """
    by_distance = Window.partitionBy(*_ASSET).orderBy("distance", "host_id")
    within = Window.partitionBy(*_ASSET, "_top", "role").orderBy("distance", "host_id")
    turns = F.element_at(
        F.create_map(*[F.lit(x) for i, role in enumerate(ROLE_TURNS) for x in (role, i)]), F.col("role")
    )
    ranked = (
        blended.withColumn("_rank", F.row_number().over(by_distance))
        .withColumn("_top", F.col("_rank") <= 2)
        .withColumn("_turn", F.row_number().over(within))
    )
    order = [
        F.when(F.col("_top"), F.col("_rank")).otherwise(F.lit(1 << 30)),
        F.col("_turn"),
        turns,
    ]
    placed = top_k(ranked, _ASSET, order, limit, rank="position")
    return placed.drop("_rank", "_top", "_turn")


def audio_queries(embeddings: DataFrame, hosts: DataFrame) -> DataFrame:
    """The asset vector of each video and up to four evenly spaced windows,
    voiced ones where there are any.
    """
    mine = embeddings.filter(
        (F.col("kind") == AUDIO_KIND)
        & (F.col("kind_family") == AUDIO_FAMILY)
        & (F.col("modality") == "audio")
        & (F.col("host_type") == "video")
    ).join(hosts.filter(F.col("host_type") == "video"), ["host_type", "host_id"], "left_semi")
    order = [
        F.col("section_index"),
        F.coalesce(F.col("start_seconds"), F.lit(float("inf"))),
        F.col("embedding_id"),
    ]
    asset = first_by(mine.filter(F.col("section_index") == 0), ["host_id"], order)
    windows = mine.filter(F.col("section_index") > 0).withColumn(
        "_voiced", F.coalesce(F.col("is_voice"), F.lit(False))
    )
    voiced = windows.groupBy("host_id").agg(F.max("_voiced").alias("_any"))
    pool = windows.join(voiced, "host_id").filter(F.col("_voiced") | ~F.col("_any"))
    bucket = F.floor(F.col("section_index") / 1000)
    parts = representatives(pool, ["host_id"], order, SEARCH.part_queries, bucket)
    turn = F.row_number().over(Window.partitionBy("host_id").orderBy(*order))

    def shaped(df: DataFrame, position: Column, role: str, weight: float, scope: str) -> DataFrame:
        return df.select(
            F.lit("video").alias("asset_type"),
            F.col("host_id").alias("asset_id"),
            position.cast("bigint").alias("query_pos"),
            F.lit(role).alias("role"),
            F.lit(weight).alias("weight"),
            F.lit(scope).alias("scope"),
            *MATCH_ON,
            "vector",
        )

    overall = shaped(asset, F.lit(0), "asset", SEARCH.audio_asset_weight, "asset")
    some = shaped(parts, turn, "section", SEARCH.audio_section_weight, "section")
    return overall.unionByName(some)


def audio_similar(
    embeddings: DataFrame, hosts: DataFrame, limit: int = SEARCH.maximum_results
) -> DataFrame:
    """Videos that sound alike: weighted mean of the best distance per query,
    every stored vector considered; ``position`` up to ``limit`` per asset.
    """
    scope = F.when(F.col("section_index") == 0, "asset").otherwise("section")
    asked = _compared(audio_queries(embeddings, hosts), ["asset_id", "query_pos", "weight"], "scope")
    corpus = embeddings.filter(F.col("host_type") == "video").withColumn("scope", scope)
    found = ["host_id", "embedding_id", "section_index", "start_seconds", "end_seconds"]
    searched = _compared(corpus, found, "scope")
    names = ["asset_id", "host_id", "distance", *found[1:], "position"]
    order = ["host_id", "section_index", "start_seconds", "embedding_id"]
    return walk(
        asked, searched, F.col("asset_id"), order, lambda left: MeanHosts(left, limit, names), _typed(names, asked, searched), asked.count()
    )
