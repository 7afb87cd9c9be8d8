"""Ranking, cutting, sorting and paging of nearest-neighbour matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import SEARCH
from sightline.functions.shuffle import seeded_key
from sightline.functions.text import is_blank, key_of
from sightline.operators.centroids import centroid
from sightline.operators.ordered import first_by, top_k

_FAR = float("inf")

# Sort names and the host column they read. Fixed values of the search API.
VIDEO_SORTS = {
    "title": "title",
    "date": "date",
    "rating": "rating",
    "play_count": "play_count",
    "o_counter": "like_count",
    "like_counter": "like_count",
    "last_o_at": "last_like_at",
    "last_like_at": "last_like_at",
    "organized": "organized",
    "last_played_at": "last_played_at",
    "play_duration": "play_duration",
    "resume_time": "resume_time",
    "duration": "duration",
    "file_size": "file_size",
    "file_mod_time": "file_mod_time",
    "file_count": "file_count",
    "path": "path",
    "resolution": "height",
    "framerate": "frame_rate",
    "bitrate": "bit_rate",
    "phash": "phash",
    "perceptual_similarity": "phash",
    "tag_count": "tag_count",
    "performer_count": "performer_count",
    "performer_age": "performer_age",
    "studio": "studio",
    "code": "code",
    "studio_code": "code",
    "created_at": "created_at",
}
IMAGE_SORTS = {
    "title": "display_title",
    "date": "date",
    "rating": "rating",
    "o_counter": "like_count",
    "like_counter": "like_count",
    "file_mod_time": "file_mod_time",
    "file_size": "file_size",
    "path": "path",
    "tag_count": "tag_count",
    "performer_count": "performer_count",
    "created_at": "created_at",
}
# Columns with a smallest and a largest value; the direction picks one.
_TWO_SIDED = ("path", "phash", "performer_age", "display_title")


def best_per_host(matches: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The nearest match of each host: distance, section, start, id."""
    order = [
        F.col("distance"),
        F.col("section_index"),
        F.coalesce(F.col("start_seconds"), F.lit(_FAR)),
        F.col("embedding_id"),
    ]
    return first_by(matches, [*keys, "host_id"], order)


def candidate_cutoff(
    matches: DataFrame,
    keys: Sequence[str] = ("query_id",),
    *,
    minimum: int = SEARCH.minimum_results,
    window: float = SEARCH.distance_window,
    maximum: int = SEARCH.maximum_results,
) -> DataFrame:
    """Per query the first ``minimum`` hosts, then those within ``window`` of
    the best, at most ``maximum``; adds ``visual_rank``.
    """
    ranked = top_k(
        matches.drop("rank"),
        keys,
        [F.col("distance"), F.col("host_id")],
        maximum,
        rank="visual_rank",
    )
    best = F.min("distance").over(Window.partitionBy(*keys))
    near = F.col("distance") <= F.round(F.col("_best") + window, 9)
    return (
        ranked.withColumn("_best", best)
        .filter((F.col("visual_rank") <= minimum) | near)
        .drop("_best")
    )


def allow(matches: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Only matches of allowed hosts. No list means no restriction; an empty
    list means no result.
    """
    if allowed is None:
        return matches
    return matches.join(allowed.select("host_id").distinct(), "host_id", "left_semi")


def has_embeddings(hosts: DataFrame, embeddings: DataFrame, modality: str, source_key: str) -> DataFrame:
    """Hosts with at least one vector of a modality and source."""
    stored = embeddings.filter(
        (F.col("modality") == modality) & (F.col("source_key") == source_key)
    )
    return hosts.join(stored, ["host_type", "host_id"], "left_semi")


def dimension_audit(embeddings: DataFrame) -> DataFrame:
    """Stored vectors by kind, family, modality, semantic flag and dimension."""
    return embeddings.groupBy(
        "kind", "kind_family", "modality", "is_semantic", F.size("vector").alias("dimension")
    ).agg(F.count(F.lit(1)).alias("row_count"))


def derive_sort_keys(
    hosts: DataFrame, host_performers: DataFrame, files: DataFrame, likes: DataFrame
) -> DataFrame:
    """Sort columns that need other tables, smallest and largest where the
    direction matters: performer age at release, perceptual hash, last like,
    display title and path.
    """
    month_day = F.lit(100) * F.month("date") + F.dayofmonth("date")
    born = F.lit(100) * F.month("birthdate") + F.dayofmonth("birthdate")
    age = F.year("date") - F.year("birthdate") - F.when(month_day < born, 1).otherwise(0)
    ages = (
        hosts.select("host_id", "date")
        .join(host_performers.filter(F.col("birthdate").isNotNull()), "host_id")
        .groupBy("host_id")
        .agg(F.min(age).alias("performer_age_min"), F.max(age).alias("performer_age_max"))
    )
    hashes = F.when(~is_blank("phash"), F.col("phash"))
    by_file = files.groupBy("host_id").agg(
        F.min(hashes).alias("phash_min"),
        F.max(hashes).alias("phash_max"),
        F.min("path").alias("path_min"),
        F.max("path").alias("path_max"),
        F.min("basename").alias("_first_name"),
        F.max("basename").alias("_last_name"),
    )
    liked = likes.groupBy("host_id").agg(F.max("occurred_at").alias("last_like_at"))
    titled = F.when(~is_blank("title"), F.col("title"))
    return (
        hosts.join(ages, "host_id", "left")
        .join(by_file, "host_id", "left")
        .join(liked, "host_id", "left")
        .withColumns(
            {
                "display_title_min": F.coalesce(titled, F.col("_first_name")),
                "display_title_max": F.coalesce(titled, F.col("_last_name")),
            }
        )
        .drop("_first_name", "_last_name")
    )


def sort_order(
    sort: str | None, descending: bool, host_type: str = "video", seed: int | None = None
) -> list[Column]:
    """Ordering for a sort name: missing values last in both directions, then
    visual rank, then host. Without a name (or ``visual_match``) the nearest
    come first; ``random`` shuffles by seed; unknown names mean last update.
    """
    name = (sort or "").strip().lower()
    if name in ("", "visual_match"):
        nearest_first = descending or not name
        distance = F.col("distance").asc() if nearest_first else F.col("distance").desc()
        return [distance, F.col("host_id").asc()]
    if name == "random":
        keys = [seeded_key("host_id", seed), F.col("host_id")]
        return [k.desc() if descending else k.asc() for k in keys]
    column = (VIDEO_SORTS if host_type == "video" else IMAGE_SORTS).get(name, "updated_at")
    if column in _TWO_SIDED:
        column += "_max" if descending else "_min"
    value = F.col(column)
    return [
        value.desc_nulls_last() if descending else value.asc_nulls_last(),
        F.col("visual_rank").asc(),
        F.col("host_id").asc(),
    ]


def sort_matches(
    matches: DataFrame,
    hosts: DataFrame,
    sort: str | None,
    descending: bool,
    *,
    host_type: str = "video",
    seed: int | None = None,
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Known hosts of cut matches with ``sort_rank`` (at most a few hundred
    rows per query after the cutoff)."""
    order = sort_order(sort, descending, host_type, seed)
    window = Window.partitionBy(*keys).orderBy(*order)
    return matches.join(hosts, "host_id").withColumn("sort_rank", F.row_number().over(window))


def page(
    ranked: DataFrame,
    number: int,
    size: int | None,
    *,
    keys: Sequence[str] = ("query_id",),
    rank: str = "sort_rank",
    default: int = SEARCH.search_page_size,
    largest: int = SEARCH.search_page_max,
) -> DataFrame:
    """One page of a ranked result with ``total_count`` per query."""
    size = min(max(default if size is None else size, 1), largest)
    first = (max(1, number) - 1) * size
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ranked.withColumn("total_count", total).filter(
        (F.col(rank) > first) & (F.col(rank) <= first + size)
    )


def similar_page(ranked: DataFrame, number: int, size: int | None, **options) -> DataFrame:
    """Page of a "more like this" result: 12 by default, 48 at most."""
    asked = SEARCH.similar_page_size if not size or size <= 0 else size
    return page(
        ranked, number, asked, default=SEARCH.similar_page_size, largest=SEARCH.similar_page_max, **options
    )


def text_score(text: str, fields: Sequence[str]) -> Column:
    """0 exact, 1 prefix, 2 contains, plus 4 per field position; 100 if none."""
    query = text.strip().lower()
    scores = []
    for position, name in enumerate(fields):
        value = F.coalesce(key_of(name), F.lit(""))
        scores.append(
            F.when(value == query, 4 * position)
            .when(value.startswith(query), 4 * position + 1)
            .when(value.contains(query), 4 * position + 2)
            .otherwise(100)
        )
    return F.least(*scores) if len(scores) > 1 else scores[0]


def text_seeds(
    df: DataFrame, text: str, fields: Sequence[str], *, limit: int = SEARCH.seed_limit
) -> DataFrame:
    """Rows naming the text, best ``limit`` by score, latest update, type, id;
    adds ``score`` and ``seed_rank`` (from 0).
    """
    if not text.strip():
        raise ValueError("a search text is required")
    scored = df.withColumn("score", text_score(text, fields)).filter(F.col("score") < 100)
    order = [F.col("score"), F.desc("updated_at"), F.col("host_type"), F.col("host_id")]
    best = top_k(scored.withColumn("_all", F.lit(0)), ["_all"], order, limit, rank="_rank")
    return best.withColumn("seed_rank", (F.col("_rank") - 1).cast("bigint")).drop("_all", "_rank")


def seed_centroid(seeds: DataFrame, embeddings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Query vector from seeds: their asset vectors of the commonest dimension,
    weighted 1 / (rank + 1) and normalised.
    """
    keys = list(keys)
    ranked = seeds.groupBy(*keys, "host_type", "host_id").agg(F.min("seed_rank").alias("_rank"))
    vectors = embeddings.filter(F.col("section_index") == 0).join(ranked, ["host_type", "host_id"])
    grouped = vectors if keys else vectors.withColumn("_all", F.lit(0))
    made = centroid(
        grouped,
        keys or ["_all"],
        weight=F.lit(1.0) / (F.col("_rank") + 1),
        prefer="majority",
        norm_rule="required",
    )
    return made.drop("_all")


def enrich(
    matches: DataFrame,
    hosts: DataFrame,
    tags: DataFrame,
    performers: DataFrame,
    groups: DataFrame,
) -> DataFrame:
    """Page rows with their host's attributes and its tags, performers and
    groups as ordered arrays. Only links of hosts on the page are gathered.
    """
    shown = matches.select("host_id").distinct()

    def gathered(links: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        kept = links.join(shown, "host_id", "left_semi")
        items = F.array_sort(F.collect_set(F.struct(*columns)))
        return kept.groupBy("host_id").agg(items.alias(name))

    result = matches.join(hosts, "host_id")
    result = result.join(gathered(tags, ["tag_id", "tag"], "tags"), "host_id", "left")
    result = result.join(
        gathered(performers, ["performer_id", "performer_name"], "performers"), "host_id", "left"
    )
    return result.join(
        gathered(groups, ["order_index", "group_id", "group_name"], "groups"), "host_id", "left"
    )
