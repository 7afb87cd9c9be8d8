"""Who is this: suggestions for unlinked faces from several kinds of evidence.

A suggestion row carries ``face_id, suggestion_key, performer_id,
performer_name, confidence, evidence_count``; ``performer_id`` is null for a
reference identity that matches no known performer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import SUGGEST
from sightline.functions.text import clean, is_blank, key_of
from sightline.operators.knn import nearest
from sightline.operators.ordered import first_by, top_k

MATCH_ON = ("kind_family", "modality", "is_semantic", "source_key")
COLUMNS = (
    "face_id",
    "suggestion_key",
    "performer_id",
    "performer_name",
    "confidence",
    "evidence_count",
)


def _percent(share: Column) -> Column:
    """A share as a percentage with one decimal, half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100, 1)


def _mean_of_best(values: Column, n: int = 3) -> Column:
    best = F.slice(F.sort_array(values, asc=False), 1, n)
    return F.aggregate(best, F.lit(0.0), lambda total, x: total + x) / F.size(best)


def suggestion_sources(faces: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The latest vectors (four at most) of faces neither linked nor merged."""
    open_faces = faces.filter(F.col("performer_id").isNull() & F.col("merged_into").isNull())
    mine = embeddings.filter((F.col("host_type") == "face") & (F.col("modality") == "face")).join(
        open_faces.select(F.col("face_id").alias("host_id")), "host_id", "left_semi"
    )
    order = [F.desc("created_at"), F.col("embedding_id")]
    latest = top_k(mine, ["host_id"], order, SUGGEST.source_vectors, rank="source_rank")
    return latest.select(
        F.col("host_id").alias("face_id"),
        F.col("embedding_id").alias("query_id"),
        "source_rank",
        *MATCH_ON,
        "vector",
    )


def local_suggestions(
    sources: DataFrame, embeddings: DataFrame, faces: DataFrame, performers: DataFrame
) -> DataFrame:
    """Performers of the nearest linked faces.

    Neighbours are limited first (40 per vector); the own face, unlinked,
    ignored and merged ones are dropped after that.
    """
    corpus = embeddings.filter(F.col("host_type") == "face")
    found = nearest(sources, corpus, SUGGEST.local_k, match_on=MATCH_ON, keep=["host_id"])
    linked = faces.filter(
        F.col("performer_id").isNotNull() & F.col("merged_into").isNull() & ~F.col("ignored")
    ).select(F.col("face_id").alias("host_id"), "performer_id")
    matches = (
        found.join(sources.select("query_id", "face_id"), "query_id")
        .filter(F.col("host_id") != F.col("face_id"))
        .join(linked, "host_id")
        .withColumn(
            "_similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance")))
        )
    )
    per_face = matches.groupBy("face_id", "performer_id", "host_id").agg(
        F.max("_similarity").alias("_similarity"), F.count(F.lit(1)).alias("_seen")
    )
    # At most 160 neighbours per face, so the lists below are bounded.
    grouped = per_face.groupBy("face_id", "performer_id").agg(
        F.max("_similarity").alias("_top"),
        _mean_of_best(F.collect_list("_similarity")).alias("_mean"),
        F.count(F.lit(1)).alias("_faces"),
        F.sum("_seen").alias("_seen"),
    )
    share = (
        F.col("_top") * 0.5
        + F.col("_mean") * 0.35
        + F.least(F.lit(1.0), F.col("_faces") / 3.0) * 0.1
        + F.least(F.lit(1.0), F.col("_seen") / 6.0) * 0.05
    )
    name = F.coalesce(
        F.col("performer_name"), F.concat(F.lit("Performer #"), F.col("performer_id"))
    )
    return grouped.join(performers, "performer_id", "left").select(
        "face_id",
        F.concat(F.lit("performer:"), F.col("performer_id")).alias("suggestion_key"),
        "performer_id",
        name.alias("performer_name"),
        _percent(share).alias("confidence"),
        F.least(F.lit(3), F.col("_faces")).cast("bigint").alias("evidence_count"),
    )


def resolve_performers(
    identities: DataFrame, performers: DataFrame, aliases: DataFrame, remote_ids: DataFrame
) -> DataFrame:
    """Known performer of each reference identity, if exactly one fits.

    ``identities`` (pack_id, endpoint, external_id, display_name, aliases).
    A single performer holding the (endpoint, external id) wins; otherwise a
    single one whose name or alias is among the identity's names.
    """
    key = ["pack_id", "external_id"]

    def only(hits: DataFrame) -> DataFrame:
        counted = hits.groupBy(*key).agg(
            F.count_distinct("performer_id").alias("_n"), F.min("performer_id").alias("performer_id")
        )
        return counted.filter(F.col("_n") == 1).drop("_n")

    by_remote = only(
        identities.filter(~is_blank("endpoint")).join(
            remote_ids.withColumnRenamed("remote_id", "external_id"), ["endpoint", "external_id"]
        )
    )
    names = F.concat(F.array("display_name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    wanted = (
        identities.select(*key, F.explode(names).alias("_name"))
        .select(*key, key_of("_name").alias("_name"))
        .filter(F.col("_name") != "")
    )
    known = performers.select("performer_id", F.lower("performer_name").alias("_name")).union(
        aliases.select("performer_id", F.lower("alias").alias("_name"))
    )
    by_name = only(wanted.join(known.distinct(), "_name"))
    return by_remote.unionByName(by_name.join(by_remote, key, "left_anti"))


def open_rejections(log: DataFrame) -> DataFrame:
    """(face, external id) whose latest decision is a rejection.

    ``log`` (face_id, external_id, action, decided_at, decision_id).
    """
    latest = log.groupBy("face_id", key_of("external_id").alias("external_key")).agg(
        F.max_by("action", F.struct("decided_at", "decision_id")).alias("_action")
    )
    return latest.filter(F.col("_action") == "reject").drop("_action")


def reference_suggestions(
    sources: DataFrame,
    reference: DataFrame,
    packs: DataFrame,
    rejections: DataFrame,
    resolved: DataFrame,
    performers: DataFrame,
) -> DataFrame:
    """Nearest reference identities per face, grouped by the person they mean.

    ``reference`` (pack_id, ordinal, external_id, display_name, vector),
    ``packs`` (pack_id, endpoint, dimension). Twelve neighbours per vector and
    pack with positive similarity, rejected ones dropped after the limit.
    Several packs agreeing raise the confidence.
    """
    asked = sources.withColumn("dimension", F.size("vector")).join(packs, "dimension")
    asked = asked.withColumn("_asked", F.concat_ws("|", "query_id", "pack_id"))
    found = nearest(
        asked,
        reference,
        SUGGEST.reference_k,
        query_id="_asked",
        row_id="ordinal",
        match_on=["pack_id"],
        keep=["pack_id", "external_id", "display_name"],
    ).filter(F.col("distance") < 1)
    matches = (
        found.join(asked.select("_asked", "face_id", "endpoint"), "_asked")
        .withColumn("external_key", key_of("external_id"))
        .join(rejections, ["face_id", "external_key"], "left_anti")
        .join(resolved, ["pack_id", "external_id"], "left")
    )
    group_key = F.when(
        F.col("performer_id").isNotNull(), F.concat(F.lit("performer:"), F.col("performer_id"))
    ).otherwise(F.concat(F.lit("ref:"), F.coalesce(F.upper(clean("endpoint")), F.lit("")), F.lit("|"), F.upper("external_id")))
    similarity = 1 - F.col("distance")
    grouped = (
        matches.withColumns({"suggestion_key": group_key, "_similarity": similarity})
        .groupBy("face_id", "suggestion_key")
        .agg(
            F.max("_similarity").alias("_top"),
            _mean_of_best(F.collect_list("_similarity")).alias("_mean"),
            F.count(F.lit(1)).alias("_seen"),
            F.count_distinct("pack_id").alias("_packs"),
            F.max("performer_id").alias("performer_id"),
            F.min_by("display_name", F.struct(-F.col("_similarity"), F.col("pack_id"), F.col("ordinal"))).alias("_name"),
        )
    )
    base = _percent(
        F.col("_top") * 0.65
        + F.col("_mean") * 0.3
        + F.least(F.lit(1.0), F.col("_seen") / 4.0) * 0.05
    )
    bonus = F.when(F.col("_packs") > 1, F.least(F.lit(12.0), (F.col("_packs") - 1) * 8.0)).otherwise(0.0)
    return grouped.join(performers, "performer_id", "left").select(
        "face_id",
        "suggestion_key",
        "performer_id",
        F.coalesce("performer_name", "_name").alias("performer_name"),
        F.bround(F.least(F.lit(100.0), base + bonus), 1).alias("confidence"),
        F.lit(0).cast("bigint").alias("evidence_count"),
    )


def damp_conflicts(suggestions: DataFrame) -> DataFrame:
    """Where several suggestions of a face reach 55, scale those by 0.85 and
    give them a common ``conflict_id``.
    """
    strong = F.col("confidence") >= SUGGEST.conflict_confidence
    counts = suggestions.groupBy("face_id").agg(F.count_if(strong).alias("_strong"))
    clash = strong & (F.col("_strong") > 1)
    return suggestions.join(counts, "face_id").select(
        *[c for c in suggestions.columns if c != "confidence"],
        F.when(clash, F.bround(F.col("confidence") * SUGGEST.conflict_damping, 1))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        F.when(clash, F.md5(F.col("face_id").cast("string"))).alias("conflict_id"),
    )


def _order() -> list[Column]:
    return [F.desc("confidence"), F.desc("evidence_count"), F.col("performer_name"), F.col("suggestion_key")]


def best_suggestions(suggestions: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``limit`` suggestions per face with ``rank``."""
    return top_k(suggestions, ["face_id"], order or _order(), limit)


def rank_suggestions(*parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Union of suggestion sets, the best row per key, ranked per face."""
    every = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        every = every.unionByName(part.select(*COLUMNS))
    best = first_by(
        every,
        ["face_id", "suggestion_key"],
        [-F.col("confidence"), -F.col("evidence_count"), F.col("performer_name")],
    )
    if limit is not None:
        return best_suggestions(best, limit)
    window = Window.partitionBy("face_id").orderBy(*_order())
    return best.withColumn("rank", F.row_number().over(window))


def face_hosts(appearances: DataFrame, detections: DataFrame) -> DataFrame:
    """Hosts of each face: appearances, or per host type detections where a
    face has no appearance of that type.
    """
    seen = appearances.select("face_id", "host_type", "host_id").distinct()
    covered = seen.select("face_id", "host_type").distinct()
    rest = detections.select("face_id", "host_type", "host_id").distinct()
    return seen.unionByName(rest.join(covered, ["face_id", "host_type"], "left_anti"))


def linked_hosts(
    appearances: DataFrame, detections: DataFrame, host_performers: DataFrame, faces: DataFrame
) -> DataFrame:
    """Each (face, host, performer linked to the host) with the number of
    performers on the host and of hosts of the face.
    """
    hosts = face_hosts(appearances, detections).join(faces.select("face_id"), "face_id", "left_semi")
    totals = hosts.groupBy("face_id").agg(F.count(F.lit(1)).alias("total_hosts"))
    links = host_performers.select("host_type", "host_id", "performer_id").distinct()
    sizes = links.groupBy("host_type", "host_id").agg(F.count(F.lit(1)).alias("host_performers"))
    return (
        hosts.join(links, ["host_type", "host_id"])
        .join(sizes, ["host_type", "host_id"])
        .join(totals, "face_id")
    )


def host_evidence(linked: DataFrame) -> DataFrame:
    """Per face and performer: matched hosts, hosts where the performer is
    alone, total hosts, mean performers on matched hosts, and whether every
    host points to this performer only.
    """
    per = linked.groupBy("face_id", "performer_id").agg(
        F.count(F.lit(1)).alias("matched_hosts"),
        F.count_if(F.col("host_performers") == 1).alias("sole_hosts"),
        F.avg("host_performers").alias("mean_performers"),
        F.max("total_hosts").alias("total_hosts"),
    )
    rivals = per.groupBy("face_id").agg(F.count(F.lit(1)).alias("_rivals"))
    only = (F.col("_rivals") == 1) & (F.col("matched_hosts") == F.col("total_hosts"))
    return per.join(rivals, "face_id").withColumn("exclusive", only).drop("_rivals")


def name_evidence(linked: DataFrame, performers: DataFrame) -> DataFrame:
    """Per face and performer name: distinct matched, sole and total hosts."""
    named = linked.join(performers, "performer_id").withColumn("name_key", key_of("performer_name"))
    per_host = named.filter(F.col("name_key") != "").groupBy(
        "face_id", "name_key", "host_type", "host_id"
    ).agg(F.max("host_performers").alias("_size"), F.max("total_hosts").alias("total_hosts"))
    return per_host.groupBy("face_id", "name_key").agg(
        F.count(F.lit(1)).alias("matched_hosts"),
        F.count_if(F.col("_size") == 1).alias("sole_hosts"),
        F.max("total_hosts").alias("total_hosts"),
    )


def boost(suggestions: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Raise suggestions whose performer is already linked to the face's hosts;
    evidence is looked up by performer, else by name.
    """
    wide = ["matched_hosts", "sole_hosts", "total_hosts"]
    by_id = evidence.select("face_id", "performer_id", *wide, "exclusive")
    by_name = names.select("face_id", "name_key", *[F.col(c).alias(f"_n_{c}") for c in wide])
    joined = (
        suggestions.withColumn("name_key", key_of("performer_name"))
        .join(by_id, ["face_id", "performer_id"], "left")
        .join(by_name, ["face_id", "name_key"], "left")
    )
    matched, sole, total = (F.coalesce(F.col(c), F.col(f"_n_{c}")) for c in wide)
    alone = F.coalesce(F.col("exclusive"), F.lit(False))
    raised = (
        F.least(F.lit(6.0), matched * 2.0)
        + F.least(F.lit(4.0), sole * 2.0)
        + F.when(matched == total, 4.0).otherwise(0.0)
        + F.when((total > 1) & alone, 3.0).otherwise(0.0)
    )
    confidence = F.when(matched.isNull(), F.col("confidence")).otherwise(
        F.least(F.lit(100.0), F.col("confidence") + raised)
    )
    return joined.withColumn("confidence", confidence).select(*suggestions.columns)


def host_only(evidence: DataFrame, suggestions: DataFrame, performers: DataFrame) -> DataFrame:
    """Suggestions from host links alone, for performers not yet suggested."""
    missing = evidence.join(
        suggestions.select("face_id", "performer_id").filter(F.col("performer_id").isNotNull()).distinct(),
        ["face_id", "performer_id"],
        "left_anti",
    )
    mean = F.col("mean_performers")
    base = F.when(mean <= 1.25, 40.0).when(mean <= 2.25, 30.0).when(mean >= 4.0, 20.0).otherwise(25.0)
    matched, total = F.col("matched_hosts"), F.col("total_hosts")
    wide = F.when(
        total > 1,
        matched / total * 8.0 + F.col("sole_hosts") / matched * 6.0 + F.when(F.col("exclusive"), 4.0).otherwise(0.0),
    ).otherwise(0.0)
    repeated = F.least(F.lit(20.0), F.greatest(F.lit(0), matched - 1) * 6.0)
    return missing.join(performers, "performer_id").select(
        "face_id",
        F.concat(F.lit("performer:"), F.col("performer_id")).alias("suggestion_key"),
        "performer_id",
        "performer_name",
        F.bround(F.least(F.lit(72.0), base + repeated + wide), 1).alias("confidence"),
        F.lit(0).cast("bigint").alias("evidence_count"),
    )
