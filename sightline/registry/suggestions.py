"""Suggestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import fixtures as fx
from sightline.fixtures import with_views
from sightline.operators import suggest
from sightline.plans.suggestions import suggest_faces
from sightline.registry.base import query

_SOURCES_SQL = """
eligible AS (SELECT face_id FROM faces WHERE performer_id IS NULL AND merged_into IS NULL),
sources AS (SELECT host_id AS face_id, embedding_id AS query_id, vector,
     row_number() OVER (PARTITION BY host_id ORDER BY created_at DESC, embedding_id) AS source_rank
   FROM face_embeddings WHERE host_id IN (SELECT face_id FROM eligible) QUALIFY source_rank <= 4)
"""


@query(
    "suggestion_sources",
    with_views(
        "faces", "face_embeddings", body="WITH " + _SOURCES_SQL + "SELECT face_id, query_id, source_rank FROM sources"
    ),
)
def suggestion_sources(spark, folder):
    made = _sources(spark, folder)
    return made.select("face_id", "query_id", F.col("source_rank").cast("bigint").alias("source_rank"))


def _sources(spark, folder):
    return suggest.suggestion_sources(fx.faces(spark, folder), fx.face_embeddings(spark, folder))


_LOCAL_SQL = _SOURCES_SQL + """,
near AS (SELECT s.face_id, s.query_id, e.host_id, round(1 - list_cosine_similarity(s.vector::DOUBLE[], e.vector::DOUBLE[]), 9) AS d,
    row_number() OVER (PARTITION BY s.query_id ORDER BY round(1 - list_cosine_similarity(s.vector::DOUBLE[], e.vector::DOUBLE[]), 9), e.embedding_id) AS r
  FROM sources s, face_embeddings e QUALIFY r <= 40),
m AS (SELECT n.face_id, f.performer_id, n.host_id, greatest(0.0, least(1.0, 1 - d)) AS sim FROM near n JOIN faces f ON f.face_id = n.host_id
   WHERE n.host_id <> n.face_id AND f.performer_id IS NOT NULL AND f.merged_into IS NULL AND NOT f.ignored),
pf AS (SELECT face_id, performer_id, host_id, max(sim) AS sim, count(*) AS seen FROM m GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY face_id, performer_id ORDER BY sim DESC) AS i FROM pf),
pg AS (SELECT face_id, performer_id, max(sim) AS top, avg(sim) FILTER (i <= 3) AS mean, count(*) AS faces, sum(seen) AS seen FROM pr GROUP BY ALL),
local AS (SELECT face_id, 'performer:' || performer_id AS suggestion_key, performer_id, coalesce(performer_name, 'Performer #' || performer_id) AS performer_name,
    round_even(100 * greatest(0.0, least(1.0, top * 0.5 + mean * 0.35 + least(1.0, faces / 3.0) * 0.1 + least(1.0, seen / 6.0) * 0.05)), 1)::DOUBLE AS confidence,
    least(3, faces)::BIGINT AS evidence_count
  FROM pg LEFT JOIN performers USING (performer_id))
"""
_LOCAL_VIEWS = ("faces", "face_embeddings", "performers")


def _local(spark, folder):
    return suggest.local_suggestions(
        _sources(spark, folder),
        fx.face_embeddings(spark, folder),
        fx.faces(spark, folder),
        fx.performers(spark, folder),
    )


@query("local_suggestions", with_views(*_LOCAL_VIEWS, body="WITH " + _LOCAL_SQL + "SELECT * FROM local"))
def local_suggestions(spark, folder):
    return _local(spark, folder)


# Two reference sets over the same people: label means and, as a second
# opinion, the first vector of each label.
_REFERENCE_SQL = """
reference AS (SELECT 'pack-a' AS pack_id, ordinal, external_id, display_name, vector FROM reference_identities
   UNION ALL SELECT 'pack-b', label::BIGINT, 'ext-' || label, 'Person ' || label, arg_min(embedding, vec_id) FROM embeddings GROUP BY label),
packs AS (SELECT 'pack-a' AS pack_id, 'https://one.example/graphql' AS endpoint UNION ALL SELECT 'pack-b', 'https://two.example'),
rejected AS (SELECT face_id, external_id FROM (SELECT o_custkey AS face_id, 'EXT-' || (o_orderkey % 10) AS external_id,
     arg_max(o_orderstatus, o_orderdate + to_seconds(o_orderkey)) AS action FROM orders GROUP BY 1, 2) WHERE action = 'F'),
resolved AS (
  WITH remote AS (SELECT pack_id, external_id, min(n_nationkey)::BIGINT AS performer_id FROM reference JOIN packs USING (pack_id)
       JOIN nation ON pack_id = 'pack-b' AND external_id = 'ext-' || (n_nationkey % 20) GROUP BY ALL HAVING count(DISTINCT n_nationkey) = 1),
  named AS (SELECT pack_id, external_id, min(n_nationkey)::BIGINT AS performer_id FROM reference JOIN nation ON lower(display_name) = lower(n_name)
       GROUP BY ALL HAVING count(DISTINCT n_nationkey) = 1)
  SELECT * FROM remote UNION ALL SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM remote r WHERE r.pack_id = n.pack_id AND r.external_id = n.external_id))
"""


def _reference(spark, folder):
    means = fx.reference_identities(spark, folder).select(
        F.lit("pack-a").alias("pack_id"), "ordinal", "external_id", "display_name", "vector"
    )
    first = fx.load(spark, folder, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("vector")
    )
    label = F.col("label").cast("string")
    second = first.select(
        F.lit("pack-b").alias("pack_id"),
        F.col("label").cast("bigint").alias("ordinal"),
        F.concat(F.lit("ext-"), label).alias("external_id"),
        F.concat(F.lit("Person "), label).alias("display_name"),
        "vector",
    )
    return means.unionByName(second)


def _packs(reference):
    endpoint = F.when(F.col("pack_id") == "pack-a", "https://one.example/graphql").otherwise("https://two.example")
    return reference.groupBy("pack_id").agg(F.max(F.size("vector")).alias("dimension")).withColumn("endpoint", endpoint)


def _rejections(spark, folder):
    log = fx.load(spark, folder, "orders").select(
        F.col("o_custkey").alias("face_id"),
        F.concat(F.lit("EXT-"), (F.col("o_orderkey") % 10).cast("string")).alias("external_id"),
        F.when(F.col("o_orderstatus") == "F", "reject").otherwise("clear").alias("action"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("decided_at"),
        F.col("o_orderkey").alias("decision_id"),
    )
    return suggest.open_rejections(log)


def _resolved(spark, folder, reference):
    identities = reference.join(_packs(reference).select("pack_id", "endpoint"), "pack_id").withColumn(
        "aliases", F.array().cast("array<string>")
    )
    nation = fx.load(spark, folder, "nation")
    known = fx.performers(spark, folder)
    remote = nation.select(
        F.col("n_nationkey").cast("bigint").alias("performer_id"),
        F.lit("https://two.example").alias("endpoint"),
        F.concat(F.lit("ext-"), (F.col("n_nationkey") % 20).cast("string")).alias("remote_id"),
    )
    none = known.select("performer_id", F.col("performer_name").alias("alias"))
    return suggest.resolve_performers(identities, known, none, remote)


@query(
    "open_rejections",
    with_views(
        "reference_identities",
        body="WITH " + _REFERENCE_SQL + "SELECT face_id, lower(external_id) AS external_key FROM rejected",
    ),
)
def open_rejections(spark, folder):
    return _rejections(spark, folder)


@query(
    "resolve_performers",
    with_views("reference_identities", body="WITH " + _REFERENCE_SQL + "SELECT pack_id, external_id, performer_id FROM resolved"),
)
def resolve_performers(spark, folder):
    return _resolved(spark, folder, _reference(spark, folder))


_MATCHED_SQL = """
rnear AS (SELECT s.face_id, s.query_id, e.pack_id, e.ordinal, e.external_id, e.display_name,
    round(1 - list_cosine_similarity(s.vector::DOUBLE[], e.vector::DOUBLE[]), 9) AS d,
    row_number() OVER (PARTITION BY s.query_id, e.pack_id ORDER BY round(1 - list_cosine_similarity(s.vector::DOUBLE[], e.vector::DOUBLE[]), 9), e.ordinal) AS r
  FROM sources s, reference e QUALIFY r <= 12),
rm AS (SELECT n.*, 1 - d AS sim, performer_id, endpoint FROM rnear n JOIN packs USING (pack_id) LEFT JOIN resolved USING (pack_id, external_id)
   WHERE d < 1 AND NOT EXISTS (SELECT 1 FROM rejected x WHERE x.face_id = n.face_id AND lower(x.external_id) = lower(n.external_id))),
rk AS (SELECT *, CASE WHEN performer_id IS NOT NULL THEN 'performer:' || performer_id ELSE 'ref:' || upper(endpoint) || '|' || upper(external_id) END AS suggestion_key FROM rm),
rr AS (SELECT *, row_number() OVER (PARTITION BY face_id, suggestion_key ORDER BY sim DESC, pack_id, ordinal) AS i FROM rk),
rg AS (SELECT face_id, suggestion_key, max(sim) AS top, avg(sim) FILTER (i <= 3) AS mean, count(*) AS seen, count(DISTINCT pack_id) AS npacks,
    max(performer_id) AS performer_id, max(display_name) FILTER (i = 1) AS dn FROM rr GROUP BY ALL),
matched AS (SELECT face_id, suggestion_key, performer_id, coalesce(performer_name, dn) AS performer_name,
   round_even(least(100.0, round_even(100 * greatest(0.0, least(1.0, top * 0.65 + mean * 0.3 + least(1.0, seen / 4.0) * 0.05)), 1)
     + CASE WHEN npacks > 1 THEN least(12.0, (npacks - 1) * 8.0) ELSE 0 END), 1)::DOUBLE AS confidence, 0::BIGINT AS evidence_count
  FROM rg LEFT JOIN performers USING (performer_id)),
damped AS (SELECT face_id, suggestion_key, performer_id, performer_name, evidence_count,
   CASE WHEN confidence >= 55 AND strong > 1 THEN round_even(confidence * 0.85, 1) ELSE confidence END AS confidence,
   CASE WHEN confidence >= 55 AND strong > 1 THEN md5(face_id::VARCHAR) END AS conflict_id
  FROM (SELECT *, count(*) FILTER (confidence >= 55) OVER (PARTITION BY face_id) AS strong FROM matched))
"""
_REF_VIEWS = ("faces", "face_embeddings", "performers", "reference_identities")
_REF_SQL = "WITH " + _SOURCES_SQL + "," + _REFERENCE_SQL + "," + _MATCHED_SQL


def _matched(spark, folder):
    reference = _reference(spark, folder)
    return suggest.reference_suggestions(
        _sources(spark, folder),
        reference,
        _packs(reference),
        _rejections(spark, folder),
        _resolved(spark, folder, reference),
        fx.performers(spark, folder),
    )


@query("reference_suggestions", with_views(*_REF_VIEWS, body=_REF_SQL + "SELECT * FROM matched"))
def reference_suggestions(spark, folder):
    return _matched(spark, folder)


@query("damp_conflicts", with_views(*_REF_VIEWS, body=_REF_SQL + "SELECT * FROM damped"))
def damp_conflicts(spark, folder):
    return suggest.damp_conflicts(_matched(spark, folder))


_RANK = "row_number() OVER (PARTITION BY face_id ORDER BY confidence DESC, evidence_count DESC, performer_name, suggestion_key) AS rank"
_BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY face_id, suggestion_key
   ORDER BY confidence DESC, evidence_count DESC, performer_name) AS i FROM {source}) WHERE i = 1"""



@query(
    "rank_suggestions",
    with_views(
        *_REF_VIEWS,
        body="WITH " + _LOCAL_SQL + "," + _REFERENCE_SQL + "," + _MATCHED_SQL + f""",
every AS (SELECT * FROM local UNION ALL SELECT face_id, suggestion_key, performer_id, performer_name, confidence, evidence_count FROM damped),
best AS ({_BEST.format(source='every')})
SELECT face_id, suggestion_key, performer_id, performer_name, confidence, evidence_count, {_RANK} FROM best""",
    ),
)
def rank_suggestions(spark, folder):
    made = suggest.rank_suggestions(_local(spark, folder), suggest.damp_conflicts(_matched(spark, folder)))
    return made.withColumn("rank", F.col("rank").cast("bigint"))


_EVIDENCE_SQL = """
el AS (SELECT face_id FROM faces WHERE performer_id IS NULL AND merged_into IS NULL),
seen AS (SELECT DISTINCT face_id, host_type, host_id FROM appearances),
fh AS (SELECT * FROM (SELECT * FROM seen UNION ALL SELECT DISTINCT face_id, host_type, host_id FROM detections d
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.face_id = d.face_id AND s.host_type = d.host_type)) WHERE face_id IN (SELECT face_id FROM el)),
tot AS (SELECT face_id, count(*) AS total_hosts FROM fh GROUP BY 1),
sz AS (SELECT host_type, host_id, count(*) AS n FROM host_performers GROUP BY 1, 2),
ev AS (SELECT face_id, performer_id, count(*) AS matched_hosts, count(*) FILTER (n = 1) AS sole_hosts, avg(n) AS mean_performers, max(total_hosts) AS total_hosts
  FROM fh JOIN host_performers USING (host_type, host_id) JOIN sz USING (host_type, host_id) JOIN tot USING (face_id) GROUP BY 1, 2),
evidence AS (SELECT *, count(*) OVER (PARTITION BY face_id) = 1 AND matched_hosts = total_hosts AS exclusive FROM ev)
"""
_EVIDENCE_VIEWS = ("faces", "appearances", "detections", "host_performers")


def _linked(spark, folder):
    faces = fx.faces(spark, folder)
    eligible = faces.filter(F.col("performer_id").isNull() & F.col("merged_into").isNull())
    return suggest.linked_hosts(
        fx.appearances(spark, folder), fx.detections(spark, folder), fx.host_performers(spark, folder), eligible
    )


@query(
    "host_evidence",
    with_views(
        *_EVIDENCE_VIEWS,
        body="WITH " + _EVIDENCE_SQL + """
SELECT face_id, performer_id, matched_hosts, sole_hosts, total_hosts, exclusive, round(mean_performers, 6) AS mean_performers FROM evidence""",
    ),
)
def host_evidence(spark, folder):
    made = suggest.host_evidence(_linked(spark, folder))
    return made.withColumn("mean_performers", F.round("mean_performers", 6))


_BOOST_SQL = """
boosted AS (SELECT l.face_id, l.suggestion_key, l.performer_id, l.performer_name, l.evidence_count,
   CASE WHEN matched_hosts IS NULL THEN confidence ELSE least(100.0, confidence + least(6.0, matched_hosts * 2.0) + least(4.0, sole_hosts * 2.0)
      + CASE WHEN matched_hosts = total_hosts THEN 4.0 ELSE 0 END + CASE WHEN total_hosts > 1 AND exclusive THEN 3.0 ELSE 0 END) END AS confidence
  FROM local l LEFT JOIN evidence USING (face_id, performer_id)),
added AS (SELECT e.face_id, 'performer:' || performer_id AS suggestion_key, performer_id, performer_name, 0::BIGINT AS evidence_count,
   round_even(least(72.0, CASE WHEN mean_performers <= 1.25 THEN 40 WHEN mean_performers <= 2.25 THEN 30 WHEN mean_performers >= 4 THEN 20 ELSE 25 END
     + least(20.0, (matched_hosts - 1) * 6.0) + CASE WHEN total_hosts > 1 THEN matched_hosts::DOUBLE / total_hosts * 8.0 + sole_hosts::DOUBLE / matched_hosts * 6.0
     + CASE WHEN exclusive THEN 4.0 ELSE 0 END ELSE 0 END)::DOUBLE, 1)::DOUBLE AS confidence
  FROM evidence e JOIN performers USING (performer_id)
  WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.face_id = e.face_id AND l.performer_id = e.performer_id))
"""
_FULL_VIEWS = tuple(dict.fromkeys(_LOCAL_VIEWS + _EVIDENCE_VIEWS))
_FULL_SQL = "WITH " + _LOCAL_SQL + "," + _EVIDENCE_SQL + "," + _BOOST_SQL


@query(
    "boost_suggestions",
    with_views(*_FULL_VIEWS, body=_FULL_SQL + "SELECT face_id, suggestion_key, performer_id, round(confidence, 4) AS confidence FROM boosted"),
)
def boost_suggestions(spark, folder):
    linked = _linked(spark, folder)
    names = suggest.name_evidence(linked, fx.performers(spark, folder))
    made = suggest.boost(_local(spark, folder), suggest.host_evidence(linked), names)
    return made.select("face_id", "suggestion_key", "performer_id", F.round("confidence", 4).alias("confidence"))


@query(
    "host_only_suggestions",
    with_views(*_FULL_VIEWS, body=_FULL_SQL + "SELECT face_id, suggestion_key, performer_id, performer_name, confidence, evidence_count FROM added"),
)
def host_only_suggestions(spark, folder):
    evidence = suggest.host_evidence(_linked(spark, folder))
    return suggest.host_only(evidence, _local(spark, folder), fx.performers(spark, folder))


@query(
    "suggest_faces",
    with_views(
        *_FULL_VIEWS,
        body=_FULL_SQL + f""",
every AS (SELECT face_id, suggestion_key, performer_id, performer_name, confidence, evidence_count FROM boosted
  UNION ALL SELECT face_id, suggestion_key, performer_id, performer_name, confidence, evidence_count FROM added),
best AS ({_BEST.format(source='every')}),
ranked AS (SELECT face_id, suggestion_key, performer_id, performer_name, round(confidence, 4) AS confidence, evidence_count, {_RANK} FROM best)
SELECT * FROM ranked WHERE rank <= 10""",
    ),
)
def suggest_all(spark, folder):
    made = suggest_faces(
        fx.faces(spark, folder),
        fx.face_embeddings(spark, folder),
        fx.performers(spark, folder),
        fx.appearances(spark, folder),
        fx.detections(spark, folder),
        fx.host_performers(spark, folder),
    )
    return made.withColumns({"rank": F.col("rank").cast("bigint"), "confidence": F.round("confidence", 4)})
