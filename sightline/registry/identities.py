"""Identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import fixtures as fx
from sightline.config import IDENTITY
from sightline.fixtures import with_views
from sightline.operators import identity as ident
from sightline.operators.graph import close_merge_map
from sightline.operators.identity_state import IdentityState
from sightline.plans.faces import prepare_faces
from sightline.registry.base import query
from sightline.session import scratch_dir

# Similarities of random vectors are low; these thresholds make matches happen.
_LOOSE = IDENTITY.__class__(match=0.30, same_asset_relaxation=0.07, ambiguity=0.05, consolidation=0.22,
                            reference_match=0.18, reference_margin=0.03)

_PAIR_SQL = """
t AS (SELECT asset_id, track_key, vector_id, vector FROM track_vectors),
a AS (SELECT face_key, reference_id, n, unnest(anchors) AS anchor, generate_subscripts(anchors, 1) AS place FROM identities_view),
s AS (SELECT t.asset_id, t.track_key, t.vector_id, a.face_key, a.place, list_cosine_similarity(t.vector::DOUBLE[], a.anchor::DOUBLE[]) AS c FROM t, a),
near AS (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY round(1 - c, 9), face_key || '#' || (place - 1)) AS r FROM s),
pairs AS (SELECT DISTINCT asset_id, track_key, face_key FROM near WHERE r <= 20),
best AS (SELECT asset_id, track_key, face_key, vector_id, max(c) AS c FROM s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id, track_key, face_key ORDER BY c DESC) AS i FROM best),
scores AS (SELECT asset_id, track_key, face_key, round(avg(c), 9) AS score FROM ranked WHERE i <= 2 GROUP BY ALL),
scored AS (SELECT * FROM scores JOIN pairs USING (asset_id, track_key, face_key) WHERE score > 0)
"""
_PAIR_VIEWS = ("track_vectors", "identities_view")


def _bundles(spark, folder):
    vectors = fx.track_vectors(spark, folder)
    # A track has three vectors.
    return vectors.groupBy("asset_id", "track_key").agg(F.collect_list("vector").alias("vectors"))


def _pairs(spark, folder):
    return ident.candidates(fx.track_vectors(spark, folder), fx.identities_view(spark, folder))


@query("identity_candidates", with_views(*_PAIR_VIEWS, body="WITH " + _PAIR_SQL + "SELECT * FROM pairs"))
def identity_candidates(spark, folder):
    return _pairs(spark, folder)


@query(
    "pair_score",
    with_views(*_PAIR_VIEWS, body="WITH " + _PAIR_SQL + """
SELECT asset_id, track_key, face_key, round(avg(c), 6) AS score FROM ranked JOIN pairs USING (asset_id, track_key, face_key)
WHERE i <= 2 GROUP BY ALL HAVING round(avg(c), 6) > 0"""),
)
def pair_score(spark, folder):
    known = fx.identities_view(spark, folder).select(
        "face_key", F.transform("anchors", lambda a: a["vector"]).alias("anchors")
    )
    joined = _pairs(spark, folder).join(_bundles(spark, folder), ["asset_id", "track_key"]).join(known, "face_key")
    made = joined.withColumn("score", F.round(ident.pair_score(F.col("vectors"), F.col("anchors"), "raw"), 6))
    return made.filter(F.col("score") > 0).select("asset_id", "track_key", "face_key", "score")


@query(
    "match_identity",
    with_views(
        *_PAIR_VIEWS,
        body="WITH " + _PAIR_SQL + """,
top AS (SELECT s.*, i.n, i.reference_id, row_number() OVER (PARTITION BY asset_id, track_key ORDER BY score DESC, face_key) AS i FROM scored s JOIN identities_view i USING (face_key)),
chosen AS (SELECT * FROM top WHERE i = 1 AND score >= CASE WHEN 'v' || (n % 50) = asset_id THEN 0.30 - 0.07 ELSE 0.30 END),
rivals AS (SELECT c.asset_id, c.track_key, c.face_key, c.reference_id AS lr, t.face_key AS rival, t.reference_id AS rr FROM chosen c JOIN top t USING (asset_id, track_key)
   WHERE t.face_key <> c.face_key AND c.score - t.score < 0.05),
cmp AS (SELECT r.face_key, r.rival, l.place, max(greatest(0.0, least(1.0, list_cosine_similarity(l.anchor::DOUBLE[], x.anchor::DOUBLE[])))) AS c
   FROM (SELECT DISTINCT face_key, rival FROM rivals) r JOIN a l ON l.face_key = r.face_key JOIN a x ON x.face_key = r.rival GROUP BY ALL),
cmp2 AS (SELECT face_key, rival, avg(c) AS score FROM (SELECT *, row_number() OVER (PARTITION BY face_key, rival ORDER BY c DESC) AS i FROM cmp) WHERE i <= 2 GROUP BY ALL),
blocked AS (SELECT DISTINCT asset_id, track_key FROM rivals JOIN cmp2 USING (face_key, rival)
   WHERE NOT (score >= 0.22 AND NOT (lr IS NOT NULL AND rr IS NOT NULL AND lower(lr) <> lower(rr))))
SELECT asset_id, track_key, face_key, round(score, 6) AS score FROM chosen WHERE (asset_id, track_key) NOT IN (SELECT asset_id, track_key FROM blocked)""",
    ),
)
def match_identity(spark, folder):
    made = ident.match_identity(
        _bundles(spark, folder), _pairs(spark, folder), fx.identities_view(spark, folder), cfg=_LOOSE
    )
    return made.withColumn("score", F.round("score", 6))


_REFERENCE_SQL = """
t AS (SELECT face_key, unnest(anchors) AS v, generate_subscripts(anchors, 1) AS at FROM identities_view {where}),
s AS (SELECT face_key, ordinal, external_id, display_name, list_cosine_similarity(v::DOUBLE[], vector::DOUBLE[]) AS c FROM t, reference_identities),
r AS (SELECT *, row_number() OVER (PARTITION BY face_key, ordinal ORDER BY c DESC) AS i FROM s WHERE c > 0),
m AS (SELECT face_key, ordinal, external_id, display_name, round(avg(c), 9) AS score FROM r WHERE i <= 2 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY face_key ORDER BY score DESC, ordinal) AS i, lead(score) OVER (PARTITION BY face_key ORDER BY score DESC, ordinal) AS second FROM m),
matched AS (SELECT face_key, external_id, display_name, score FROM o WHERE i = 1 AND score >= 0.18 AND round(score - coalesce(second, 0), 9) >= 0.03)
"""


@query(
    "match_reference",
    with_views(
        "identities_view",
        "reference_identities",
        body="WITH " + _REFERENCE_SQL.format(where="") + "SELECT face_key, external_id, display_name, round(score, 6) AS score FROM matched",
    ),
)
def match_reference(spark, folder):
    vectors = fx.identities_view(spark, folder).select("face_key", F.explode("anchors").alias("a"))
    made = ident.match_reference(
        vectors.select("face_key", F.col("a.vector").alias("vector")),
        fx.reference_identities(spark, folder),
        key="face_key",
        cfg=_LOOSE,
    )
    return made.select("face_key", "external_id", "display_name", F.round("score", 6).alias("score"))


@query(
    "backfill",
    with_views(
        "identities_view",
        "reference_identities",
        body="WITH " + _REFERENCE_SQL.format(where="WHERE reference_id IS NULL") + """
SELECT face_key, coalesce(external_id, reference_id) AS reference_id, CASE WHEN external_id IS NOT NULL THEN display_name END AS label,
  CASE WHEN external_id IS NOT NULL THEN 'promoted' ELSE lifecycle END AS lifecycle,
  CASE WHEN lifecycle = 'promoted' THEN 'video-evidence' WHEN external_id IS NOT NULL THEN 'reference' END AS promotion_reason
FROM identities_view LEFT JOIN matched USING (face_key)""",
    ),
)
def backfill(spark, folder):
    made = ident.backfill(
        fx.identities_view(spark, folder), fx.reference_identities(spark, folder), "labels", cfg=_LOOSE
    )
    return made.select("face_key", "reference_id", "label", "lifecycle", "promotion_reason")


@query(
    "promote_by_evidence",
    with_views(
        "identities_view",
        body="""
SELECT face_key, CASE WHEN reference_id IS NOT NULL THEN 'promoted' ELSE lifecycle END AS lifecycle,
  CASE WHEN lifecycle = 'promoted' THEN 'video-evidence' WHEN reference_id IS NOT NULL THEN 'reference' END AS promotion_reason FROM identities_view""",
    ),
)
def promote_by_evidence(spark, folder):
    return ident.promote_by_evidence(fx.identities_view(spark, folder)).select(
        "face_key", "lifecycle", "promotion_reason"
    )


def consolidate(spark, folder):
    """Merge map of all identities at the loose threshold."""
    cfg = IDENTITY.__class__(
        consolidation=0.30, consolidation_promoted=0.35, consolidation_same_asset=0.35, match=0.30
    )
    return ident.consolidate(fx.identities_view(spark, folder), cfg)[1]


_TRACKS_SQL = """
tr AS (SELECT o_orderkey, o_custkey AS face, CASE WHEN o_orderstatus = 'P' THEN 'image' ELSE 'video' END AS media_kind,
   o_orderkey // 4 AS asset_id, 1 + o_orderkey % 30 AS n, (1 + o_custkey % 12)::DOUBLE AS iv, CASE WHEN o_orderkey // 4 % 3 > 0 THEN 5.0 * (1 + o_orderkey // 4 % 40) END AS dur,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'r' END AS ref, 1 + o_custkey % 2 AS assets FROM orders),
ev AS (SELECT *, greatest(least(n * iv, dur), least((n - 1) * iv + iv, dur)) AS secs FROM tr),
why AS (SELECT *, CASE WHEN ref IS NOT NULL THEN 'reference' WHEN media_kind = 'image' THEN 'image' WHEN assets > 1 THEN 'multi-asset'
   WHEN n >= 24 OR (iv >= 10 AND ((n = 1 AND dur <= iv) OR (n >= least(24, greatest(2, coalesce(ceil(greatest(1, ceil(dur / iv)) * 0.1), 0))) AND secs >= 24))) THEN 'video-evidence' END AS reason FROM ev)
"""


def _assignments(spark, folder):
    key, asset = F.col("o_orderkey"), F.expr("o_orderkey div 4")
    n, interval = (1 + key % 30).cast("bigint"), (1 + F.col("o_custkey") % 12).cast("double")
    return fx.load(spark, folder, "orders").select(
        key.alias("track_key"),
        F.col("o_custkey").alias("face_key"),
        F.when(F.col("o_orderstatus") == "P", "image").otherwise("video").alias("media_kind"),
        asset.alias("asset_id"),
        n.alias("sample_count"),
        interval.alias("frame_interval"),
        F.when(asset % 3 > 0, 5.0 * (1 + asset % 40)).alias("duration_seconds"),
        F.lit(0.0).alias("start_seconds"),
        ((n - 1) * interval).alias("end_seconds"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "r").alias("reference_id"),
        (1 + F.col("o_custkey") % 2).alias("asset_count"),
    )


@query("promotion_reason", "WITH " + _TRACKS_SQL + "SELECT o_orderkey AS track_key, reason, secs AS seconds FROM why")
def promotion_reason(spark, folder):
    rows = _assignments(spark, folder)
    return rows.select(
        "track_key", ident.promotion_reason().alias("reason"), ident.represented_seconds().alias("seconds")
    )


@query(
    "brief_presence",
    "WITH " + _TRACKS_SQL + """,
sp AS (SELECT asset_id, max(dur) AS dur, max((n - 1) * iv) AS span FROM ev WHERE media_kind = 'video' GROUP BY 1),
sh AS (SELECT asset_id, face, sum(secs) AS seconds FROM ev WHERE media_kind = 'video' GROUP BY 1, 2),
fl AS (SELECT asset_id, CASE WHEN coalesce(dur, CASE WHEN span > 0 THEN span END) > 0 THEN least(8.0, coalesce(dur, span) * 0.5) ELSE 8.0 END AS floor FROM sp)
SELECT asset_id, face AS face_key, seconds, floor::DOUBLE AS floor FROM sh JOIN fl USING (asset_id) WHERE floor > 0 AND seconds < floor""",
)
def brief_presence(spark, folder):
    return ident.brief_presence(_assignments(spark, folder))


@query(
    "close_merge_map",
    """
WITH RECURSIVE m AS (SELECT p_partkey AS duplicate, p_partkey // 2 AS target FROM part WHERE p_partkey > 1),
walk AS (SELECT duplicate, target FROM m UNION ALL SELECT w.duplicate, m.target FROM walk w JOIN m ON m.duplicate = w.target)
SELECT duplicate, target FROM walk WHERE target NOT IN (SELECT duplicate FROM m)
""",
)
def merge_map(spark, folder):
    part = fx.load(spark, folder, "part").filter(F.col("p_partkey") > 1)
    return close_merge_map(
        part.select(F.col("p_partkey").alias("duplicate"), F.expr("p_partkey div 2").alias("target"))
    )


_MERGES_SQL = "mg AS (SELECT face_id AS duplicate, merged_into AS target FROM faces WHERE merged_into IS NOT NULL)"


def _merges(spark, folder):
    gone = fx.faces(spark, folder).filter(F.col("merged_into").isNotNull())
    return gone.select(F.col("face_id").alias("duplicate"), F.col("merged_into").alias("target"))


@query(
    "repoint_appearances",
    with_views(
        "faces",
        "appearances",
        body="WITH " + _MERGES_SQL + """
SELECT coalesce(target, face_id) AS face_id, host_type, host_id, sample_count, run_id FROM appearances LEFT JOIN mg ON duplicate = face_id""",
    ),
)
def repoint_appearances(spark, folder):
    return ident.repoint(fx.appearances(spark, folder), "face_id", _merges(spark, folder))


@query(
    "merge_faces",
    with_views(
        "faces",
        body="WITH " + _MERGES_SQL + """
SELECT f.face_id, coalesce(f.performer_id, d.performer_id) AS performer_id, coalesce(d.label, f.label) AS label, f.merged_into
FROM faces f LEFT JOIN (SELECT target, face_id, performer_id, label FROM mg JOIN faces ON face_id = duplicate) d ON d.target = f.face_id""",
    ),
)
def merge_faces(spark, folder):
    made = ident.merge_faces(fx.faces(spark, folder), _merges(spark, folder))
    return made.select("face_id", "performer_id", "label", "merged_into")


@query(
    "face_stats",
    with_views(
        "appearances",
        "detections",
        body="""
WITH d AS (SELECT face_id, count(*) AS n, count(DISTINCT host_id) FILTER (host_type = 'video') AS v, count(DISTINCT host_id) FILTER (host_type = 'image') AS i FROM detections GROUP BY 1),
a AS (SELECT face_id, sum(sample_count)::BIGINT AS s, count(DISTINCT host_id) FILTER (host_type = 'video') AS v, count(DISTINCT host_id) FILTER (host_type = 'image') AS i FROM appearances GROUP BY 1)
SELECT coalesce(a.face_id, d.face_id) AS face_id, coalesce(n, 0) AS detection_count, coalesce(a.v, d.v) + coalesce(a.i, d.i) AS appearance_count,
  coalesce(s, n) AS frame_sample_count, coalesce(a.v, d.v) AS video_count, coalesce(a.i, d.i) AS image_count FROM d FULL JOIN a ON a.face_id = d.face_id""",
    ),
)
def face_stats(spark, folder):
    return ident.face_stats(fx.detections(spark, folder), fx.appearances(spark, folder))


@query(
    "suppress",
    with_views(
        "faces",
        "appearances",
        "host_performers",
        body="""
SELECT DISTINCT face_id, host_type, host_id FROM appearances a JOIN faces USING (face_id)
WHERE NOT EXISTS (SELECT 1 FROM host_performers h WHERE h.host_type = a.host_type AND h.host_id = a.host_id AND h.performer_id = faces.performer_id)""",
    ),
)
def suppress(spark, folder):
    """Suppressions: hosts that already carry the face's performer."""
    faces = fx.faces(spark, folder)
    rows = fx.appearances(spark, folder).join(faces.select("face_id", "face_key"), "face_id")
    # Of a performer's faces only those that appear on the host can be absent from it.
    shown = rows.select("face_key", "host_type", "host_id").distinct().join(faces.select("face_key", "performer_id"), "face_key")
    marks = shown.join(fx.host_performers(spark, folder), ["performer_id", "host_type", "host_id"], "left_semi").select(
        F.upper("face_key").alias("face_key"), "host_type", "host_id"
    )
    return ident.suppress(rows, marks).select("face_id", "host_type", "host_id").distinct()


_PROPAGATE_SQL = """
w AS (SELECT DISTINCT a.face_id, f.performer_id, a.host_type, a.host_id FROM appearances a JOIN faces f USING (face_id) WHERE f.performer_id IS NOT NULL AND f.merged_into IS NULL),
hp AS (SELECT performer_id, host_type, host_id FROM host_performers),
ow AS (SELECT DISTINCT d.face_id, f.performer_id, d.host_type, d.host_id FROM detections d JOIN faces f USING (face_id) JOIN hp ON hp.performer_id = f.performer_id AND hp.host_type = d.host_type AND hp.host_id = d.host_id),
organic AS (SELECT * FROM hp EXCEPT SELECT performer_id, host_type, host_id FROM ow),
mine AS (SELECT * FROM ow INTERSECT SELECT * FROM w UNION SELECT * FROM w WHERE (performer_id, host_type, host_id) NOT IN (SELECT performer_id, host_type, host_id FROM organic)),
gone AS (SELECT performer_id, host_type, host_id FROM (SELECT * FROM ow EXCEPT SELECT * FROM w) EXCEPT SELECT performer_id, host_type, host_id FROM mine),
links AS (SELECT * FROM (SELECT * FROM hp UNION SELECT performer_id, host_type, host_id FROM mine) EXCEPT SELECT * FROM gone)
"""
_PROPAGATE_VIEWS = ("appearances", "detections", "faces", "host_performers")


def _propagated(spark, folder):
    faces, hosts = fx.faces(spark, folder), fx.host_performers(spark, folder)
    key = ["performer_id", "host_type", "host_id"]
    owned = (
        fx.detections(spark, folder)
        .join(faces.select("face_id", "performer_id"), "face_id")
        .join(hosts, key, "left_semi")
        .select("face_id", *key)
        .distinct()
    )
    return ident.propagate_links(fx.appearances(spark, folder), faces, hosts, owned)


@query(
    "propagate_links",
    with_views(*_PROPAGATE_VIEWS, body="WITH " + _PROPAGATE_SQL + "SELECT performer_id, host_type, host_id FROM links"),
)
def propagate_links(spark, folder):
    return _propagated(spark, folder)[0]


@query(
    "propagate_owned",
    with_views(*_PROPAGATE_VIEWS, body="WITH " + _PROPAGATE_SQL + "SELECT face_id, performer_id, host_type, host_id FROM mine"),
)
def propagate_owned(spark, folder):
    return _propagated(spark, folder)[1]


@query("split_not_present")
def split_not_present(spark, folder):
    """Marks the first video of every face with several hosts."""
    runs = _face_runs(spark, folder)
    several = runs.groupBy("face_id").agg(F.count_distinct("host_id").alias("n"), F.min("host_id").alias("host_id"))
    marks = several.filter(F.col("n") > 1).select("face_id", F.lit("video").alias("host_type"), "host_id")
    moves, _ = ident.split_not_present(
        marks, fx.faces(spark, folder), runs, fx.face_embeddings(spark, folder)
    )
    return moves


def _face_runs(spark, folder):
    return fx.face_embeddings(spark, folder).select(
        F.col("host_id").alias("face_id"),
        F.lit("video").alias("host_type"),
        F.expr("embedding_id % 7").alias("host_id"),
        "run_id",
    ).distinct()


@query(
    "cover_winner",
    with_views(
        "faces",
        "detections",
        body="""
WITH o AS (SELECT face_key, arg_max(item, (score, -item)) AS candidate, max(score) AS offered_quality FROM detections JOIN faces USING (face_id) GROUP BY 1)
SELECT face_key, candidate, offered_quality FROM faces JOIN o USING (face_key)
WHERE face_id % 4 = 0 OR face_id % 3 = 0 OR offered_quality > 0.9 + (face_id % 10) / 100.0 + 0.02""",
    ),
)
def cover_winner(spark, folder):
    faces = fx.faces(spark, folder)
    stored = F.when(F.col("face_id") % 3 != 0, 0.9 + (F.col("face_id") % 10) / 100.0)
    table = faces.select("face_key", (F.col("face_id") % 4 != 0).alias("has_cover"), stored.alias("cover_quality"))
    offered = fx.detections(spark, folder).join(faces.select("face_id", "face_key"), "face_id").select(
        "face_key", F.col("item").alias("candidate"), F.col("score").alias("cover_quality")
    )
    return ident.cover_winner(table, offered)


@query(
    "commit_identities",
    with_views(
        "identities_view",
        body="""
WITH base AS (SELECT face_key, n FROM identities_view WHERE lifecycle = 'promoted'),
snap AS (SELECT face_key, n FROM identities_view WHERE reference_id IS NULL)
SELECT coalesce(b.face_key, s.face_key) AS face_key, CASE WHEN b.face_key IS NULL THEN 'insert' WHEN s.face_key IS NULL THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN s.face_key IS NULL THEN NULL ELSE 2 + s.n % 7 END AS observation_count FROM base b FULL JOIN snap s ON s.face_key = b.face_key""",
    ),
)
def commit_identities(spark, folder):
    people = fx.identities_view(spark, folder)
    base = people.filter(F.col("lifecycle") == "promoted")
    snapshot = people.filter(F.col("reference_id").isNull()).withColumn(
        "observation_count", F.col("observation_count") + 1
    )
    changes = ident.commit_identities(base, snapshot, base)
    return changes.select("face_key", "action", "observation_count")


@query(
    "purge",
    with_views(
        "identities_view",
        body="SELECT face_key, observation_count FROM (SELECT face_key, 1 + n % 7 AS observation_count, reference_id FROM identities_view) WHERE reference_id IS NULL",
    ),
)
def purge(spark, folder):
    people = fx.identities_view(spark, folder)
    gone = people.filter(F.col("reference_id").isNotNull()).select("face_key")
    return ident.purge(people, face_keys=gone).select("face_key", "observation_count")


# Tracks as batches: an even track is in the first, an odd one in the second; each goes to the identity of its number.
_FOLD_SQL = """
n AS (SELECT count(*) AS people FROM identities_view),
tv AS (SELECT vec_id, vec_id // 3 AS t, 'v' || ((vec_id // 3) % 50) AS asset, embedding::DOUBLE[] AS v, (5 + vec_id % 11)::DOUBLE AS q FROM embeddings),
named AS (SELECT *, 'face-' || lpad(((t // 2) % (SELECT people FROM n))::VARCHAR, 6, '0') AS face_key, t % 2 AS batch FROM tv),
tr AS (SELECT DISTINCT face_key, t, batch, asset, 3 + t % 5 AS samples, (t % 13)::DOUBLE AS tq, (t % 17)::DOUBLE / 17 AS cq FROM named),
agg AS (SELECT face_key, sum(samples) AS samples, max(tq) AS tq FROM tr GROUP BY face_key),
one AS (SELECT face_key, batch, max(cq) AS cq, min_by(asset, struct_pack(c := -cq, a := asset, k := t)) AS asset FROM tr GROUP BY ALL),
cover AS (SELECT face_key, CASE WHEN a0.face_key IS NULL THEN a1.asset WHEN a1.cq > a0.cq THEN a1.asset ELSE a0.asset END AS cover_asset
  FROM (SELECT * FROM one WHERE batch = 0) a0 FULL JOIN (SELECT * FROM one WHERE batch = 1) a1 USING (face_key)),
ring AS (SELECT face_key, asset, min(o) AS o FROM (
  SELECT face_key, asset, (1 - batch) AS o FROM tr UNION ALL SELECT face_key, 'v' || (n % 50), 2 FROM identities_view) GROUP BY ALL),
rings AS (SELECT face_key, string_agg(asset, ',' ORDER BY o, asset DESC) AS assets FROM ring GROUP BY face_key),
held AS (SELECT face_key, unnest(anchors)::DOUBLE[] AS v FROM identities_view),
fresh AS (SELECT a.* FROM named a WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.face_key = a.face_key AND list_cosine_similarity(h.v, a.v) >= 0.975)
  AND NOT EXISTS (SELECT 1 FROM named b WHERE b.face_key = a.face_key AND (b.batch < a.batch OR (b.batch = a.batch AND (b.q > a.q OR (b.q = a.q AND b.vec_id < a.vec_id))))
    AND list_cosine_similarity(b.v, a.v) >= 0.975)),
added AS (SELECT face_key, count(*) AS vectors FROM fresh GROUP BY face_key)
"""


@query(
    "fold_identities",
    with_views(
        "identities_view",
        body="WITH " + _FOLD_SQL + """
SELECT i.face_key, 1 + i.n % 7 + coalesce(samples, 0)::BIGINT AS observation_count, greatest((i.n % 11)::DOUBLE, coalesce(tq, 0)) AS quality, cover_asset, assets,
  least(12, len(anchors) + coalesce(vectors, 0))::BIGINT AS anchor_count
FROM identities_view i LEFT JOIN agg USING (face_key) LEFT JOIN cover USING (face_key) LEFT JOIN rings USING (face_key) LEFT JOIN added USING (face_key)""",
    ),
)
def fold_identities(spark, folder):
    """Two batches of tracks folded into the stored identities, the second of them twice."""
    state = IdentityState(spark, scratch_dir(spark, "identities"), buckets=8)
    known = fx.identities_view(spark, folder)
    state.put(known, "load", 0)
    people = known.count()
    track = F.expr("vec_id div 3")
    vectors = fx.load(spark, folder, "embeddings").select(
        F.concat(F.lit("face-"), F.lpad((F.expr("vec_id div 6") % people).cast("string"), 6, "0")).alias("face_key"),
        F.concat(F.lit("v"), (track % 50).cast("string")).alias("asset_id"),
        track.alias("track_key"),
        F.col("vec_id").alias("vector_pos"),
        F.lit("face-vectors").alias("model_key"),
        (5 + F.col("vec_id") % 11).cast("double").alias("quality"),
        F.col("embedding").alias("vector"),
    )
    box = F.struct(*[F.lit(x).alias(n) for n, x in (("x1", 0.0), ("y1", 0.0), ("x2", 0.5), ("y2", 0.5))])
    assigned = vectors.select("face_key", "asset_id", "track_key").distinct().select(
        "face_key",
        "asset_id",
        "track_key",
        (3 + F.col("track_key") % 5).alias("sample_count"),
        (F.col("track_key") % 13).cast("double").alias("track_quality"),
        box.alias("cover_box"),
        ((F.col("track_key") % 17).cast("double") / 17).alias("cover_quality"),
    )
    for epoch in (0, 1, 1):
        part = F.col("track_key") % 2 == epoch
        state.fold(assigned.filter(part), vectors.filter(part), "tracks", epoch)
    return state.read().select(
        "face_key", "observation_count", "quality", "cover_asset", F.array_join("asset_ids", ",").alias("assets"), F.size("anchors").cast("bigint").alias("anchor_count")
    )


def prepare(spark, folder):
    """The whole face path over every sample: evidence rows per kind and asset."""
    samples = fx.face_samples_view(spark, folder)
    assets = samples.groupBy("asset_id").agg(
        F.lit("video").alias("media_kind"),
        (F.max("time_seconds") + 1).alias("duration_seconds"),
        F.lit(1.0).alias("frame_interval"),
    )
    batch = prepare_faces(
        samples,
        assets,
        fx.identities_view(spark, folder),
        reference=fx.reference_identities(spark, folder),
        pack_id="labels",
        next_ordinal=1000000,
    )
    kinds = ("detections", "segments", "appearances", "embeddings")
    made = [
        batch.evidence[k].groupBy("asset_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("artifact", F.lit(k))
        for k in kinds
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


# One round of consolidation over the whole set, with thresholds that random vectors reach.
_ROUND_SQL = """
f AS (SELECT *, 'v' || (n % 50) AS asset, lifecycle = 'promoted' AS promoted, lower(reference_id) AS ref, (1 + n % 7)::BIGINT AS seen,
  (n % 11)::DOUBLE AS quality FROM identities_view),
av AS (SELECT face_key, unnest(anchors)::DOUBLE[] AS v, generate_subscripts(anchors, 1) AS place FROM identities_view),
c AS (SELECT l.face_key AS source, r.face_key AS other, l.place, max(greatest(0.0, least(1.0, list_cosine_similarity(l.v, r.v)))) AS c
  FROM av l JOIN av r ON l.face_key <> r.face_key GROUP BY ALL),
p AS (SELECT source, other, round(avg(c), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source, other ORDER BY c DESC) AS i FROM c)
  WHERE i <= 2 GROUP BY ALL),
j AS (SELECT source, other, score, score >= (CASE WHEN l.asset = r.asset THEN CASE WHEN l.ref IS NOT NULL OR r.ref IS NOT NULL OR (l.promoted AND r.promoted)
    THEN 0.30 ELSE 0.72 END ELSE CASE WHEN l.promoted AND r.promoted AND (l.ref = r.ref) IS NOT TRUE THEN 0.70 ELSE 0.22 END END)::DOUBLE AS merges
  FROM p JOIN f l ON l.face_key = source JOIN f r ON r.face_key = other WHERE score > 0 AND (l.ref <> r.ref) IS NOT TRUE),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source
  ORDER BY score DESC, md5(least(source, other) || '|' || greatest(source, other)), other) AS i FROM j) WHERE i = 1 AND merges),
blocked AS (SELECT DISTINCT b.source FROM b JOIN j x ON x.source = b.source AND x.other <> b.other AND b.score - x.score < 0.03::DOUBLE
  LEFT JOIN j y ON y.source = b.other AND y.other = x.other AND y.merges WHERE y.source IS NULL),
proposed AS (SELECT source, other, score FROM b WHERE source NOT IN (SELECT source FROM blocked)),
edges AS (SELECT least(source, other) AS a, greatest(source, other) AS b, max(score) AS score, md5(least(source, other) || '|' || greatest(source, other)) AS h
  FROM proposed GROUP BY ALL),
ends AS (SELECT a, b, row_number() OVER (PARTITION BY e ORDER BY score DESC, h, a, b) AS i FROM (SELECT *, unnest([a, b]) AS e FROM edges)),
agreed AS (SELECT a AS source, b AS other FROM ends WHERE i = 1 GROUP BY a, b HAVING count(*) = 2),
sided AS (SELECT source, other, CASE WHEN l.promoted <> r.promoted THEN l.promoted WHEN (l.ref IS NULL) <> (r.ref IS NULL) THEN l.ref IS NOT NULL
    WHEN l.seen <> r.seen THEN l.seen > r.seen ELSE l.quality >= r.quality END AS stays
  FROM agreed JOIN f l ON l.face_key = source JOIN f r ON r.face_key = other),
merged AS (SELECT CASE WHEN stays THEN other ELSE source END AS duplicate, CASE WHEN stays THEN source ELSE other END AS target FROM sided)
"""


def _round(spark, folder):
    known = fx.identities_view(spark, folder)
    return known, ident.merge_proposals(known, ident.near_scores(known, cfg=_LOOSE), cfg=_LOOSE, complete=False)


@query(
    "merge_proposals",
    with_views("identities_view", body="WITH " + _ROUND_SQL + "SELECT source, other, round(score, 6) AS score FROM proposed"),
)
def merge_proposals(spark, folder):
    return _round(spark, folder)[1].select("source", "other", F.round("score", 6).alias("score"))


@query("independent_merges", with_views("identities_view", body="WITH " + _ROUND_SQL + "SELECT source, other FROM agreed"))
def independent_merges(spark, folder):
    return ident.independent_merges(_round(spark, folder)[1])


@query("choose_target", with_views("identities_view", body="WITH " + _ROUND_SQL + "SELECT duplicate, target FROM merged"))
def choose_target(spark, folder):
    known, proposals = _round(spark, folder)
    return ident.chosen_merges(known, ident.independent_merges(proposals))


@query(
    "merge_into",
    with_views(
        "identities_view",
        body="WITH " + _ROUND_SQL + """
SELECT t.face_key, coalesce(t.reference_id, d.reference_id) AS reference_id, CASE WHEN d.promoted THEN 'promoted' ELSE t.lifecycle END AS lifecycle,
  t.seen + coalesce(d.seen, 0) AS observation_count, greatest(t.quality, coalesce(d.quality, 0)) AS quality,
  CASE WHEN d.asset <> t.asset THEN 2 ELSE 1 END AS assets
FROM f t LEFT JOIN merged m ON m.target = t.face_key LEFT JOIN f d ON d.face_key = m.duplicate
WHERE t.face_key NOT IN (SELECT duplicate FROM merged)""",
    ),
)
def merge_into(spark, folder):
    known, proposals = _round(spark, folder)
    merges = ident.chosen_merges(known, ident.independent_merges(proposals))
    made = ident.merge_into(known.select(*ident.COLUMNS), merges, cfg=_LOOSE)
    return made.select(
        "face_key", "reference_id", "lifecycle", "observation_count", "quality", F.size("asset_ids").alias("assets")
    )


@query("consolidate")
def consolidate(spark, folder):
    """All rounds: every identity with the one it ends in."""
    known = fx.identities_view(spark, folder)
    remaining, merges = ident.consolidate(known, cfg=_LOOSE)
    gone = merges.select(F.col("duplicate").alias("face_key"), F.col("target").alias("into"))
    return remaining.select("face_key", F.col("face_key").alias("into")).unionByName(gone)
