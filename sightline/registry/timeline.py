"""Timeline, tag and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import fixtures as fx
from sightline.fixtures import with_views
from sightline.operators import paths, tags, timeline
from sightline.operators.ordered import time_bucket
from sightline.registry.base import query

_KEPT = "(confidence IS NULL OR confidence >= 0.35)"

_SEGMENTS_SQL = f"""
f AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY time_seconds, slice_index, slice_pos) AS ord
      FROM frames),
k AS (SELECT asset_id, slice_pos, model_key, label AS tag, max(confidence) AS conf, count(*) AS n
      FROM frame_tags WHERE {_KEPT} GROUP BY ALL),
r AS (SELECT k.*, f.time_seconds AS t,
             ord - row_number() OVER (PARTITION BY asset_id, model_key, tag ORDER BY ord) AS grp
      FROM k JOIN f USING (asset_id, slice_pos)),
segments AS (SELECT asset_id, model_key, tag, min(t) AS start_seconds, max(t) + 1.0 AS end_seconds,
                    max(conf) AS confidence, sum(n)::BIGINT AS observation_count
             FROM r GROUP BY asset_id, model_key, tag, grp)
"""


@query(
    "confidence_floor",
    with_views("frame_tags", body=f"SELECT item_pos, label, round(confidence, 6) AS confidence FROM frame_tags WHERE {_KEPT}"),
)
def confidence_floor(spark, folder):
    kept = timeline.confidence_floor(fx.frame_tags(spark, folder))
    return kept.select("item_pos", "label", F.round("confidence", 6).alias("confidence"))


@query(
    "image_tag_links",
    with_views(
        "frame_tags",
        body=f"SELECT asset_id, label AS tag, model_key, round(confidence, 6) AS confidence FROM frame_tags WHERE {_KEPT}",
    ),
)
def image_tag_links(spark, folder):
    links = tags.image_tag_links(fx.frame_tags(spark, folder))
    return links.withColumn("confidence", F.round("confidence", 6))


@query(
    "tag_segments",
    with_views(
        "frames",
        "frame_tags",
        body="WITH " + _SEGMENTS_SQL + """
SELECT asset_id, model_key, tag, start_seconds, end_seconds, round(confidence, 6) AS confidence,
       observation_count FROM segments""",
    ),
)
def tag_segments(spark, folder):
    made = timeline.tag_segments(fx.frames(spark, folder), fx.frame_tags(spark, folder))
    return made.withColumn("confidence", F.round("confidence", 6))


@query(
    "infer_frame_span",
    """
WITH s AS (SELECT user_id AS asset_id, floor(epoch(ts))::BIGINT - 1704067200 AS t,
                  CASE WHEN user_id % 3 = 0 THEN 2.0::DOUBLE END AS stated FROM events),
d AS (SELECT asset_id, t - lag(t) OVER (PARTITION BY asset_id ORDER BY t) AS gap
      FROM (SELECT DISTINCT asset_id, t FROM s)),
n AS (SELECT asset_id, gap, row_number() OVER (PARTITION BY asset_id ORDER BY gap) - 1 AS i,
             count(*) OVER (PARTITION BY asset_id) AS n FROM d WHERE gap > 0),
m AS (SELECT asset_id, gap AS median FROM n WHERE i = n // 2)
SELECT a.asset_id, coalesce(a.stated, greatest(0.25, m.median), 0.5)::DOUBLE AS frame_span
FROM (SELECT asset_id, max(stated) AS stated FROM s GROUP BY asset_id) a LEFT JOIN m USING (asset_id)
""",
)
def infer_frame_span(spark, folder):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    slices = fx.load(spark, folder, "events").select(
        F.col("user_id").alias("asset_id"),
        seconds.cast("double").alias("time_seconds"),
        F.when(F.col("user_id") % 3 == 0, F.lit(2.0)).alias("frame_interval"),
    )
    return timeline.infer_frame_span(slices)


def _overrides(spark, folder):
    names = fx.load(spark, folder, "events").select("event_type").distinct()
    return names.filter(F.col("event_type") > "m").select(
        F.concat(F.lit(" "), F.upper("event_type")).alias("source_tag"),
        F.concat(F.lit("act-"), F.col("event_type"), F.lit(" ")).alias("target_tag"),
    )


@query(
    "apply_tag_overrides",
    with_views(
        "frames",
        "frame_tags",
        body="WITH " + _SEGMENTS_SQL + """
SELECT asset_id, model_key, start_seconds,
       CASE WHEN tag > 'm' THEN 'act-' || tag ELSE tag END AS tag,
       CASE WHEN model_key = 'model-0' THEN 'kept' WHEN tag > 'm' THEN 'act-' || tag ELSE tag END AS title
FROM segments""",
    ),
)
def apply_tag_overrides(spark, folder):
    made = timeline.tag_segments(fx.frames(spark, folder), fx.frame_tags(spark, folder))
    titled = made.withColumn(
        "title", F.when(F.col("model_key") == "model-0", "kept").otherwise(F.upper("tag"))
    )
    renamed = tags.apply_tag_overrides(titled, _overrides(spark, folder))
    return renamed.select("asset_id", "model_key", "start_seconds", "tag", "title")


@query(
    "upsert_tags",
    """
WITH d AS (SELECT n_nationkey::BIGINT + 1 AS tag_id, n_name AS name FROM nation),
fresh AS (SELECT lower(trim(name)) AS k, min(trim(name)) AS name FROM (
            SELECT p_name AS name FROM part UNION ALL SELECT ' ' || lower(n_name) FROM nation
            UNION ALL SELECT p_type FROM part)
          WHERE trim(name) <> '' GROUP BY 1 HAVING lower(trim(min(name))) NOT IN (SELECT lower(name) FROM d))
SELECT tag_id, name FROM d UNION ALL
SELECT 25 + row_number() OVER (ORDER BY name) AS tag_id, name FROM fresh
""",
)
def upsert_tags(spark, folder):
    nation, part = fx.load(spark, folder, "nation"), fx.load(spark, folder, "part")
    dimension = nation.select((F.col("n_nationkey") + 1).alias("tag_id"), F.col("n_name").alias("name"))
    names = (
        part.select(F.col("p_name").alias("name"))
        .unionByName(nation.select(F.concat(F.lit(" "), F.lower("n_name")).alias("name")))
        .unionByName(part.select(F.col("p_type").alias("name")))
    )
    return tags.upsert_tags(dimension, names)


@query(
    "tag_evidence",
    with_views(
        "frames",
        "frame_tags",
        body="WITH " + _SEGMENTS_SQL + f""",
rows AS (SELECT asset_id AS host_id, label AS tag, 'tagging' AS source_key, model_key, confidence, NULL::DOUBLE AS s
         FROM frame_tags WHERE {_KEPT}
         UNION ALL SELECT asset_id, tag, 'timeline', model_key, confidence,
                CASE WHEN end_seconds > start_seconds THEN end_seconds - start_seconds END FROM segments),
h AS (SELECT asset_id AS host_id, max(time_seconds) + 1 AS host_duration FROM frames GROUP BY 1)
SELECT host_id, tag, source_key, model_key, round(max(confidence), 6) AS confidence,
       CASE WHEN sum(s) > 0 THEN sum(s) END AS total_duration, max(host_duration) AS host_duration
FROM rows LEFT JOIN h USING (host_id) GROUP BY host_id, tag, source_key, model_key""",
    ),
)
def tag_evidence(spark, folder):
    frames, predictions = fx.frames(spark, folder), fx.frame_tags(spark, folder)
    links = tags.image_tag_links(predictions).withColumn("source_key", F.lit("tagging"))
    segments = timeline.tag_segments(frames, predictions).withColumn("source_key", F.lit("timeline"))
    hosts = frames.groupBy(F.col("asset_id").alias("host_id")).agg(
        (F.max("time_seconds") + 1).alias("host_duration")
    )
    made = tags.tag_evidence(
        links.withColumnRenamed("asset_id", "host_id"),
        segments.withColumnRenamed("asset_id", "host_id"),
        hosts,
    )
    return made.withColumn("confidence", F.round("confidence", 6))


@query(
    "upsert_evidence",
    with_views(
        "frame_tags",
        body=f"""
WITH n AS (SELECT asset_id AS host_id, label AS tag, 'tagging' AS source_key, model_key,
                  max(confidence) AS confidence FROM frame_tags WHERE {_KEPT} GROUP BY ALL),
o AS (SELECT DISTINCT asset_id AS host_id, label AS tag, 'tagging' AS source_key, model_key,
             0.0::DOUBLE AS confidence FROM frame_tags)
SELECT host_id, tag, source_key, model_key, round(confidence, 6) AS confidence FROM n
UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.host_id = o.host_id AND n.tag = o.tag
  AND n.model_key = o.model_key)""",
    ),
)
def upsert_evidence(spark, folder):
    predictions = fx.frame_tags(spark, folder).select(
        F.col("asset_id").alias("host_id"),
        F.col("label").alias("tag"),
        F.lit("tagging").alias("source_key"),
        "model_key",
        "confidence",
    )
    key = ["host_id", "tag", "source_key", "model_key"]
    fresh = timeline.confidence_floor(predictions).groupBy(*key).agg(F.max("confidence").alias("confidence"))
    stored = predictions.select(*key).distinct().withColumn("confidence", F.lit(0.0))
    return tags.upsert_evidence(stored, fresh).withColumn("confidence", F.round("confidence", 6))


_INTERVALS_SQL = """
intervals AS (SELECT DISTINCT l_suppkey AS asset_id, 10.0::DOUBLE * (l_partkey % 997) + l_linenumber AS start_seconds,
  CASE WHEN l_tax = 0 THEN 10.0::DOUBLE * (l_partkey % 997) + l_linenumber
       ELSE 10.0::DOUBLE * (l_partkey % 997) + l_linenumber + l_quantity / 2 END AS end_seconds FROM lineitem),
reach AS (SELECT *, max(end_seconds) OVER (PARTITION BY asset_id ORDER BY start_seconds, end_seconds
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM intervals),
grouped AS (SELECT *, sum(CASE WHEN seen IS NULL OR start_seconds > seen THEN 1 ELSE 0 END)
            OVER (PARTITION BY asset_id ORDER BY start_seconds, end_seconds ROWS UNBOUNDED PRECEDING) AS g FROM reach),
merged AS (SELECT asset_id, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds
           FROM grouped GROUP BY asset_id, g)
"""


def _intervals(spark, folder):
    start = F.lit(10.0) * (F.col("l_partkey") % 997) + F.col("l_linenumber")
    return fx.load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"),
        start.alias("start_seconds"),
        F.when(F.col("l_tax") != 0, start + F.col("l_quantity") / 2).alias("end_seconds"),
    )


@query("merge_intervals", "WITH " + _INTERVALS_SQL + "SELECT * FROM merged")
def merge_intervals(spark, folder):
    return timeline.merge_intervals(_intervals(spark, folder), ["asset_id"])


_CAPPED_SQL = _INTERVALS_SQL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_seconds) - 1 AS i,
                    count(*) OVER (PARTITION BY asset_id) AS n FROM merged),
capped AS (SELECT asset_id, start_seconds, end_seconds FROM numbered
   WHERE n <= 64 OR list_contains([round_even(k * ((n - 1) / 63.0::DOUBLE), 0)::BIGINT FOR k IN range(64)], i))
"""


@query("representative_intervals", "WITH " + _CAPPED_SQL + "SELECT * FROM capped")
def representative_intervals(spark, folder):
    return timeline.merge_intervals(_intervals(spark, folder), ["asset_id"], 64)


@query(
    "interval_weights",
    with_views(
        "embeddings_view",
        body="WITH " + _CAPPED_SQL + """,
p AS (SELECT e.embedding_id, CASE WHEN c.end_seconds > c.start_seconds
        THEN greatest(0.0, least(e.e, c.end_seconds) - greatest(e.s, c.start_seconds))
        WHEN c.start_seconds BETWEEN e.s AND e.e THEN 1.0 ELSE 0.0 END AS w, e.asset_id
      FROM (SELECT embedding_id, host_id AS asset_id, coalesce(start_seconds, 0.0) AS s,
                   coalesce(end_seconds, start_seconds, 0.0) AS e FROM embeddings_view) e
      JOIN capped c USING (asset_id))
SELECT asset_id, embedding_id, round(sum(w), 6)::DOUBLE AS weight FROM p GROUP BY asset_id, embedding_id
HAVING sum(w) > 0""",
    ),
)
def interval_weights(spark, folder):
    sections = fx.embeddings_view(spark, folder).withColumnRenamed("host_id", "asset_id")
    intervals = timeline.merge_intervals(_intervals(spark, folder), ["asset_id"], 64)
    made = timeline.interval_weights(sections, intervals, ["asset_id"], "embedding_id")
    return made.withColumn("weight", F.round("weight", 6))


@query(
    "representatives",
    """
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i,
                  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM n
WHERE n <= 4 OR list_contains([round_even(k * ((n - 1) / 3.0::DOUBLE), 0)::BIGINT FOR k IN range(4)], i)
""",
)
def representatives(spark, folder):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    orders = fx.load(spark, folder, "orders")
    bucket = F.floor(days / 90).cast("bigint")
    made = timeline.representatives(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4, bucket)
    return made.select("o_custkey", "o_orderkey")


def _samples(spark, folder):
    minutes = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(60.0)
    return fx.load(spark, folder, "events").select(
        F.col("user_id").alias("asset_id"),
        F.col("event_type").alias("track_key"),
        minutes.alias("time_seconds"),
        F.col("event_id").alias("frame_order"),
        F.lit(30.0).alias("frame_span"),
    )


@query(
    "observation_windows",
    """
WITH s AS (SELECT user_id AS asset_id, event_type AS track_key, event_id,
                  (floor(epoch(ts))::BIGINT - 1704067200) / 60.0::DOUBLE AS t FROM events),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY asset_id, track_key ORDER BY t, event_id) > 120 THEN 1 ELSE 0 END AS brk FROM s),
w AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY asset_id, track_key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS window_no FROM b),
g AS (SELECT asset_id, track_key, window_no::BIGINT AS window_no, min(t) AS start_seconds, max(t) + 30 AS end_seconds,
             count(*) AS sample_count FROM w GROUP BY asset_id, track_key, window_no)
SELECT asset_id, track_key, window_no,
       CASE WHEN max(window_no) OVER (PARTITION BY asset_id, track_key) > 1
            THEN track_key || ':span-' || window_no ELSE track_key END AS group_key,
       round(start_seconds, 6) AS start_seconds, round(end_seconds, 6) AS end_seconds, sample_count FROM g
""",
)
def observation_windows(spark, folder):
    made = timeline.observation_windows(_samples(spark, folder))
    return made.withColumns(
        {c: F.round(c, 6) for c in ("start_seconds", "end_seconds")}
    )


@query(
    "window_sound_type",
    with_views(
        "window_labels",
        body="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, slice_pos ORDER BY coalesce(confidence, 1.0) DESC, item_pos) AS i
      FROM window_labels WHERE confidence IS NULL OR confidence >= 0.45)
SELECT asset_id, slice_pos, lower(trim(label)) AS sound_type, lower(trim(label)) IN ('moan', 'speech') AS is_voice
FROM r WHERE i = 1""",
    ),
)
def window_sound_type(spark, folder):
    return timeline.window_sound_type(fx.window_labels(spark, folder))


@query(
    "artifact_counts",
    with_views(
        "frames",
        "frame_tags",
        "window_vectors",
        body="""
WITH every AS (SELECT asset_id, 'slices' AS artifact FROM frames
  UNION ALL SELECT asset_id, 'predictions' FROM frame_tags UNION ALL SELECT asset_id, 'embeddings' FROM window_vectors)
SELECT asset_id, artifact, count(*) AS row_count FROM every GROUP BY ALL""",
    ),
)
def artifact_counts(spark, folder):
    tables = {
        "slices": fx.frames(spark, folder),
        "predictions": fx.frame_tags(spark, folder),
        "embeddings": fx.window_vectors(spark, folder),
    }
    return timeline.artifact_counts(tables)


@query(
    "first_wins",
    """
WITH t AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END) AS source_tag,
                  p_type AS target_tag FROM part)
SELECT arg_min(source_tag, p_partkey) AS source_tag, arg_min(target_tag, p_partkey) AS target_tag, min(p_partkey) AS p_partkey
FROM t WHERE source_tag <> '' GROUP BY lower(source_tag)
""",
)
def first_wins(spark, folder):
    part = fx.load(spark, folder, "part")
    even = F.col("p_partkey") % 2 == 0
    table = part.select(
        "p_partkey",
        F.when(even, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("source_tag"),
        F.col("p_type").alias("target_tag"),
    )
    return tags.first_wins(table, ["source_tag"], [F.col("p_partkey")])


def _prefixes(spark, folder):
    pages = fx.load(spark, folder, "pages")
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    branch = F.regexp_extract("url", r"^(https?://[^/]+/[^/?#]+)", 1)
    first = pages.select(
        F.upper(site).alias("from_prefix"),
        F.concat(F.lit("/mnt/"), F.regexp_replace(site, "^https?://", "")).alias("to_prefix"),
    )
    second = pages.select(
        F.replace(branch, F.lit("/"), F.lit("\\")).alias("from_prefix"),
        F.concat(F.lit("Z:\\media\\"), F.regexp_replace(branch, "^.*/", "")).alias("to_prefix"),
    )
    return first.union(second).distinct().withColumn("prefix_pos", F.lit(0))


@query(
    "map_paths",
    r"""
WITH p AS (SELECT DISTINCT upper(regexp_extract(url, '^(https?://[^/]+)', 1)) AS f,
                  '/mnt/' || regexp_replace(regexp_extract(url, '^(https?://[^/]+)', 1), '^https?://', '') AS t FROM pages
     UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/?#]+)', 1),
           'Z:\media\' || regexp_replace(regexp_extract(url, '^(https?://[^/]+/[^/?#]+)', 1), '^.*/', '') FROM pages),
m AS (SELECT page_id, url, f, t, row_number() OVER (PARTITION BY page_id ORDER BY length(f) DESC) AS i
      FROM pages JOIN p ON f <> '' AND starts_with(lower(url), lower(f))
       AND (length(url) = length(f) OR f LIKE '%/' OR substr(url, length(f) + 1, 1) = '/')),
b AS (SELECT page_id, t, ltrim(substr(url, length(f) + 1), '/') AS suffix FROM m WHERE i = 1)
SELECT page_id AS path_id, url AS path,
  CASE WHEN t IS NULL THEN url WHEN suffix = '' THEN t WHEN contains(t, '\') THEN t || '\' || replace(suffix, '/', '\')
       ELSE t || '/' || suffix END AS mapped_path
FROM pages LEFT JOIN b USING (page_id)
""",
)
def map_paths(spark, folder):
    pages = fx.load(spark, folder, "pages").select(
        F.col("page_id").alias("path_id"), F.col("url").alias("path")
    )
    return paths.map_paths(pages, _prefixes(spark, folder))


@query(
    "resolve_targets",
    r"""
WITH files AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'video' ELSE 'image' END AS entity_type, l_orderkey AS entity_id,
    'D:media\' || l_suppkey || '\f' || l_partkey || '.mp4' AS path, l_quantity AS duration, l_linenumber AS width, l_quantity AS height
  FROM lineitem),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY
    CASE WHEN entity_type = 'video' THEN duration ELSE width * height END DESC, lower(path), path) AS i FROM files) WHERE i = 1),
every AS (SELECT 1 AS g, o_orderkey AS pos, entity_type || ':' || entity_id AS unit_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'file ' || o_orderkey
         ELSE regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1) END AS label,
    regexp_replace(replace(path, '\', '/'), '^([A-Za-z]:)([^/])', '\1/\2') AS path, entity_id, entity_type
  FROM orders JOIN best ON entity_id = o_orderkey
  UNION ALL SELECT 0, p_partkey, 'path:d:/MEDIA/' || p_size || '/f' || p_partkey || '.mp4', 'f' || p_partkey || '.mp4',
    'd:/MEDIA/' || p_size || '/f' || p_partkey || '.mp4', NULL, NULL FROM part)
SELECT unit_id, label, path, entity_id, entity_type, pos AS request_pos FROM
  (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY g, pos) AS i FROM every) WHERE i = 1
""",
)
def resolve_targets(spark, folder):
    kind = F.when(F.col("l_orderkey") % 2 == 0, "video").otherwise("image")
    lines = fx.load(spark, folder, "lineitem")
    orders = fx.load(spark, folder, "orders")
    low = orders.filter(F.col("o_orderpriority") == "5-LOW").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.concat(F.lit("file "), F.col("o_orderkey").cast("string")).alias("title"),
    )
    files = lines.join(low, "l_orderkey", "left").select(
        kind.alias("entity_type"),
        F.col("l_orderkey").alias("entity_id"),
        "title",
        F.concat(F.lit("D:media\\"), F.col("l_suppkey"), F.lit("\\f"), F.col("l_partkey"), F.lit(".mp4")).alias("path"),
        F.col("l_quantity").alias("duration"),
        F.col("l_linenumber").alias("width"),
        F.col("l_quantity").alias("height"),
    )
    requested = orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, "video").otherwise("image").alias("entity_type"),
        F.col("o_orderkey").alias("entity_id"),
        F.col("o_orderkey").alias("request_pos"),
    )
    explicit = fx.load(spark, folder, "part").select(
        F.concat(F.lit("d:\\MEDIA\\"), F.col("p_size"), F.lit("/f"), F.col("p_partkey"), F.lit(".mp4")).alias("path"),
        F.col("p_partkey").alias("request_pos"),
    )
    return paths.resolve_targets(files, requested, explicit)
