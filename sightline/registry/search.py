"""Vector math, nearest-neighbour search and more-like-this queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import fixtures as fx
from sightline.config import SEARCH
from sightline.fixtures import with_views
from sightline.functions.vectors import cosine, l2norm, normalize
from sightline.operators import search, similar
from sightline.operators.centroids import centroid
from sightline.operators.grams import TextIndex
from sightline.operators.ivf import VectorIndex
from sightline.operators.knn import nearest, nearest_of_groups
from sightline.registry.base import query
from sightline.session import scratch_dir

_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(
    "vector_functions",
    f"""
WITH m AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label),
p AS (SELECT e.vec_id, e.embedding AS a, f.embedding AS b FROM embeddings e JOIN m USING (label)
      JOIN embeddings f ON f.vec_id = m.first)
SELECT vec_id, round({_cos('a', 'b')}, 6) AS raw_cosine,
       round(least(1.0, greatest(0.0, {_cos('a', 'b')})), 6) AS unit_cosine,
       round(least(1.0, greatest(-1.0, {_cos('a', 'b')})), 6) AS signed_cosine,
       round({_DOT.format(a='a', b='b')}, 6) AS dot,
       round(sqrt({_DOT.format(a='a', b='a')}), 6) AS norm,
       round(a[1]::DOUBLE / sqrt({_DOT.format(a='a', b='a')}), 6) AS unit_head FROM p
""",
)
def vector_functions(spark, folder):
    """Each vector against the first of its label, in all clamp modes."""
    vectors = fx.load(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    pairs = vectors.join(first, "label")
    return pairs.select(
        "vec_id",
        *[
            F.round(cosine("embedding", "first", mode), 6).alias(name)
            for mode, name in (
                ("raw", "raw_cosine"),
                ("unit", "unit_cosine"),
                ("signed", "signed_cosine"),
                ("dot", "dot"),
            )
        ],
        F.round(l2norm("embedding"), 6).alias("norm"),
        F.round(normalize("embedding")[0].cast("double"), 6).alias("unit_head"),
    )


_MEANS = """
elements AS (SELECT {key} AS k, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector)::DOUBLE AS x, {weight} AS w FROM {source}),
means AS (SELECT k, pos, sum(x * w) / sum(w) AS x FROM elements GROUP BY k, pos),
norms AS (SELECT k, sqrt(sum(x * x)) AS norm FROM means GROUP BY k)
"""


@query(
    "mean_centroid",
    with_views(
        "embeddings_view",
        body="WITH " + _MEANS.format(key="label", weight="1.0", source="embeddings_view") + """
SELECT k AS label, pos, round(x / norm, 5) AS x, round(norm, 5) AS norm FROM means JOIN norms USING (k)""",
    ),
)
def mean_centroid(spark, folder):
    made = centroid(fx.embeddings_view(spark, folder), ["label"])
    return made.select("label", F.posexplode("vector").alias("pos", "x"), "norm").select(
        "label", "pos", F.round(F.col("x").cast("double"), 5).alias("x"), F.round("norm", 5).alias("norm")
    )


@query(
    "weighted_centroid",
    with_views(
        "embeddings_view",
        body="WITH "
        + _MEANS.format(key="host_id", weight="(1.0 + section_index)", source="embeddings_view")
        + """
SELECT k AS host_id, pos, round(x / norm, 5) AS x, 1.0 AS norm FROM means JOIN norms USING (k)""",
    ),
)
def weighted_centroid(spark, folder):
    """Visual rule: the norm is that of the returned unit vector."""
    made = centroid(
        fx.embeddings_view(spark, folder),
        ["host_id"],
        weight=F.lit(1.0) + F.col("section_index"),
        norm_rule="after",
    )
    return made.select("host_id", F.posexplode("vector").alias("pos", "x"), "norm").select(
        "host_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"), F.round("norm", 4).alias("norm")
    )


# Whole-asset vectors of every host as queries over every stored vector.
_ASKED_SQL = """
asked AS (SELECT embedding_id AS query_id, host_id AS asset_id, kind, vector FROM embeddings_view WHERE section_index = 0),
found AS (SELECT q.query_id, q.asset_id, e.embedding_id, e.host_id, e.section_index, e.start_seconds,
                 round(1 - list_cosine_similarity(q.vector::DOUBLE[], e.vector::DOUBLE[]), 9) AS distance
          FROM asked q JOIN embeddings_view e ON q.kind = e.kind),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, embedding_id) AS rank FROM found)
"""


def _asked(spark, folder):
    view = fx.embeddings_view(spark, folder)
    return view.filter(F.col("section_index") == 0).select(
        F.col("embedding_id").alias("query_id"), F.col("host_id").alias("asset_id"), *similar.MATCH_ON, "vector"
    )


def _matches(spark, folder, k):
    return nearest(
        _asked(spark, folder),
        fx.embeddings_view(spark, folder),
        k,
        match_on=similar.MATCH_ON,
        keep=["host_id", "section_index", "start_seconds"],
    )


@query(
    "knn",
    with_views(
        "embeddings_view",
        body="WITH " + _ASKED_SQL + """
SELECT query_id, embedding_id, host_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 20""",
    ),
)
def knn(spark, folder):
    found = _matches(spark, folder, 20)
    return found.select(
        "query_id",
        "embedding_id",
        "host_id",
        F.round("distance", 6).alias("distance"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def _index(spark, folder):
    view = fx.embeddings_view(spark, folder)
    return VectorIndex.build(view, scratch_dir(spark, "vectors"), match_on=similar.MATCH_ON, keep=["host_id"])


@query(
    "knn_exact_index",
    with_views(
        "embeddings_view",
        body="WITH " + _ASKED_SQL + """
SELECT query_id, embedding_id, host_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 20""",
    ),
)
def knn_exact_index(spark, folder):
    """The rows of ``knn`` through the index, rings beyond each query's bound skipped."""
    found = _index(spark, folder).exact(_asked(spark, folder), 20)
    return found.select(
        "query_id", "embedding_id", "host_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


@query("knn_probed_index")
def knn_probed_index(spark, folder):
    """Approximate: each query's best 20 among its nearest cells (a quarter of them), with the share of rows compared.

    No SQL states which cells the fitted centroids make; tests measure recall.
    """
    index = _index(spark, folder)
    asked = _asked(spark, folder)
    probes = max(1, len(index.rings["cell"].unique()) // 4)
    read = index.reads(asked, probes=probes).select("query_id", F.round(F.col("rows") / F.col("all_rows"), 6).alias("share_read"))
    return index.approximate(asked, 20, probes).join(read, "query_id")


_BEST_SQL = _ASKED_SQL + """,
limited AS (SELECT * FROM ranked WHERE rank <= 2000),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host_id
           ORDER BY distance, section_index, start_seconds NULLS LAST, embedding_id) AS i FROM limited) WHERE i = 1)
"""


def _best(spark, folder, most=None):
    """The best match of each host among a query's neighbours, ``most`` hosts a query where given."""
    return nearest_of_groups(
        _asked(spark, folder),
        fx.embeddings_view(spark, folder),
        SEARCH.knn_limit,
        group="host_id",
        tie=["section_index", "start_seconds"],
        most=most,
        match_on=similar.MATCH_ON,
    )


@query(
    "best_per_host",
    with_views(
        "embeddings_view",
        body="WITH " + _BEST_SQL + "SELECT query_id, host_id, embedding_id, round(distance, 6) AS distance FROM best",
    ),
)
def best_per_host(spark, folder):
    return _best(spark, folder).select("query_id", "host_id", "embedding_id", F.round("distance", 6).alias("distance"))


_CUT_SQL = _BEST_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, host_id) AS visual_rank,
                  min(distance) OVER (PARTITION BY query_id) AS top FROM best),
cut AS (SELECT * FROM placed WHERE visual_rank <= 500 AND (visual_rank <= 5 OR distance <= round(top + 0.03, 9)))
"""


def _cut(spark, folder):
    return search.candidate_cutoff(_best(spark, folder, SEARCH.maximum_results))


@query(
    "candidate_cutoff",
    with_views(
        "embeddings_view",
        body="WITH " + _CUT_SQL + "SELECT query_id, host_id, visual_rank, round(distance, 6) AS distance FROM cut",
    ),
)
def candidate_cutoff(spark, folder):
    return _cut(spark, folder).select(
        "query_id",
        "host_id",
        F.col("visual_rank").cast("bigint").alias("visual_rank"),
        F.round("distance", 6).alias("distance"),
    )


@query(
    "nearest_hosts",
    with_views(
        "embeddings_view",
        "hosts",
        body="WITH " + _CUT_SQL + """,
ordered AS (SELECT query_id, host_id, title, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, host_id) AS sort_rank,
                   count(*) OVER (PARTITION BY query_id) AS total_count FROM cut JOIN hosts USING (host_id))
SELECT query_id, host_id, title, sort_rank, round(distance, 6) AS distance, total_count FROM ordered WHERE sort_rank <= 40""",
    ),
)
def nearest_hosts(spark, folder):
    """The search path: neighbours, best per host, cutoff, order, page."""
    ranked = search.sort_matches(_cut(spark, folder), fx.hosts(spark, folder), None, False)
    paged = search.page(ranked, 1, None)
    return paged.select(
        "query_id",
        "host_id",
        "title",
        F.col("sort_rank").cast("bigint").alias("sort_rank"),
        F.round("distance", 6).alias("distance"),
        "total_count",
    )


@query(
    "allow_list",
    with_views(
        "embeddings_view",
        "hosts",
        body="WITH " + _BEST_SQL + """
SELECT query_id, host_id, round(distance, 6) AS distance FROM best
WHERE host_id IN (SELECT host_id FROM hosts WHERE organized)""",
    ),
)
def allow_list(spark, folder):
    allowed = search.allow(_best(spark, folder), fx.hosts(spark, folder).filter("organized"))
    return allowed.select("query_id", "host_id", F.round("distance", 6).alias("distance"))


@query(
    "has_embeddings",
    with_views(
        "embeddings_view",
        body="""
SELECT host_type, host_id FROM (SELECT p_partkey AS host_id, unnest(['video', 'image']) AS host_type FROM part) h
WHERE EXISTS (SELECT 1 FROM embeddings_view e WHERE e.host_id = h.host_id AND e.host_type = h.host_type)""",
    ),
)
def has_embeddings(spark, folder):
    kinds = F.explode(F.array(F.lit("video"), F.lit("image"))).alias("host_type")
    hosts = fx.load(spark, folder, "part").select(F.col("p_partkey").alias("host_id"), kinds)
    found = search.has_embeddings(hosts, fx.embeddings_view(spark, folder), "visual", "visual")
    return found.select("host_type", "host_id")


@query(
    "dimension_audit",
    with_views(
        "embeddings_view",
        body="""
SELECT kind, kind_family, modality, is_semantic, len(vector) AS dimension, count(*) AS row_count
FROM embeddings_view GROUP BY ALL""",
    ),
)
def dimension_audit(spark, folder):
    audit = search.dimension_audit(fx.embeddings_view(spark, folder))
    return audit.withColumn("dimension", F.col("dimension").cast("bigint"))


def _sorted_sql(order: str) -> str:
    return with_views(
        "embeddings_view",
        "hosts",
        body="WITH " + _CUT_SQL + f"""
SELECT query_id, host_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS sort_rank
FROM cut JOIN hosts USING (host_id)""",
    )


def _sorted(spark, folder, sort, descending, seed=None):
    made = search.sort_matches(_cut(spark, folder), fx.hosts(spark, folder), sort, descending, seed=seed)
    return made.select("query_id", "host_id", F.col("sort_rank").cast("bigint").alias("sort_rank"))


@query("sort_by_title", _sorted_sql("title ASC NULLS LAST, visual_rank, host_id"))
def sort_by_title(spark, folder):
    return _sorted(spark, folder, "title", False)


@query("sort_by_duration", _sorted_sql("duration DESC NULLS LAST, visual_rank, host_id"))
def sort_by_duration(spark, folder):
    return _sorted(spark, folder, "duration", True)


@query("sort_by_update", _sorted_sql("updated_at ASC NULLS LAST, visual_rank, host_id"))
def sort_by_update(spark, folder):
    return _sorted(spark, folder, "no_such_name", False)


@query("sort_by_visual_match", _sorted_sql("distance DESC, host_id"))
def sort_by_visual_match(spark, folder):
    return _sorted(spark, folder, "visual_match", False)


def _mix_sql(identifier: str, seed: int) -> str:
    """The 32-bit mix in SQL; products fit because HUGEINT is 128 bits wide."""
    return f"""
s0 AS (SELECT {identifier} AS id, ({identifier} & 4294967295)::HUGEINT AS v FROM part),
s1 AS (SELECT id, xor(v::BIGINT, (({seed}::HUGEINT + 2654435769 + v * 64 + v // 4) % 4294967296)::BIGINT)::HUGEINT AS v FROM s0),
s2 AS (SELECT id, ((v * 2246822507) % 4294967296)::BIGINT AS v FROM s1),
s3 AS (SELECT id, xor(v, v >> 13)::HUGEINT AS v FROM s2),
s4 AS (SELECT id, ((v * 3266489909) % 4294967296)::BIGINT AS v FROM s3),
s5 AS (SELECT id, xor(v, v >> 16) AS v FROM s4)
"""


@query(
    "seeded_order",
    "WITH " + _mix_sql("p_partkey", 4242) + """
SELECT id AS host_id, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS sort_key FROM s5""",
)
def seeded_order(spark, folder):
    part = fx.load(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("host_id"), search.seeded_key("p_partkey", 4242).alias("sort_key")
    )


@query(
    "page",
    with_views(
        "embeddings_view",
        body="WITH " + _BEST_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, host_id) AS sort_rank,
                  count(*) OVER (PARTITION BY query_id) AS total_count FROM best)
SELECT query_id, host_id, sort_rank, total_count FROM placed WHERE sort_rank BETWEEN 13 AND 24""",
    ),
)
def page(spark, folder):
    """Second page of twelve, the default size of more-like-this."""
    paged = search.similar_page(_best(spark, folder).withColumnRenamed("rank", "sort_rank"), 2, 0)
    return paged.select("query_id", "host_id", F.col("sort_rank").cast("bigint").alias("sort_rank"), "total_count")


@query(
    "derive_sort_keys",
    """
WITH h AS (SELECT c_custkey AS host_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS title,
                  min(o_orderdate)::DATE AS date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
hp AS (SELECT o_custkey AS host_id, (DATE '1970-01-01' + l_suppkey::INTEGER * 37) AS birthdate
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ages AS (SELECT host_id, min(a) AS lo, max(a) AS hi FROM (SELECT host_id, year(date) - year(birthdate)
   - CASE WHEN month(date) * 100 + day(date) < month(birthdate) * 100 + day(birthdate) THEN 1 ELSE 0 END AS a
   FROM h JOIN hp USING (host_id)) GROUP BY host_id),
f AS (SELECT o_custkey AS host_id, min(nullif(o_orderstatus, 'P')) AS p0, max(nullif(o_orderstatus, 'P')) AS p1,
   min(o_orderpriority) AS b0, max(o_orderpriority) AS b1, max(o_orderdate) AS liked FROM orders GROUP BY 1)
SELECT host_id, lo::BIGINT AS performer_age_min, hi::BIGINT AS performer_age_max, p0 AS phash_min, p1 AS phash_max,
   coalesce(nullif(title, ' '), b0) AS display_title_min, coalesce(nullif(title, ' '), b1) AS display_title_max,
   strftime(liked, '%Y-%m-%d') AS last_like_at
FROM h LEFT JOIN ages USING (host_id) LEFT JOIN f USING (host_id)
""",
)
def derive_sort_keys(spark, folder):
    customers = fx.load(spark, folder, "customer")
    orders = fx.load(spark, folder, "orders")
    lines = fx.load(spark, folder, "lineitem")
    dated = orders.groupBy(F.col("o_custkey").alias("host_id")).agg(
        F.min("o_orderdate").cast("date").alias("date")
    )
    hosts = customers.select(
        F.col("c_custkey").alias("host_id"),
        F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("title"),
    ).join(dated, "host_id", "left")
    born = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("l_suppkey") * 37).cast("int"))
    performers = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("host_id"), born.alias("birthdate")
    )
    files = orders.select(
        F.col("o_custkey").alias("host_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("phash"),
        F.col("o_orderpriority").alias("basename"),
        F.col("o_orderpriority").alias("path"),
    )
    likes = orders.select(F.col("o_custkey").alias("host_id"), F.col("o_orderdate").alias("occurred_at"))
    made = search.derive_sort_keys(hosts, performers, files, likes)
    return made.select(
        "host_id",
        F.col("performer_age_min").cast("bigint").alias("performer_age_min"),
        F.col("performer_age_max").cast("bigint").alias("performer_age_max"),
        "phash_min",
        "phash_max",
        "display_title_min",
        "display_title_max",
        F.date_format("last_like_at", "yyyy-MM-dd").alias("last_like_at"),
    )


# Images take the numbers of videos here, so that only the type tells them apart.
_QUERIES_SQL = """
v AS (SELECT * REPLACE (CASE WHEN host_type = 'image' THEN host_id - 1 ELSE host_id END AS host_id) FROM embeddings_view),
sections AS (SELECT *, row_number() OVER (PARTITION BY host_type, host_id, is_semantic
        ORDER BY start_seconds NULLS LAST, section_index, embedding_id) - 1 AS i,
        count(*) OVER (PARTITION BY host_type, host_id, is_semantic) AS n
   FROM v WHERE host_type = 'video' AND section_index > 0),
parts AS (SELECT *, row_number() OVER (PARTITION BY host_type, host_id, is_semantic ORDER BY i) AS turn FROM sections
   WHERE n <= 4 OR list_contains([round_even(k * ((n - 1) / 3.0::DOUBLE), 0)::BIGINT FOR k IN range(4)], i)),
asked AS (
  SELECT host_id AS asset_id, host_type, CASE WHEN is_semantic THEN 1 ELSE 0 END AS query_pos,
     CASE WHEN is_semantic THEN 'overall_semantic' ELSE 'overall_visual' END AS role,
     (CASE WHEN is_semantic THEN 0.42 ELSE 1.0 END)::DOUBLE AS weight, 'asset' AS scope, kind, vector FROM v WHERE section_index = 0
  UNION ALL SELECT host_id, host_type, CASE WHEN is_semantic THEN 5 + turn ELSE 1 + turn END,
     CASE WHEN is_semantic THEN 'part_semantic' ELSE 'part_visual' END,
     (CASE WHEN is_semantic THEN 0.25 ELSE 0.7 END)::DOUBLE, 'section', kind, vector FROM parts)
"""


@query(
    "asset_queries",
    with_views(
        "embeddings_view",
        body="WITH " + _QUERIES_SQL + """
SELECT host_type AS asset_type, asset_id, query_pos::BIGINT AS query_pos, role, weight, scope, kind, round(vector[1]::DOUBLE, 6) AS head FROM asked""",
    ),
)
def asset_queries(spark, folder):
    view = _shared_ids(spark, folder)
    made = similar.asset_queries(view, view.select("host_type", "host_id").distinct())
    return made.select(
        "asset_type",
        "asset_id",
        "query_pos",
        "role",
        "weight",
        "scope",
        "kind",
        F.round(F.col("vector")[0].cast("double"), 6).alias("head"),
    )


def _shared_ids(spark, folder):
    image = F.col("host_type") == "image"
    number = F.when(image, F.col("host_id") - 1).otherwise(F.col("host_id"))
    return fx.embeddings_view(spark, folder).withColumn("host_id", number)


def _blend_sql(asked: str, host: str = "video") -> str:
    return asked + """,
found AS (SELECT q.host_type AS asset_type, q.asset_id, q.query_pos, q.role, q.weight, q.scope, e.embedding_id, e.host_id, e.section_index, e.start_seconds,
     round(1 - list_cosine_similarity(q.vector::DOUBLE[], e.vector::DOUBLE[]), 9) AS distance
   FROM asked q JOIN v e ON q.kind = e.kind AND e.host_type = 'video'),
limited AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id, query_pos ORDER BY distance, embedding_id) AS r FROM found) WHERE r <= 2000),
scoped AS (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id, query_pos, host_id
      ORDER BY distance, section_index, start_seconds NULLS LAST, embedding_id) AS i FROM limited
   WHERE (host_id <> asset_id OR asset_type <> 'video') AND CASE scope WHEN 'asset' THEN section_index = 0 ELSE section_index > 0 END),
hits AS (SELECT *, greatest(-1.0, least(1.0, 1 - distance)) * weight AS ws FROM scoped WHERE i = 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id, host_id ORDER BY ws DESC, query_pos) AS t FROM hits),
blended AS (SELECT asset_type, asset_id, host_id,
     round(greatest(0.0, least(2.0, 1 - sum(ws) / sum(weight) - least(0.04, 0.012 * (count(DISTINCT role) - 1)))), 9) AS distance,
     count(DISTINCT role) AS role_count, max(embedding_id) FILTER (t = 1) AS embedding_id, max(role) FILTER (t = 1) AS role
   FROM tops GROUP BY asset_type, asset_id, host_id)
""".replace("'video'", f"'{host}'")


def _blended(spark, folder, most=None):
    view = _shared_ids(spark, folder)
    asked = similar.asset_queries(view, view.select("host_type", "host_id").distinct())
    return similar.similar_hosts(asked, view, most=most)


@query(
    "blend_visual",
    with_views(
        "embeddings_view",
        body="WITH " + _blend_sql(_QUERIES_SQL) + """
SELECT asset_type, asset_id, host_id, round(distance, 6) AS distance, role_count, embedding_id, role FROM blended""",
    ),
)
def blend_visual(spark, folder):
    return _blended(spark, folder).select(
        "asset_type", "asset_id", "host_id", F.round("distance", 6).alias("distance"), "role_count", "embedding_id", "role"
    )


@query(
    "diversified_similar",
    with_views(
        "embeddings_view",
        body="WITH " + _blend_sql(_QUERIES_SQL) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id ORDER BY distance, host_id) AS r FROM blended),
turns AS (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id, r <= 2, role ORDER BY distance, host_id) AS turn FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY asset_type, asset_id ORDER BY CASE WHEN r <= 2 THEN r ELSE 1000000 END, turn,
   CASE role WHEN 'part_visual' THEN 0 WHEN 'overall_visual' THEN 1 WHEN 'overall_semantic' THEN 2 ELSE 3 END) AS position FROM turns)
SELECT asset_type, asset_id, host_id, role, position FROM placed WHERE position <= 500""",
    ),
)
def diversified_similar(spark, folder):
    # A position within the limit needs no turn beyond it; two of a role may stand in front.
    placed = similar.diversify(_blended(spark, folder, SEARCH.maximum_results + 2))
    return placed.select("asset_type", "asset_id", "host_id", "role", F.col("position").cast("bigint").alias("position"))


_RANGES_SQL = """
ranges AS (SELECT host_id AS asset_id, unnest([2.0, 3.0, 25.0]) AS s, unnest([3.5, 8.0, 38.0]) AS e FROM embeddings_view
           WHERE host_type = 'video' AND host_id % 2 = 0 GROUP BY host_id
           UNION ALL SELECT host_id, 55.0, 55.0 FROM embeddings_view WHERE host_type = 'video' AND host_id % 2 = 1 GROUP BY host_id),
m AS (SELECT asset_id, 0 AS part, s, e FROM (SELECT asset_id, 2.0 AS s, 8.0 AS e FROM ranges WHERE s = 2.0
        UNION ALL SELECT asset_id, s, e FROM ranges WHERE s > 20)),
p AS (SELECT * FROM m UNION ALL SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY s), s, e FROM m WHERE asset_id % 2 = 0),
sec AS (SELECT host_id AS asset_id, embedding_id, kind, is_semantic, section_index, start_seconds AS a, end_seconds AS b, vector
        FROM embeddings_view WHERE host_type = 'video' AND section_index > 0),
w AS (SELECT p.asset_id, p.part, embedding_id, kind, is_semantic, vector,
        sum(CASE WHEN e > s THEN greatest(0.0, least(b, e) - greatest(a, s)) WHEN s BETWEEN a AND b THEN 1.0 ELSE 0.0 END) AS weight
      FROM p JOIN sec USING (asset_id) GROUP BY ALL HAVING sum(CASE WHEN e > s THEN greatest(0.0, least(b, e) - greatest(a, s)) WHEN s BETWEEN a AND b THEN 1.0 ELSE 0.0 END) > 0),
x AS (SELECT asset_id, part, kind, is_semantic, generate_subscripts(vector, 1) AS pos, unnest(vector)::DOUBLE AS x, weight FROM w),
mean AS (SELECT asset_id, part, kind, is_semantic, pos, sum(x * weight) / sum(weight) AS x FROM x GROUP BY ALL),
mids AS (SELECT asset_id, part, arg_min((s + e) / 2, s) AS mid FROM p GROUP BY ALL),
near AS (SELECT asset_id, part, kind, is_semantic, vector, row_number() OVER (PARTITION BY asset_id, part, kind
          ORDER BY CASE WHEN mid BETWEEN a AND b THEN 0.0 WHEN mid < a THEN a - mid ELSE mid - b END, section_index, embedding_id) AS i
        FROM mids JOIN sec USING (asset_id)),
asked AS (SELECT asset_id, part, is_semantic, x AS head FROM mean WHERE pos = 1
   UNION ALL SELECT asset_id, part, is_semantic, vector[1]::DOUBLE FROM near n WHERE i = 1 AND NOT EXISTS
     (SELECT 1 FROM mean m WHERE m.asset_id = n.asset_id AND m.part = n.part AND m.kind = n.kind))
"""


@query(
    "segment_queries",
    with_views(
        "embeddings_view",
        body="WITH " + _RANGES_SQL + """
SELECT asset_id, (part * 2 + CASE WHEN is_semantic THEN 1 ELSE 0 END)::BIGINT AS query_pos,
  CASE WHEN is_semantic THEN 'part_semantic' ELSE 'part_visual' END AS role,
  (CASE WHEN part > 0 THEN CASE WHEN is_semantic THEN 0.25 ELSE 0.7 END ELSE CASE WHEN is_semantic THEN 0.42 ELSE 1.0 END END)::DOUBLE AS weight,
  round(head, 5) AS head FROM asked""",
    ),
)
def segment_queries(spark, folder):
    view = fx.embeddings_view(spark, folder)
    made = similar.segment_queries(view, _ranges(view))
    return made.select(
        "asset_id", "query_pos", "role", "weight", F.round(F.col("vector")[0].cast("double"), 5).alias("head")
    )


def _ranges(view):
    """Several ranges for even hosts, one range past the end for odd ones."""
    videos = view.filter(F.col("host_type") == "video").select(F.col("host_id").alias("asset_id")).distinct()

    def span(start, end):
        return F.struct(F.lit(start).alias("start_seconds"), F.lit(end).alias("end_seconds"))

    several = F.array(span(2.0, 3.5), span(3.0, 8.0), span(25.0, 38.0))
    one = F.array(span(55.0, 55.0))
    chosen = F.when(F.col("asset_id") % 2 == 0, several).otherwise(one)
    return videos.select("asset_id", F.explode(chosen).alias("r")).select("asset_id", "r.*")


_SEGMENT_SQL = _RANGES_SQL.replace("\nasked AS (", "\nheads AS (") + """,
v AS (SELECT * FROM embeddings_view),
vectors AS (SELECT asset_id, part, kind, is_semantic, list(x ORDER BY pos) AS vector FROM mean GROUP BY ALL
   UNION ALL SELECT asset_id, part, kind, is_semantic, vector::DOUBLE[] FROM near n WHERE i = 1 AND NOT EXISTS
     (SELECT 1 FROM mean m WHERE m.asset_id = n.asset_id AND m.part = n.part AND m.kind = n.kind)),
asked AS (SELECT 'video' AS host_type, asset_id, part * 2 + CASE WHEN is_semantic THEN 1 ELSE 0 END AS query_pos,
   CASE WHEN is_semantic THEN 'part_semantic' ELSE 'part_visual' END AS role,
   (CASE WHEN part > 0 THEN CASE WHEN is_semantic THEN 0.25 ELSE 0.7 END ELSE CASE WHEN is_semantic THEN 0.42 ELSE 1.0 END END)::DOUBLE AS weight,
   'section' AS scope, kind, vector FROM vectors)
"""


@query(
    "segment_similar",
    with_views(
        "embeddings_view",
        body="WITH " + _blend_sql(_SEGMENT_SQL) + """
SELECT asset_id, host_id, round(distance, 5) AS distance, role_count, embedding_id, role FROM blended""",
    ),
)
def segment_similar(spark, folder):
    """Videos like the chosen ranges of each video."""
    view = fx.embeddings_view(spark, folder)
    return similar.similar_hosts(similar.segment_queries(view, _ranges(view)), view).select(
        "asset_id", "host_id", F.round("distance", 5).alias("distance"), "role_count", "embedding_id", "role"
    )


@query(
    "similar_images",
    with_views(
        "embeddings_view",
        body="WITH " + _blend_sql(_QUERIES_SQL, "image") + """
SELECT asset_type, asset_id, host_id, round(distance, 6) AS distance, role_count, embedding_id, role FROM blended""",
    ),
)
def similar_images(spark, folder):
    """Images like each image and each video; only the image itself is left out."""
    view = _shared_ids(spark, folder)
    asked = similar.asset_queries(view, view.select("host_type", "host_id").distinct())
    made = similar.similar_hosts(asked, view, host_type="image")
    return made.select(
        "asset_type", "asset_id", "host_id", F.round("distance", 6).alias("distance"), "role_count", "embedding_id", "role"
    )


_AUDIO_SQL = """
audio AS (SELECT embedding_id, host_id, section_index, start_seconds, end_seconds, vector, label % 3 = 0 AS voiced
          FROM embeddings_view WHERE host_type = 'video'),
pooled AS (SELECT *, bool_or(voiced) OVER (PARTITION BY host_id) AS has_voice FROM audio WHERE section_index > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY section_index, start_seconds NULLS LAST, embedding_id) - 1 AS i,
   count(*) OVER (PARTITION BY host_id) AS n FROM pooled WHERE voiced OR NOT has_voice),
parts AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY i) AS turn FROM numbered
   WHERE n <= 4 OR list_contains([round_even(k * ((n - 1) / 3.0::DOUBLE), 0)::BIGINT FOR k IN range(4)], i)),
asked AS (SELECT host_id AS asset_id, 0 AS query_pos, 1.0::DOUBLE AS weight, true AS whole, arg_min(vector, embedding_id) AS vector
            FROM audio WHERE section_index = 0 GROUP BY host_id
          UNION ALL SELECT host_id, turn, 0.65::DOUBLE, false, vector FROM parts),
found AS (SELECT q.asset_id, q.query_pos, q.weight, e.host_id, e.embedding_id, e.section_index, e.start_seconds,
     round(1 - list_cosine_similarity(q.vector::DOUBLE[], e.vector::DOUBLE[]), 9) AS distance
   FROM asked q JOIN audio e ON q.whole = (e.section_index = 0) AND q.asset_id <> e.host_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, query_pos, host_id
   ORDER BY distance, section_index, start_seconds NULLS LAST, embedding_id) AS i FROM found) WHERE i = 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY asset_id, host_id ORDER BY distance, query_pos) AS t FROM hits),
blended AS (SELECT asset_id, host_id, round(sum(distance * weight) / sum(weight), 9) AS distance,
   max(embedding_id) FILTER (t = 1) AS embedding_id FROM tops GROUP BY asset_id, host_id)
"""


def _audio_vectors(spark, folder):
    """The vectors read as audio: every third label counts as voiced."""
    return (
        fx.embeddings_view(spark, folder)
        .withColumns(
            {
                "kind": F.lit("audio.embed.v1"),
                "kind_family": F.lit("audio.v1"),
                "modality": F.lit("audio"),
                "is_semantic": F.lit(False),
                "is_voice": F.col("label") % 3 == 0,
            }
        )
    )


@query(
    "audio_similar",
    with_views(
        "embeddings_view",
        body="WITH " + _AUDIO_SQL + """
SELECT asset_id, host_id, embedding_id, round(distance, 6) AS distance,
  row_number() OVER (PARTITION BY asset_id ORDER BY blended.distance, host_id) AS position FROM blended
QUALIFY position <= 500""",
    ),
)
def audio_similar(spark, folder):
    made = similar.audio_similar(_audio_vectors(spark, folder), fx.host_list(spark, folder))
    return made.select(
        "asset_id",
        "host_id",
        "embedding_id",
        F.round("distance", 6).alias("distance"),
        F.col("position").cast("bigint").alias("position"),
    )


_SEEDS_SQL = """
t AS (SELECT 'video' AS host_type, host_id, title, details, code, updated_at FROM hosts),
scored AS (SELECT *, least(
   CASE WHEN lower(title) = 'red widget' THEN 0 WHEN starts_with(lower(title), 'red widget') THEN 1 WHEN contains(lower(title), 'red widget') THEN 2 ELSE 100 END,
   CASE WHEN contains(lower(details), 'red widget') THEN 6 ELSE 100 END,
   CASE WHEN contains(lower(code), 'red widget') THEN 10 ELSE 100 END) AS score FROM t),
seeds AS (SELECT *, row_number() OVER (ORDER BY score, updated_at DESC, host_type, host_id) - 1 AS seed_rank FROM scored
   WHERE score < 100 QUALIFY seed_rank < 48)
"""


def _seeds(spark, folder):
    table = fx.hosts(spark, folder).withColumn("host_type", F.lit("video"))
    return search.text_seeds(table, "Red Widget ", ["title", "details", "code"])


@query(
    "text_seeds",
    with_views("hosts", body="WITH " + _SEEDS_SQL + "SELECT host_type, host_id, score, seed_rank FROM seeds"),
)
def text_seeds(spark, folder):
    return _seeds(spark, folder).select("host_type", "host_id", F.col("score").cast("int").alias("score"), "seed_rank")


@query(
    "text_seeds_index",
    with_views("hosts", body="WITH " + _SEEDS_SQL + "SELECT host_type, host_id, score, seed_rank FROM seeds"),
)
def text_seeds_index(spark, folder):
    """The seeds of ``text_seeds`` through an index of the titles' pieces."""
    hosts = fx.hosts(spark, folder).withColumn("host_type", F.lit("video"))
    index = TextIndex.build(hosts, scratch_dir(spark, "titles"), ["title", "details", "code"])
    return index.seeds("Red Widget ").select("host_type", "host_id", F.col("score").cast("int").alias("score"), "seed_rank")


@query(
    "seed_centroid",
    with_views(
        "hosts",
        "embeddings_view",
        body="WITH ws AS (SELECT 'video' AS host_type, host_id, row_number() OVER (ORDER BY updated_at DESC, host_id) - 1 AS r FROM hosts), "
        "e AS (SELECT v.vector, 1.0 / (r + 1) AS w FROM embeddings_view v JOIN ws USING (host_type, host_id) WHERE section_index = 0),"
        + _MEANS.format(key="0", weight="w", source="e")
        + "SELECT pos, round(x / norm, 5) AS x FROM means JOIN norms USING (k)",
    ),
)
def seed_centroid(spark, folder):
    """Every dated host as a seed, ranked by latest update."""
    from sightline.operators.ordered import bucketed_scan

    hosts = fx.hosts(spark, folder).withColumns({"host_type": F.lit("video"), "_all": F.lit(0)})
    days = F.datediff(F.lit("2030-01-01").cast("date"), F.col("updated_at").cast("date"))
    ranked = bucketed_scan(
        hosts, ["_all"], F.floor(days / 30).cast("bigint"), [F.desc("updated_at"), F.col("host_id")], rank="_rank"
    )
    seeds = ranked.select("host_type", "host_id", (F.col("_rank") - 1).alias("seed_rank"))
    made = search.seed_centroid(seeds, fx.embeddings_view(spark, folder))
    return made.select(F.posexplode("vector").alias("pos", "x")).select(
        "pos", F.round(F.col("x").cast("double"), 5).alias("x")
    )


@query(
    "enrich",
    with_views(
        "embeddings_view",
        "hosts",
        body="WITH " + _CUT_SQL + """,
tags AS (SELECT l_partkey AS host_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1),
perf AS (SELECT l_partkey AS host_id, count(DISTINCT l_suppkey) AS performers FROM lineitem GROUP BY 1),
grp AS (SELECT l_partkey AS host_id, count(DISTINCT l_linenumber) AS groups FROM lineitem GROUP BY 1)
SELECT query_id, host_id, title, tags, performers, groups FROM cut JOIN hosts USING (host_id)
LEFT JOIN tags USING (host_id) LEFT JOIN perf USING (host_id) LEFT JOIN grp USING (host_id)""",
    ),
)
def enrich(spark, folder):
    lines = fx.load(spark, folder, "lineitem").withColumnRenamed("l_partkey", "host_id")
    tags = lines.select("host_id", F.col("l_returnflag").alias("tag"), F.col("l_returnflag").alias("tag_id"))
    people = lines.select(
        "host_id",
        F.col("l_suppkey").alias("performer_id"),
        F.col("l_suppkey").cast("string").alias("performer_name"),
    )
    groups = lines.select(
        "host_id",
        F.col("l_linenumber").alias("order_index"),
        F.col("l_linenumber").alias("group_id"),
        F.col("l_linenumber").cast("string").alias("group_name"),
    )
    made = search.enrich(_cut(spark, folder), fx.hosts(spark, folder), tags, people, groups)
    return made.select(
        "query_id",
        "host_id",
        "title",
        F.array_join(F.transform("tags", lambda t: t["tag"]), ",").alias("tags"),
        F.size("performers").cast("bigint").alias("performers"),
        F.size("groups").cast("bigint").alias("groups"),
    )
