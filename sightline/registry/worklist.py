"""Reprocessing worklist and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import fixtures as fx
from sightline.operators import worklist
from sightline.registry.base import query
from sightline.sources import sinks

_RUNS_SQL = """
models AS (SELECT l_orderkey AS run_id, l_linenumber AS line, l_suppkey AS supp, 'm' || p_size AS model_key,
     1 + l_linenumber % 3 AS version, CASE WHEN l_tax > 0 THEN 1 + l_suppkey % 4 END AS identifier,
     CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_brand END AS category,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
   FROM lineitem JOIN part ON p_partkey = l_partkey),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS host_id, o_orderdate AS completed_at,
     CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
     'claim-' || substr(o_orderpriority, 1, 1) AS claim, 0.5::DOUBLE * (1 + o_orderkey % 4) AS frame_interval,
     CASE WHEN o_orderkey % 3 > 0 THEN 0.25::DOUBLE * (o_orderkey % 3) END AS threshold FROM orders),
wants AS (SELECT c_custkey AS want_id, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey END AS host_id,
     CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS frame_interval, 0.25::DOUBLE AS threshold,
     c_mktsegment = 'MACHINERY' AS forced, c_nationkey % 2 = 0 AS allow_partial, c_nationkey FROM customer),
wm AS (SELECT want_id, 0 AS model_pos, 'w' || c_nationkey AS model_key, 2 AS version, 2 AS identifier, 'BRAND#' || (1 + c_nationkey % 25) AS slot FROM wants
   UNION ALL SELECT want_id, 0, 'w' || c_nationkey, 2, 2, 'Brand#' || (1 + (c_nationkey + 7) % 25) FROM wants
   UNION ALL SELECT want_id, 1, 'm' || (1 + want_id % 50), 3, NULL, 'm' || (1 + want_id % 50) FROM wants),
prior AS (SELECT w.want_id, wm.model_pos, lower(wm.slot) AS slot_key, r.run_id, m.model_key, m.version, m.identifier, m.category,
     r.frame_interval, r.threshold,
     row_number() OVER (PARTITION BY w.want_id, wm.model_pos, lower(wm.slot) ORDER BY r.completed_at DESC, r.run_id, m.pos) AS i
   FROM wm JOIN wants w USING (want_id) JOIN runs r ON r.host_id = w.host_id AND r.status = 'completed' AND r.claim IN ('claim-1', 'claim-2', 'claim-3')
   JOIN models m ON m.run_id = r.run_id AND lower(coalesce(m.category, m.model_key)) = lower(wm.slot) QUALIFY i = 1),
slots AS (SELECT wm.want_id, wm.model_pos, wm.model_key AS wanted, wm.slot, wm.version AS v, wm.identifier AS id, w.frame_interval AS wf, w.threshold AS wt,
     w.forced, p.run_id, p.model_key, p.version, p.identifier, p.category, p.frame_interval AS pf, p.threshold AS pt
   FROM wm JOIN wants w USING (want_id) LEFT JOIN prior p ON p.want_id = wm.want_id AND p.model_pos = wm.model_pos AND p.slot_key = lower(wm.slot))
"""


def _models(spark, folder):
    lines = fx.load(spark, folder, "lineitem").join(
        fx.load(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey")
    )
    economy = F.col("p_type") == "ECONOMY"
    none = F.array().cast("array<string>")
    model = F.struct(
        F.col("l_linenumber").alias("pos"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.concat(F.lit("m"), F.col("p_size")).alias("model_key"),
        F.when(F.col("l_tax") > 0, (1 + F.col("l_suppkey") % 4).cast("int")).alias("identifier"),
        (1 + F.col("l_linenumber") % 3).cast("string").alias("version"),
        F.when(economy, none).otherwise(F.array("p_brand")).alias("categories"),
    )
    kept = ("model_key", "identifier", "version", "categories")
    # An order has a handful of lines; the list is the run's model list.
    return lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(model)), lambda m: F.struct(*[m[c].alias(c) for c in kept])
        ).alias("models")
    )


def _runs(spark, folder):
    key = F.col("o_orderkey")
    runs = fx.load(spark, folder, "orders").select(
        key.alias("run_id"),
        F.lit("video").alias("host_type"),
        F.col("o_custkey").alias("host_id"),
        F.col("o_orderdate").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.array(F.concat(F.lit("claim-"), F.substring("o_orderpriority", 1, 1))).alias("claim_ids"),
        (F.lit(0.5) * (1 + key % 4)).alias("frame_interval"),
        F.when(key % 3 > 0, F.lit(0.25) * (key % 3)).alias("threshold"),
    )
    return runs.join(_models(spark, folder), "run_id")


def _wants(spark, folder):
    nation = F.col("c_nationkey")

    def model(key, identifier, version, categories):
        return F.struct(
            key.alias("model_key"),
            identifier.cast("int").alias("identifier"),
            F.lit(version).alias("version"),
            categories.cast("array<string>").alias("categories"),
        )

    first = model(
        F.concat(F.lit("w"), nation),
        F.lit(2),
        "2",
        F.array(
            F.concat(F.lit("BRAND#"), 1 + nation % 25), F.concat(F.lit(" Brand#"), 1 + (nation + 7) % 25)
        ),
    )
    second = model(F.concat(F.lit("m"), 1 + F.col("c_custkey") % 50), F.lit(None), "3", F.array())
    return fx.load(spark, folder, "customer").select(
        F.col("c_custkey").alias("want_id"),
        F.lit("video").alias("host_type"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("host_id"),
        F.array(F.lit("CLAIM-1"), F.lit("claim-2"), F.lit("claim-3")).alias("claim_ids"),
        F.array(first, second).alias("models"),
        F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(1.5).alias("frame_interval"),
        F.lit(0.25).alias("threshold"),
        (F.col("c_mktsegment") == "MACHINERY").alias("forced"),
        (nation % 2 == 0).alias("allow_partial"),
    )


@query(
    "latest_slot_model",
    "WITH " + _RUNS_SQL + """
SELECT want_id, model_pos::BIGINT AS model_pos, slot, run_id AS prior_run_id, model_key AS prior_model_key, version AS prior_version,
  identifier AS prior_identifier, pf AS prior_interval, pt AS prior_threshold,
  CASE WHEN model_key IS NULL THEN NULL WHEN category IS NULL THEN model_key ELSE model_key || ',' || category END AS prior_keys FROM slots""",
)
def latest_slot_model(spark, folder):
    made = worklist.latest_slot_model(_runs(spark, folder), _wants(spark, folder))
    return made.select(
        "want_id",
        F.col("model_pos").cast("bigint").alias("model_pos"),
        "slot",
        "prior_run_id",
        "prior_model_key",
        F.col("prior_version").cast("bigint").alias("prior_version"),
        F.col("prior_identifier").cast("bigint").alias("prior_identifier"),
        "prior_interval",
        "prior_threshold",
        F.array_join("prior_keys", ",").alias("prior_keys"),
    )


_DECIDE_SQL = _RUNS_SQL + """,
judged AS (SELECT *, CASE WHEN forced THEN 'forced' WHEN model_key IS NULL THEN 'no_prior_run'
     WHEN v <> version THEN CASE WHEN v > version THEN 'superseded' END
     WHEN coalesce(id, 2147483647) <> coalesce(identifier, 2147483647) THEN CASE WHEN coalesce(id, 2147483647) < coalesce(identifier, 2147483647) THEN 'superseded' END
     WHEN pt IS NOT NULL AND abs(pt - wt) >= 1e-6 THEN 'threshold_differs'
     WHEN NOT (wf % pf < 1e-6 OR pf - wf % pf < 1e-6) THEN 'interval_not_covered' END AS reason FROM slots),
keyed AS (SELECT want_id, model_pos, unnest([model_key, category]) AS k FROM judged WHERE reason IS NOT NULL AND model_key IS NOT NULL),
keys AS (SELECT want_id, model_pos, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM keyed WHERE k IS NOT NULL GROUP BY 1, 2),
decisions AS (SELECT want_id, model_pos, wanted AS model_key,
    CASE WHEN count(reason) = 0 THEN 'skip' WHEN max(keys) IS NOT NULL THEN 'rerun' ELSE 'run' END AS decision,
    coalesce(max(keys), '') AS replacement_keys, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons
  FROM judged LEFT JOIN keys USING (want_id, model_pos) GROUP BY want_id, model_pos, wanted)
"""


@query("decide", "WITH " + _DECIDE_SQL + "SELECT want_id, model_pos::BIGINT AS model_pos, model_key, decision, replacement_keys, reasons FROM decisions")
def decide(spark, folder):
    wants = _wants(spark, folder)
    made = worklist.decide(worklist.latest_slot_model(_runs(spark, folder), wants), wants)
    return made.select(
        "want_id",
        F.col("model_pos").cast("bigint").alias("model_pos"),
        "model_key",
        "decision",
        F.array_join("replacement_keys", ",").alias("replacement_keys"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "plan_work",
    "WITH " + _DECIDE_SQL + """,
allkeys AS (SELECT want_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM keyed JOIN decisions USING (want_id, model_pos)
   WHERE k IS NOT NULL AND decision = 'rerun' GROUP BY 1),
why AS (SELECT want_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM judged WHERE reason IS NOT NULL GROUP BY 1),
rolled AS (SELECT want_id, string_agg(model_key, ',' ORDER BY model_pos) AS every,
   string_agg(model_key, ',' ORDER BY model_pos) FILTER (decision <> 'skip') AS due FROM decisions GROUP BY 1)
SELECT w.want_id, CASE WHEN w.host_id IS NULL THEN every WHEN due IS NULL THEN '' WHEN NOT allow_partial THEN every ELSE due END AS execution_models,
  CASE WHEN w.host_id IS NULL THEN '' ELSE coalesce(keys, '') END AS replacement_keys,
  CASE WHEN w.host_id IS NULL THEN 'run' WHEN due IS NULL THEN 'skip' WHEN keys IS NOT NULL THEN 'rerun' ELSE 'run' END AS decision,
  CASE WHEN w.host_id IS NULL THEN 'no_host' ELSE coalesce(reasons, '') END AS reasons
FROM wants w LEFT JOIN rolled USING (want_id) LEFT JOIN allkeys USING (want_id) LEFT JOIN why USING (want_id)""",
)
def plan_work(spark, folder):
    made = worklist.plan_work(_runs(spark, folder), _wants(spark, folder))
    return made.select(
        "want_id",
        F.array_join("execution_models", ",").alias("execution_models"),
        F.array_join("replacement_keys", ",").alias("replacement_keys"),
        "decision",
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "run_state",
    """
WITH e AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete'
     WHEN 'click' THEN 'fail' ELSE 'cancel' END AS event, value FROM events)
SELECT run_id, CASE arg_max(event, (ts, event_id)) WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END AS status,
  strftime(min(ts) FILTER (event = 'start'), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts) FILTER (event <> 'start'), '%Y-%m-%d %H:%M:%S') AS completed_at,
  CASE WHEN arg_max(event, (ts, event_id)) FILTER (event <> 'start') = 'complete' THEN NULL ELSE arg_max(value::VARCHAR, (ts, event_id)) FILTER (event <> 'start') END AS error,
  arg_max(value, (ts, event_id)) FILTER (event = 'start') AS frame_interval FROM e GROUP BY run_id
""",
)
def run_state(spark, folder):
    kind = F.col("event_type")
    event = (
        F.when(kind.isin("signup", "view"), "start")
        .when(kind == "purchase", "complete")
        .when(kind == "click", "fail")
        .otherwise("cancel")
    )
    journal = fx.load(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        event.alias("event"),
        F.col("ts").alias("at"),
        "event_id",
        F.col("value").alias("frame_interval"),
        F.array("event_type").alias("models"),
        F.col("value").cast("string").alias("error"),
    )
    made = worklist.run_state(journal)
    shown = "yyyy-MM-dd HH:mm:ss"
    return made.select(
        "run_id",
        "status",
        F.date_format("started_at", shown).alias("started_at"),
        F.date_format("completed_at", shown).alias("completed_at"),
        "error",
        "frame_interval",
    )


@query(
    "strip_models",
    "WITH " + _RUNS_SQL + """,
cleared AS (SELECT c_custkey AS host_id, upper('Brand#' || (1 + c_nationkey % 25)) AS k FROM customer UNION ALL SELECT c_custkey, 'M' || (1 + c_custkey % 50) FROM customer)
SELECT r.run_id, coalesce(string_agg(m.model_key, ',' ORDER BY m.pos), '') AS models FROM runs r JOIN (SELECT DISTINCT run_id FROM models) USING (run_id)
LEFT JOIN models m ON m.run_id = r.run_id AND NOT (r.status = 'completed' AND EXISTS (SELECT 1 FROM cleared c WHERE c.host_id = r.host_id
   AND lower(c.k) IN (lower(m.model_key), lower(coalesce(m.category, m.model_key)))))
GROUP BY r.run_id""",
)
def strip_models(spark, folder):
    customer = fx.load(spark, folder, "customer")
    brand = F.upper(F.concat(F.lit("Brand#"), 1 + F.col("c_nationkey") % 25))
    own = F.concat(F.lit("M"), 1 + F.col("c_custkey") % 50)
    cleared = customer.select(
        F.lit("video").alias("host_type"),
        F.col("c_custkey").alias("host_id"),
        F.explode(F.array(brand, own)).alias("model_key"),
    )
    made = worklist.strip_models(_runs(spark, folder), cleared)
    return made.select("run_id", F.array_join(F.transform("models", lambda m: m["model_key"]), ",").alias("models"))


@query(
    "best_models",
    """
WITH catalog AS (SELECT p_partkey, 'cfg-' || p_partkey AS config_name, p_name, CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_brand END AS category,
     CASE WHEN p_size % 2 = 0 THEN ['Frame', 'asset'] ELSE ['asset', 'frame', 'region'] END AS scopes, p_size % 5 = 0 AS loaded, p_size % 3 = 0 AS active FROM part),
c AS (SELECT config_name, loaded, active, lower(unnest(scopes)) AS scope, CASE WHEN category IS NULL OR category IN ('Brand#3', 'Brand#4') THEN '*' ELSE category END AS category FROM catalog),
j AS (SELECT * FROM c WHERE NOT (scope = 'frame' AND category = 'Brand#7') OR config_name = (SELECT min('cfg-' || p_partkey) FROM part WHERE p_brand = 'Brand#7' AND p_type <> 'ECONOMY')),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, lower(category) ORDER BY loaded DESC, active DESC, lower(config_name)) AS i FROM j)
SELECT scope, category, config_name FROM r WHERE i = 1 AND category <> '*'
""",
)
def best_models(spark, folder):
    part = fx.load(spark, folder, "part")
    economy = F.col("p_type") == "ECONOMY"
    none = F.array().cast("array<string>")
    config = F.concat(F.lit("cfg-"), F.col("p_partkey"))
    catalog = part.select(
        config.alias("config_name"),
        F.array(F.lit("Tagging")).alias("capabilities"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Frame"), F.lit("asset"))).otherwise(none).alias("scopes"),
        F.when(economy, none).otherwise(F.array("p_brand")).alias("categories"),
        (F.col("p_size") % 5 == 0).alias("loaded"),
        (F.col("p_size") % 3 == 0).alias("active"),
    )
    brand = part.filter((F.col("p_brand") == "Brand#7") & ~economy)
    preferences = brand.agg(F.min(config).alias("model")).select(
        F.lit("FRAME").alias("scope"), F.lit("brand#7").alias("category"), F.upper("model").alias("model")
    )
    skipped = part.filter(F.col("p_brand").isin("Brand#3", "Brand#4")).select(
        F.upper("p_brand").alias("category")
    ).distinct()
    return worklist.best_models(catalog, preferences, skipped)


@query(
    "batches",
    """
WITH s AS (SELECT o_orderkey AS asset_id, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '!' END AS signature FROM orders)
SELECT asset_id, signature, ((row_number() OVER (PARTITION BY signature ORDER BY asset_id) - 1) // 288)::BIGINT AS batch_no FROM s
""",
)
def batches(spark, folder):
    mark = F.when(F.col("o_orderstatus") == "F", "").otherwise("!")
    signatures = fx.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.concat("o_orderpriority", mark).alias("signature")
    )
    return worklist.batches(signatures)


@query(
    "want_signature",
    """
SELECT l_orderkey AS asset_id, replace(string_agg(l_returnflag || '~' || l_linestatus || '~~m' || l_suppkey || ',m' || l_linenumber, '^'
   ORDER BY l_linenumber, l_returnflag || '~' || l_linestatus || '~~m' || l_suppkey || ',m' || l_linenumber), '~', '/') AS signature FROM lineitem GROUP BY 1
""",
)
def want_signature(spark, folder):
    wants = fx.load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        F.col("l_linenumber").alias("want_pos"),
        F.col("l_returnflag").alias("capability"),
        F.col("l_linestatus").alias("scope"),
        F.lit(None).cast("string").alias("from_detection"),
        F.array(F.concat(F.lit("m"), "l_suppkey"), F.concat(F.lit("m"), "l_linenumber")).alias("execution_models"),
    )
    made = worklist.want_signature(wants)
    return made.withColumn("signature", F.translate("signature", "\u001e\u001f", "^/"))


def _evidence(spark, folder):
    return fx.load(spark, folder, "lineitem").select(
        F.lit("video").alias("host_type"),
        F.col("l_orderkey").alias("host_id"),
        F.lit("tagging").alias("source_key"),
        F.col("l_partkey").alias("item"),
        F.to_json(F.struct(F.concat(F.lit("m"), F.col("l_linenumber")).alias("modelKey"))).alias("payload"),
        F.col("l_quantity").alias("value"),
    )


@query(
    "replace_by_host",
    """
SELECT l_orderkey AS host_id, l_partkey AS item, l_quantity AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, -1, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'
""",
)
def replace_by_host(spark, folder):
    """Hosts of open orders are processed again; low priority ones yield nothing."""
    again = fx.load(spark, folder, "orders").filter(F.col("o_orderstatus") == "O")
    processed = again.select(
        F.lit("video").alias("host_type"), F.col("o_orderkey").alias("host_id"), F.lit("tagging").alias("source_key")
    )
    new = again.filter(F.col("o_orderpriority") != "5-LOW").select(
        F.lit("video").alias("host_type"),
        F.col("o_orderkey").alias("host_id"),
        F.lit("tagging").alias("source_key"),
        F.lit(-1).cast("bigint").alias("item"),
        F.lit("{}").alias("payload"),
        F.col("o_totalprice").alias("value"),
    )
    known = fx.load(spark, folder, "orders").select(F.col("o_orderkey").alias("host_id"))
    existing = _evidence(spark, folder).join(known, "host_id", "left_semi")
    made = sinks.replace_by_host(existing, new, processed)
    return made.select("host_id", "item", "value")


@query(
    "replace_by_model",
    """
WITH n AS (SELECT o_orderkey AS host_id, 'm' || (1 + o_custkey % 7) AS m, o_totalprice AS value FROM orders WHERE o_orderstatus = 'O'),
x AS (SELECT o_orderkey AS host_id, 'm' || (1 + o_orderkey % 7) AS m FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey AS host_id, l_partkey AS item, l_quantity AS value FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.host_id = l_orderkey AND n.m = 'm' || l_linenumber)
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.host_id = l_orderkey AND x.m = 'm' || l_linenumber)
UNION ALL SELECT host_id, -1, value FROM n
""",
)
def replace_by_model(spark, folder):
    orders = fx.load(spark, folder, "orders")
    host = [F.lit("video").alias("host_type"), F.col("o_orderkey").alias("host_id"), F.lit("tagging").alias("source_key")]
    model = F.concat(F.lit(" M"), 1 + F.col("o_custkey") % 7)
    new = orders.filter(F.col("o_orderstatus") == "O").select(
        *host,
        F.lit(-1).cast("bigint").alias("item"),
        F.to_json(F.struct(model.alias("modelKey"))).alias("payload"),
        F.col("o_totalprice").alias("value"),
    )
    rerun = orders.filter(F.col("o_orderstatus") == "F").select(
        *host, F.concat(F.lit("M"), 1 + F.col("o_orderkey") % 7).alias("model_key")
    )
    made = sinks.replace_by_model(_evidence(spark, folder), new, rerun)
    return made.select("host_id", "item", "value")


@query(
    "drop_unsupported_links",
    """
SELECT DISTINCT l_orderkey AS host_id, l_returnflag AS tag FROM lineitem
WHERE (l_orderkey, l_returnflag) IN (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_tax > 0)
""",
)
def drop_unsupported_links(spark, folder):
    from sightline.operators.tags import drop_unsupported_links as drop

    lines = fx.load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("host_id"), F.col("l_returnflag").alias("tag"), "l_tax"
    )
    return drop(lines.select("host_id", "tag").distinct(), lines.filter(F.col("l_tax") > 0))
