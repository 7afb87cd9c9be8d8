"""Which assets are due for reprocessing, judged by run history alone.

``runs``: run_id, host_type, host_id, status, completed_at, claim_ids,
frame_interval, threshold, models (array of model_key, identifier, version,
categories). ``wants``: want_id, host_type, host_id, claim_ids, models (same
shape), frame_interval, threshold, forced, allow_partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import is_blank, key_of
from sightline.operators.ordered import RANGE, bucketed_scan, first_by, has_hot_key, ranged

_CLOSE = 1e-6
_NO_IDENTIFIER = (1 << 31) - 1

NO_HOST, FORCED, NO_PRIOR = "no_host", "forced", "no_prior_run"
SUPERSEDED, THRESHOLD, INTERVAL = "superseded", "threshold_differs", "interval_not_covered"


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value of a short array of strings."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        values,
        empty,
        lambda kept, x: F.when(
            F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def _categories(model: Column) -> Column:
    named = F.filter(
        F.coalesce(model["categories"], F.array().cast("array<string>")), lambda c: ~is_blank(c)
    )
    return distinct_ignoring_case(F.transform(named, lambda c: F.trim(c)))


def _slots(model: Column) -> Column:
    categories = _categories(model)
    return F.when(F.size(categories) > 0, categories).otherwise(F.array(model["model_key"]))


def _lower_all(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(v))


def latest_slot_model(runs: DataFrame, wants: DataFrame) -> DataFrame:
    """For each slot of each wanted model, the model that filled it last.

    Slots are a model's categories, or its key when it has none. Only completed
    runs of the same host sharing a claim count; the newest wins, then the
    smaller run id and the earlier model. Columns starting with ``prior_`` are
    null where no run filled the slot.
    """
    wanted = wants.select(
        "want_id",
        "host_type",
        "host_id",
        _lower_all(F.col("claim_ids")).alias("_claims"),
        F.posexplode("models").alias("model_pos", "model"),
    ).select("*", F.explode(_slots(F.col("model"))).alias("slot"))
    done = (
        runs.filter(F.col("status") == "completed")
        .select(
            "run_id",
            "host_type",
            "host_id",
            "completed_at",
            _lower_all(F.col("claim_ids")).alias("_run_claims"),
            F.col("frame_interval").alias("prior_interval"),
            F.col("threshold").alias("prior_threshold"),
            F.posexplode("models").alias("_pos", "prior"),
        )
        .filter(~is_blank("prior.model_key"))
        .select("*", F.explode(_slots(F.col("prior"))).alias("_slot"))
        .withColumn("_slot", F.lower("_slot"))
    )
    hits = wanted.withColumn("_slot", F.lower("slot")).join(done, ["host_type", "host_id", "_slot"])
    hits = hits.filter(F.arrays_overlap("_claims", "_run_claims"))
    newest = hits.groupBy("want_id", "model_pos", "_slot").agg(
        F.min_by(
            F.struct("run_id", "prior", "prior_interval", "prior_threshold"),
            F.struct(-F.unix_micros(F.col("completed_at").cast("timestamp")), F.col("run_id"), F.col("_pos")),
        ).alias("_hit")
    )
    keys = distinct_ignoring_case(F.concat(F.array("prior.model_key"), _categories(F.col("prior"))))
    prior = newest.select("want_id", "model_pos", "_slot", "_hit.*").select(
        "want_id",
        "model_pos",
        "_slot",
        F.col("run_id").alias("prior_run_id"),
        F.col("prior.model_key").alias("prior_model_key"),
        F.col("prior.identifier").alias("prior_identifier"),
        F.col("prior.version").alias("prior_version"),
        "prior_interval",
        "prior_threshold",
        keys.alias("prior_keys"),
    )
    return (
        wanted.withColumn("_slot", F.lower("slot"))
        .join(prior, ["want_id", "model_pos", "_slot"], "left")
        .drop("_slot", "_claims")
    )


def _version(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def _covers(prior: Column, asked: Column) -> Column:
    """The prior interval divides the asked one; unknown ones must be equal."""
    prior, asked = F.coalesce(prior, F.lit(0.0)), F.coalesce(asked, F.lit(0.0))
    rest = asked % F.when(prior > 0, prior)
    divides = (rest < _CLOSE) | (prior - rest < _CLOSE)
    return F.when((prior <= 0) | (asked <= 0), F.abs(prior - asked) < _CLOSE).otherwise(divides)


def decide(slots: DataFrame, wants: DataFrame) -> DataFrame:
    """Skip, run or rerun for each wanted model from its slots.

    A higher version, then a lower identifier supersedes; the same model runs
    again only for another threshold (both known) or an uncovered interval.
    """
    asked = wants.select("want_id", "frame_interval", "threshold", "forced")
    newer = _version(F.col("model.version")) - _version(F.col("prior_version"))
    mine = F.coalesce(F.col("model.identifier"), F.lit(_NO_IDENTIFIER))
    theirs = F.coalesce(F.col("prior_identifier"), F.lit(_NO_IDENTIFIER))
    apart = F.abs(F.col("prior_threshold") - F.col("threshold")) >= _CLOSE
    covered = _covers(F.col("prior_interval"), F.col("frame_interval"))
    reason = (
        F.when(F.col("prior_model_key").isNull(), NO_PRIOR)
        .when(F.abs(newer) >= _CLOSE, F.when(newer > 0, SUPERSEDED))
        .when(mine != theirs, F.when(mine < theirs, SUPERSEDED))
        .when(F.coalesce(apart, F.lit(False)), THRESHOLD)
        .when(~covered, INTERVAL)
    )
    judged = (
        slots.join(asked, "want_id")
        .withColumn("_reason", F.when(F.col("forced"), FORCED).otherwise(reason))
        .withColumn(
            "_keys",
            F.when(
                F.col("_reason").isNotNull() & F.col("prior_model_key").isNotNull(), F.col("prior_keys")
            ),
        )
    )
    per_model = judged.groupBy("want_id", "model_pos", F.col("model.model_key").alias("model_key")).agg(
        F.array_sort(F.flatten(F.collect_list("_keys"))).alias("_keys"),
        F.array_sort(F.collect_set("_reason")).alias("reasons"),
    )
    keys = distinct_ignoring_case(F.col("_keys"))
    return per_model.select(
        "want_id",
        "model_pos",
        "model_key",
        F.when(F.size("reasons") == 0, "skip")
        .when(F.size(keys) > 0, "rerun")
        .otherwise("run")
        .alias("decision"),
        keys.alias("replacement_keys"),
        "reasons",
    )


def worklist(decisions: DataFrame, wants: DataFrame) -> DataFrame:
    """One row per want: the models to execute, the keys their results replace
    and skip, run or rerun. A want that may not run in part runs whole when
    any model is due. Wants without a host always run.
    """
    due = F.col("decision") != "skip"
    item = F.struct("model_pos", "model_key")
    rolled = decisions.groupBy("want_id").agg(
        F.array_sort(F.collect_list(item)).alias("_all"),
        F.array_sort(F.collect_list(F.when(due, item))).alias("_due"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("decision") == "rerun", F.col("replacement_keys"))))).alias("_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(due, F.col("reasons")))))).alias("_why"),
    )
    homeless = F.col("host_id").isNull()
    every = distinct_ignoring_case(F.transform("models", lambda m: m["model_key"]))
    some = distinct_ignoring_case(F.transform("_due", lambda m: m["model_key"]))
    none = F.array().cast("array<string>")
    any_due = F.size("_due") > 0
    keys = F.coalesce(distinct_ignoring_case(F.col("_keys")), none)
    return wants.join(rolled, "want_id", "left").select(
        "want_id",
        "host_type",
        "host_id",
        F.when(homeless, every)
        .when(~any_due, none)
        .when(~F.col("allow_partial"), every)
        .otherwise(some)
        .alias("execution_models"),
        F.when(homeless, none).otherwise(keys).alias("replacement_keys"),
        F.when(homeless, "run")
        .when(~any_due, "skip")
        .when(F.size(keys) > 0, "rerun")
        .otherwise("run")
        .alias("decision"),
        F.when(homeless, F.array(F.lit(NO_HOST))).otherwise(F.coalesce("_why", none)).alias("reasons"),
    )


def plan_work(runs: DataFrame, wants: DataFrame) -> DataFrame:
    """The whole decision from history to work list."""
    return worklist(decide(latest_slot_model(runs, wants), wants), wants)


def run_state(events: DataFrame) -> DataFrame:
    """Latest state per run from its journal (run_id, event, at, event_id,
    frame_interval, models, error); event is start, complete, fail or cancel.
    """
    when = F.struct("at", "event_id")
    ended = F.col("event") != "start"
    status = F.element_at(
        F.create_map(
            *[
                F.lit(x)
                for pair in (("start", "running"), ("complete", "completed"), ("fail", "failed"), ("cancel", "cancelled"))
                for x in pair
            ]
        ),
        F.col("event"),
    )
    outcome = F.struct(F.when(F.col("event") != "complete", F.col("error")).alias("error"), F.col("at"))
    return (
        events.groupBy("run_id")
        .agg(
            F.max_by(status, when).alias("status"),
            F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"),
            F.max_by(F.when(ended, outcome), F.when(ended, when)).alias("_end"),
            F.max_by("models", F.when(F.col("event") == "complete", when)).alias("models"),
            F.max_by("frame_interval", F.when(F.col("event") == "start", when)).alias("frame_interval"),
        )
        .select(
            "run_id",
            "status",
            "started_at",
            F.col("_end.at").alias("completed_at"),
            F.col("_end.error").alias("error"),
            "models",
            "frame_interval",
        )
    )


def strip_models(runs: DataFrame, cleared: DataFrame) -> DataFrame:
    """Remove cleared models from completed runs so the work is due again.

    ``cleared`` (host_type, host_id, model_key). A model goes when its key,
    its name or one of its categories was cleared on the run's host.
    """
    keys = (
        cleared.filter(~is_blank("model_key"))
        .groupBy("host_type", "host_id")
        .agg(F.collect_set(F.lower("model_key")).alias("_cleared"))
    )
    joined = runs.join(keys, ["host_type", "host_id"], "left")
    named = "name" in runs.schema["models"].dataType.elementType.names

    def matches(model: Column) -> Column:
        labels = [F.array(model["model_key"]), F.coalesce(model["categories"], F.array().cast("array<string>"))]
        if named:
            labels.append(F.array(model["name"]))
        return F.coalesce(F.arrays_overlap(_lower_all(F.concat(*labels)), F.col("_cleared")), F.lit(False))

    kept = F.filter("models", lambda m: ~matches(m))
    touched = (F.col("status") == "completed") & F.col("_cleared").isNotNull()
    return joined.withColumn("models", F.when(touched, kept).otherwise(F.col("models"))).select(*runs.columns)


def best_models(catalog: DataFrame, preferences: DataFrame, skipped: DataFrame) -> DataFrame:
    """Models to use per scope and category.

    ``catalog`` (config_name, capabilities, scopes, categories, loaded,
    active), ``preferences`` (scope, category, model), ``skipped`` (category).
    A preference decides, even against all candidates; otherwise loaded, then
    active, then the name. Uncategorised models serve a scope only when no
    category of it found one.
    """
    usable = catalog.filter(
        ~is_blank("config_name") & F.exists("capabilities", lambda c: F.lower(c) == "tagging")
    )
    default = F.array(F.lit("asset"), F.lit("frame"), F.lit("region"))
    scopes = F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(default)
    facts = ["config_name", "loaded", "active"]
    skip = skipped.select(key_of("category").alias("_category")).distinct()
    named = (
        usable.select(*facts, F.explode("categories").alias("category"))
        .withColumns({"category": F.trim("category"), "_category": key_of("category")})
        .filter(F.col("_category") != "")
        .join(skip, "_category", "left_anti")
    )
    open_models = usable.join(named.select("config_name").distinct(), "config_name", "left_anti")
    star = open_models.select(*facts, F.lit("*").alias("category"), F.lit("*").alias("_category"))
    by_scope = (
        usable.select("config_name", F.explode(scopes).alias("scope"))
        .select("config_name", key_of("scope").alias("scope"))
        .filter(F.col("scope") != "")
        .distinct()
    )
    rows = named.select(*facts, "category", "_category").unionByName(star).join(by_scope, "config_name")
    prefs = first_by(
        preferences.filter(~is_blank("scope") & ~is_blank("category") & ~is_blank("model")).select(
            key_of("scope").alias("scope"), key_of("category").alias("_category"), F.trim("model").alias("_model")
        ),
        ["scope", "_category"],
        [F.col("_model")],
    )
    judged = rows.join(prefs, ["scope", "_category"], "left").filter(
        F.col("_model").isNull() | (F.lower("_model") == F.lower("config_name"))
    )
    chosen = first_by(
        judged,
        ["scope", "_category"],
        [~F.col("loaded"), ~F.col("active"), F.lower("config_name"), F.col("config_name")],
    )
    served = chosen.filter(F.col("_category") != "*").select("scope").distinct()
    spare = chosen.filter(F.col("_category") == "*").join(served, "scope", "left_anti")
    every = chosen.filter(F.col("_category") != "*").unionByName(spare)
    return every.select("scope", "category", "config_name")


def want_signature(wants: DataFrame) -> DataFrame:
    """Per asset the signature of its due wants (capability, scope,
    from_detection, execution_models), in want order.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("capability", "scope", "from_detection")]
    one = F.concat_ws("\u001f", *parts, F.array_join("execution_models", ","))
    due = wants.filter(F.size("execution_models") > 0)
    return due.groupBy("asset_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("want_pos", one.alias("s")))), lambda w: w["s"]),
            "\u001e",
        ).alias("signature")
    )


def batches(signatures: DataFrame, size: int = 288) -> DataFrame:
    """Number the assets of each signature in batches of ``size``.

    A signature shared by most assets is ranked across tasks (see
    ``bucketed_scan``), not sorted in one.
    """
    size = max(1, size)
    hot = has_hot_key(signatures, ["signature"])
    signatures = ranged(signatures, ["asset_id"]) if hot else signatures.withColumn(RANGE, F.lit(0))
    ranked = bucketed_scan(signatures, ["signature"], F.col(RANGE), ["asset_id"], rank="_rank", hot=hot)
    return ranked.withColumn(
        "batch_no", F.floor((F.col("_rank") - 1) / size).cast("bigint")
    ).drop("_rank", RANGE)


