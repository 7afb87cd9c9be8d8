"""Vectors of analysed assets ready to store: audio windows and visual kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.config import AUDIO_FAMILY, AUDIO_KIND
from sightline.functions.text import is_blank
from sightline.operators.centroids import centroid
from sightline.operators.ordered import first_by
from sightline.operators.timeline import window_sound_type


def audio_embeddings(vectors: DataFrame, classifications: DataFrame) -> DataFrame:
    """Stored audio vectors: every window, and per asset and model a centroid.

    The centroid covers voiced windows, or all where none is voiced; ``basis``
    tells which. ``vectors`` (asset_id, slice_pos, slice_index, start_seconds,
    end_seconds, model_key, item_pos, vector, norm).
    """
    sounds = window_sound_type(classifications)
    windows = vectors.join(sounds, ["asset_id", "slice_pos"], "left").withColumns(
        {
            "sound_type": F.coalesce("sound_type", F.lit("unknown")),
            "is_voice": F.coalesce("is_voice", F.lit(False)),
            "_model": F.lower("model_key"),
        }
    )
    rows = windows.select(
        "asset_id",
        "model_key",
        F.coalesce(F.col("slice_index") + 1, F.lit(1)).cast("bigint").alias("section_index"),
        "start_seconds",
        "end_seconds",
        "vector",
        "norm",
        F.lit("window").alias("scope"),
        "sound_type",
        "is_voice",
        F.lit(None).cast("string").alias("basis"),
        F.lit(None).cast("bigint").alias("voice_windows"),
        F.lit(None).cast("bigint").alias("windows"),
    )
    key = ["asset_id", "_model"]
    used = windows.filter(F.size("vector") > 0)
    place = F.struct(
        F.coalesce(F.col("start_seconds"), F.lit(float("-inf"))), F.coalesce("slice_index", F.lit(-1)), "item_pos"
    )
    counts = used.groupBy(*key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("is_voice").alias("voice_windows"),
        F.min_by("model_key", place).alias("model_key"),
    )
    chosen = used.drop("model_key").join(counts, key).filter(
        F.col("is_voice") | (F.col("voice_windows") == 0)
    )
    means = centroid(chosen, key, first=place, norm_rule="before").select(*key, "vector", "norm")
    assets = means.join(counts, key).select(
        "asset_id",
        "model_key",
        F.lit(0).cast("bigint").alias("section_index"),
        F.lit(None).cast("double").alias("start_seconds"),
        F.lit(None).cast("double").alias("end_seconds"),
        "vector",
        "norm",
        F.lit("asset").alias("scope"),
        F.lit(None).cast("string").alias("sound_type"),
        F.lit(None).cast("boolean").alias("is_voice"),
        F.when(F.col("voice_windows") > 0, "voice").otherwise("all").alias("basis"),
        "voice_windows",
        "windows",
    )
    made = rows.unionByName(assets)
    return made.withColumns({"kind": F.lit(AUDIO_KIND), "kind_family": F.lit(AUDIO_FAMILY)})


_SEMANTIC_WORDS = ("semvisual", "clip", "meta", "semantic")


def route_visual(embeddings: DataFrame, targets: DataFrame) -> DataFrame:
    """Give each vector the kind its model stands for.

    ``targets`` (target_pos, kind, kind_family, is_semantic, tokens). The
    longest token equal to the model key or to its end after an underscore
    decides; without one, the first target as semantic as the key sounds.
    Vectors no target fits are left out. Only distinct model keys are matched,
    and by equality of their endings.
    """
    models = embeddings.select("model_key").distinct()
    parts = F.split(F.lower("model_key"), "_")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"),
    )
    tokens = targets.select(
        "target_pos", F.posexplode("tokens").alias("_token_pos", "_token")
    ).filter(~is_blank("_token"))
    keyed = tokens.withColumns({"_ending": F.lower("_token"), "_length": F.length("_token")})
    hits = models.select("model_key", F.explode(endings).alias("_ending")).join(keyed, "_ending")
    best = first_by(hits, ["model_key"], [-F.col("_length"), F.col("target_pos"), F.col("_token_pos")])
    sounds = F.lit(False)
    for word in _SEMANTIC_WORDS:
        sounds = sounds | F.contains(F.lower("model_key"), F.lit(word))
    first = targets.groupBy("is_semantic").agg(F.min("target_pos").alias("target_pos"))
    rest = models.join(best, "model_key", "left_anti").withColumn("is_semantic", sounds)
    routed = best.select("model_key", "target_pos").unionByName(
        rest.join(first, "is_semantic").select("model_key", "target_pos")
    )
    kinds = routed.join(targets.select("target_pos", "kind", "kind_family", "is_semantic"), "target_pos")
    return embeddings.join(kinds.drop("target_pos"), "model_key")
