"""New evidence takes the place of what a host had: the rows that result (``store`` has the tables that do it in place)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import key_of
from sightline.sources.store import HOST


def replace_by_host(
    existing: DataFrame, new: DataFrame, processed: DataFrame, keys: Sequence[str] = HOST
) -> DataFrame:
    """Rows of processed (host, source) are replaced by the new ones; a
    processed host without new rows ends up empty.
    """
    keys = list(keys)
    cleared = processed.select(*keys).unionByName(new.select(*keys)).distinct()
    return existing.join(cleared, keys, "left_anti").unionByName(new)


def replace_by_model(
    existing: DataFrame, new: DataFrame, rerun: DataFrame | None = None, keys: Sequence[str] = HOST
) -> DataFrame:
    """Only rows whose payload names a model present in the new rows, or
    listed in ``rerun`` (keys, model_key), are replaced.
    """
    keys = list(keys)

    def model(df: DataFrame):
        return key_of(F.get_json_object(df["payload"], "$.modelKey"))

    touched = new.select(*keys, model(new).alias("_model"))
    if rerun is not None:
        touched = touched.unionByName(rerun.select(*keys, key_of("model_key").alias("_model")))
    touched = touched.filter(F.col("_model") != "").distinct()
    kept = existing.withColumn("_model", model(existing)).join(touched, [*keys, "_model"], "left_anti")
    return kept.drop("_model").unionByName(new)
