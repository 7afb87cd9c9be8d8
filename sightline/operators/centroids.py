"""Mean and weighted centroids of vectors per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.vectors import l2norm


def vector_sums(
    df: DataFrame,
    keys: Sequence[str],
    *,
    vector: str = "vector",
    weight: Column | None = None,
    first: Column | None = None,
    prefer: str = "first",
) -> DataFrame:
    """Per key: ``vector_sum``, ``weight_sum`` and ``vector_count``.

    Vectors of another dimension than the chosen one are left out: that of the
    row first under ``first``, or with ``prefer='majority'`` the commonest
    (larger on a tie). Each task adds up the vectors of a key batch by batch,
    so what is shuffled and listed per key are sums of batches. Missing
    elements and weights count as nothing.
    """
    keys = list(keys)
    rows = df.filter(F.size(vector) > 0)
    weighed = [F.col(vector).alias("_v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")]
    sized = rows.select(*keys, *weighed, F.size(vector).alias("_dim"), (F.lit(0) if first is None else first).alias("_first"))
    dims = sized.agg(F.min("_dim"), F.max("_dim")).first()
    if dims[0] != dims[1]:
        counted = sized.groupBy(*keys, "_dim").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
        choice = (
            F.struct(-F.col("_n"), -F.col("_dim")) if prefer == "majority" else F.struct("_first", "_dim")
        )
        chosen = counted.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
            F.min_by("_dim", choice).alias("_chosen")
        )
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        sized = sized.join(chosen, [*same, F.col("_dim") == F.col("_chosen")], "left_semi")
    partial = sized.select(*keys, "_v", "_w")
    types = ", ".join(f"`{k}` {partial.schema[k].dataType.simpleString()}" for k in keys)
    made = partial.mapInArrow(_batch_sums, f"{types}, _x array<double>, _w double, _n bigint")
    listed = made.groupBy(*keys).agg(
        F.collect_list("_x").alias("_parts"), F.sum("_w").alias("weight_sum"), F.sum("_n").alias("vector_count")
    )
    total = F.aggregate(
        F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))),
        F.get("_parts", F.lit(0)),
        lambda t, x: F.zip_with(t, x, lambda a, b: a + b),
    )
    return listed.select(*keys, total.alias("vector_sum"), "weight_sum", "vector_count")


def _batch_sums(batches):
    """Weighted sum of the vectors (``_v``, ``_w``) per key and dimension of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [n for n in batch.schema.names if n not in ("_v", "_w")]
        codes = np.zeros(batch.num_rows, dtype=np.int64)
        vectors = batch.column("_v")
        lengths = np.diff(vectors.offsets.to_numpy())
        for values in [pa.array(lengths), *[batch.column(n) for n in names]]:
            coded = values.dictionary_encode(null_encoding="encode")
            joined = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if vectors.flatten().null_count:
            flat[vectors.flatten().is_null().to_numpy(zero_copy_only=False)] = 0.0
        weights = batch.column("_w").fill_null(0.0).to_numpy(zero_copy_only=False)
        begins = np.r_[0, np.cumsum(lengths)]
        heads = order[starts]
        counts = np.diff(np.r_[starts, len(order)])
        made: list = [None] * len(starts)
        for dim in np.unique(lengths):
            groups = np.flatnonzero(lengths[heads] == dim)
            rows = np.concatenate([order[starts[g] : starts[g] + counts[g]] for g in groups])
            matrix = flat[begins[rows][:, None] + np.arange(dim)] * weights[rows][:, None]
            cuts = np.r_[0, np.cumsum(counts[groups])[:-1]]
            for g, total in zip(groups, np.add.reduceat(matrix, cuts, axis=0)):
                made[g] = total
        out = [batch.column(n).take(pa.array(heads)) for n in names]
        out += [pa.array(made, pa.list_(pa.float64())), pa.array(np.add.reduceat(weights[order], starts)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(out, names=[*names, "_x", "_w", "_n"])


def centroid(
    df: DataFrame,
    keys: Sequence[str],
    *,
    vector: str = "vector",
    weight: Column | None = None,
    first: Column | None = None,
    prefer: str = "first",
    norm_rule: str = "before",
    normalized: bool = True,
) -> DataFrame:
    """Centroid per key as ``vector`` (single precision), ``norm``, ``vector_count``.

    ``norm_rule``: ``before`` reports the length of the mean (audio, faces),
    ``after`` the length of the returned vector (visual), and ``required``
    drops keys whose mean has no length. Keys without weight are dropped.
    """
    sums = vector_sums(df, keys, vector=vector, weight=weight, first=first, prefer=prefer)
    sums = sums.filter(F.col("weight_sum") > 0)
    mean = sums.withColumn(
        "_mean",
        F.transform("vector_sum", lambda x: (x / F.col("weight_sum")).cast("float")),
    ).withColumn("_norm", l2norm("_mean"))
    if norm_rule == "required":
        mean = mean.filter(F.col("_norm") > 0)
    unit = F.when(F.col("_norm") <= 0, F.col("_mean")).otherwise(
        F.transform("_mean", lambda x: (x.cast("double") / F.col("_norm")).cast("float"))
    )
    result = mean.withColumn("vector", unit if normalized else F.col("_mean"))
    norm = l2norm("vector") if norm_rule == "after" else F.col("_norm")
    return result.select(*keys, "vector", norm.alias("norm"), "weight_sum", "vector_count")
