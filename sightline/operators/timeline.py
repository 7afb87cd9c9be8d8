"""Timeline operators: runs, spans, intervals, sessions, representatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.config import (
    DEFAULT_SLICE_SPAN,
    MINIMUM_SLICE_SPAN,
    TAG_CONFIDENCE_FLOOR,
    TRACKS,
    VOICE_FLOOR,
    VOICE_SOUND_TYPES,
)
from sightline.operators.ordered import bucketed_scan, has_hot_key, time_bucket

# Buckets of slices without a time sort before all timed ones.
_UNTIMED = -(1 << 40)


def slice_bucket(time: str = "time_seconds", index: str = "slice_index") -> Column:
    """Order-preserving bucket for slices sorted by time, then index, nulls first."""
    by_index = F.floor(F.coalesce(F.col(index), F.lit(-1)) / 1000) + F.lit(_UNTIMED)
    return F.coalesce(time_bucket(time), by_index.cast("bigint"))


def confidence_floor(df: DataFrame, floor: float = TAG_CONFIDENCE_FLOOR) -> DataFrame:
    """Rows at or above the floor; a missing confidence passes."""
    return df.filter(F.coalesce(F.col("confidence") >= floor, F.lit(True)))


def frame_ordinals(slices: DataFrame, hot: bool | None = None) -> DataFrame:
    """``frame_ordinal`` of each slice of an asset, counting empty slices."""
    order = [
        F.asc_nulls_first("time_seconds"),
        F.asc_nulls_first("slice_index"),
        F.col("slice_pos"),
    ]
    return bucketed_scan(slices, ["asset_id"], slice_bucket(), order, rank="frame_ordinal", hot=hot)


def tag_segments(slices: DataFrame, predictions: DataFrame, span: Column | None = None) -> DataFrame:
    """Runs of consecutive slices carrying the same tag of the same model.

    ``slices`` (asset_id, slice_pos, slice_index, time_seconds,
    frame_interval) must hold every slice, also those without predictions: a
    run breaks when the next slice lacks the tag, whatever the time between.
    """
    span = F.coalesce(F.col("frame_interval"), F.lit(DEFAULT_SLICE_SPAN)) if span is None else span
    hot = has_hot_key(slices, ["asset_id"])  # a run's key holds at most one row for each slice of its asset
    placed = frame_ordinals(slices, hot).select(
        "asset_id",
        "slice_pos",
        "frame_ordinal",
        span.alias("_span"),
        F.coalesce(
            F.col("time_seconds"), F.coalesce(F.col("slice_index"), F.lit(0)) * span
        ).alias("_time"),
    )
    key = ["asset_id", "model_key", "tag"]
    kept = confidence_floor(predictions.withColumnRenamed("label", "tag"))
    per_slice = (
        kept.groupBy("asset_id", "slice_pos", "model_key", "tag")
        .agg(F.max("confidence").alias("_conf"), F.count(F.lit(1)).alias("_n"))
        .join(placed, ["asset_id", "slice_pos"])
    )
    ranked = bucketed_scan(
        per_slice, key, F.floor(F.col("frame_ordinal") / 1000), ["frame_ordinal"], rank="_rank", hot=hot
    )
    runs = ranked.groupBy(*key, (F.col("frame_ordinal") - F.col("_rank")).alias("_run")).agg(
        F.min_by("_time", "frame_ordinal").alias("start_seconds"),
        F.max_by("_time", "frame_ordinal").alias("_seen"),
        F.max("_span").alias("_span"),
        F.max("_conf").alias("confidence"),
        F.sum("_n").alias("observation_count"),
    )
    end = F.col("_seen") + F.col("_span")
    return runs.select(
        *key,
        "start_seconds",
        F.when(end <= F.col("start_seconds"), F.col("start_seconds") + F.col("_span"))
        .otherwise(end)
        .alias("end_seconds"),
        "confidence",
        "observation_count",
    )


def infer_frame_span(slices: DataFrame) -> DataFrame:
    """``frame_span`` per asset: the stated interval when positive, else the
    upper median of the gaps between distinct times (at least 0.25), else 0.5.
    """
    stated = slices.groupBy("asset_id").agg(F.max("frame_interval").alias("_stated"))
    times = slices.filter(F.col("time_seconds").isNotNull()).select("asset_id", "time_seconds")
    hot = has_hot_key(times, ["asset_id"])
    gaps = (
        bucketed_scan(
            times.distinct(),
            ["asset_id"],
            time_bucket("time_seconds"),
            ["time_seconds"],
            lag={"_before": "time_seconds"},
            hot=hot,
        )
        .withColumn("_gap", F.col("time_seconds") - F.col("_before"))
        .filter(F.col("_gap") > 0)
    )
    counts = gaps.groupBy("asset_id", "_gap").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("asset_id").agg(F.sum("_n").alias("_total"))
    running = bucketed_scan(
        counts, ["asset_id"], time_bucket("_gap", 1.0), ["_gap"], running_sum={"_upto": "_n"}, hot=hot
    )
    median = (
        running.join(totals, "asset_id")
        .filter(F.col("_upto") > F.floor(F.col("_total") / 2))
        .groupBy("asset_id")
        .agg(F.min("_gap").alias("_median"))
    )
    return stated.join(median, "asset_id", "left").select(
        "asset_id",
        F.when(F.col("_stated") > 0, F.col("_stated"))
        .when(
            F.col("_median").isNotNull(), F.greatest(F.lit(MINIMUM_SLICE_SPAN), F.col("_median"))
        )
        .otherwise(F.lit(DEFAULT_SLICE_SPAN))
        .alias("frame_span"),
    )


def representatives(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    limit: int,
    bucket: Column,
    hot: bool | None = None,
) -> DataFrame:
    """Evenly spaced rows, at most ``limit`` per key, first and last included."""
    if limit <= 0:
        return df.limit(0)
    ranked = bucketed_scan(df, keys, bucket, order, rank="_rank", group_rows="_rows", hot=hot)
    step = (F.col("_rows") - 1) / F.lit(float(max(limit - 1, 1)))
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda i: F.bround(i.cast("double") * step, 0).cast("bigint"),
    )
    chosen = (F.col("_rows") <= limit) | F.array_contains(wanted, F.col("_rank") - 1)
    return ranked.filter(chosen).select(*df.columns)


def merge_intervals(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, hot: bool | None = None
) -> DataFrame:
    """Merge overlapping or touching intervals (start_seconds, end_seconds).

    A missing end means the start. A negative start or an end before the start
    fails the job. ``limit`` keeps that many evenly spaced merged intervals.
    """
    keys = list(keys)
    hot = has_hot_key(df, keys) if hot is None else hot
    start = F.col("start_seconds").cast("double")
    end = F.coalesce(F.col("end_seconds").cast("double"), start)
    infinite = start.isin(float("inf")) | end.isin(float("inf")) | F.isnan(start) | F.isnan(end)
    bad = start.isNull() | (start < 0) | (end < start) | infinite
    checked = df.select(
        *keys,
        F.when(bad, F.raise_error(F.lit("interval start must be >= 0 and end >= start")))
        .otherwise(start)
        .cast("double")
        .alias("start_seconds"),
        end.alias("end_seconds"),
    ).distinct()
    order = ["start_seconds", "end_seconds"]
    bucket = time_bucket("start_seconds")
    reached = bucketed_scan(
        checked, keys, bucket, order, running_max_before={"_reach": "end_seconds"}, hot=hot
    ).withColumn(
        "_opens",
        F.when(F.col("_reach").isNull() | (F.col("start_seconds") > F.col("_reach")), 1).otherwise(0),
    )
    numbered = bucketed_scan(reached, keys, bucket, order, running_sum={"_group": "_opens"}, hot=hot)
    merged = numbered.groupBy(*keys, "_group").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds")
    )
    merged = merged.drop("_group")
    if limit is None:
        return merged
    return representatives(merged, keys, ["start_seconds"], limit, time_bucket("start_seconds"), hot)


def interval_weights(
    sections: DataFrame, intervals: DataFrame, keys: Sequence[str], row_id: str, bin_seconds: float = 600.0
) -> DataFrame:
    """Seconds of each section covered by the intervals of its key.

    An interval without length counts 1 where a section contains it. Sections
    and intervals meet in time bins, so a long timeline spreads over tasks; a
    pair that shares several bins counts in the first.
    """
    keys = list(keys)

    def binned(df: DataFrame, start: Column, end: Column, prefix: str) -> DataFrame:
        return (
            df.withColumns({f"_{prefix}s": start, f"_{prefix}e": end})
            .withColumn(f"_{prefix}b", time_bucket(f"_{prefix}s", bin_seconds))
            .withColumn(
                "_bin",
                F.explode(
                    F.sequence(F.col(f"_{prefix}b"), time_bucket(f"_{prefix}e", bin_seconds))
                ),
            )
        )

    s_start = F.coalesce(F.col("start_seconds"), F.lit(0.0))
    s_end = F.greatest(s_start, F.coalesce(F.col("end_seconds"), s_start))
    left = binned(sections.select(*keys, row_id, "start_seconds", "end_seconds"), s_start, s_end, "s")
    i_start = F.greatest(F.lit(0.0), F.col("start_seconds"))
    i_end = F.greatest(i_start, F.coalesce(F.col("end_seconds"), i_start))
    right = binned(intervals.select(*keys, "start_seconds", "end_seconds"), i_start, i_end, "i")
    pairs = left.drop("start_seconds", "end_seconds").join(
        right.drop("start_seconds", "end_seconds"), [*keys, "_bin"]
    )
    overlap = F.greatest(
        F.lit(0.0), F.least(F.col("_se"), F.col("_ie")) - F.greatest(F.col("_ss"), F.col("_is"))
    )
    inside = F.col("_is").between(F.col("_ss"), F.col("_se"))
    weight = F.when(F.col("_ie") > F.col("_is"), overlap).otherwise(
        F.when(inside, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return (
        pairs.filter(F.col("_bin") == F.greatest("_sb", "_ib"))
        .groupBy(*keys, row_id)
        .agg(F.sum(weight).alias("weight"))
        .filter(F.col("weight") > 0)
    )


def sample_windows(
    samples: DataFrame,
    keys: Sequence[str] = ("asset_id", "track_key"),
    *,
    gap_floor: float = TRACKS.window_gap_floor,
    gap_spans: float = TRACKS.window_gap_spans,
) -> DataFrame:
    """Number the observation windows of each track (``window_no`` from 1).

    A window ends where the next sample comes more than
    ``max(8, 4 x frame_span)`` seconds later.
    """
    keys = list(keys)
    span = F.col("frame_span")
    moment = F.coalesce(
        F.col("time_seconds"),
        F.when((span > 0) & (F.col("frame_order") >= 0), F.col("frame_order") * span),
    )
    floor = F.greatest(F.lit(MINIMUM_SLICE_SPAN), F.coalesce(span, F.lit(DEFAULT_SLICE_SPAN)))
    gap = F.greatest(F.lit(gap_floor), floor * gap_spans)
    order = [F.asc_nulls_first("time_seconds"), F.col("frame_order")]
    bucket = slice_bucket("time_seconds", "frame_order")
    hot = has_hot_key(samples, keys)
    moved = bucketed_scan(
        samples.withColumn("moment", moment), keys, bucket, order, lag={"_before": "moment"}, hot=hot
    ).withColumn(
        "_opens", F.when((F.col("moment") - F.col("_before")) > gap, 1).otherwise(0)
    )
    numbered = bucketed_scan(moved, keys, bucket, order, running_sum={"_breaks": "_opens"}, hot=hot)
    return numbered.withColumn("window_no", (F.col("_breaks") + 1).cast("bigint")).drop(
        "_before", "_opens", "_breaks"
    )


def observation_windows(
    samples: DataFrame, keys: Sequence[str] = ("asset_id", "track_key"), **gaps: float
) -> DataFrame:
    """One row per observation window: start, end (last + span), sample count
    and ``group_key`` (``track:span-i`` where a track has several windows).
    """
    return window_rows(sample_windows(samples, list(keys), **gaps), keys)


def window_rows(numbered: DataFrame, keys: Sequence[str] = ("asset_id", "track_key")) -> DataFrame:
    """The same over samples that ``sample_windows`` has numbered."""
    keys = list(keys)
    span = F.greatest(
        F.lit(MINIMUM_SLICE_SPAN), F.coalesce(F.col("frame_span"), F.lit(DEFAULT_SLICE_SPAN))
    )
    windows = numbered.groupBy(*keys, "window_no").agg(
        F.min("moment").alias("start_seconds"),
        (F.max("moment") + F.max(span)).alias("end_seconds"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    many = windows.groupBy(*keys).agg(F.max("window_no").alias("_windows"))
    return windows.join(many, keys).select(
        *keys,
        "window_no",
        F.when(
            F.col("_windows") > 1,
            F.concat(F.col(keys[-1]).cast("string"), F.lit(":span-"), F.col("window_no")),
        )
        .otherwise(F.col(keys[-1]).cast("string"))
        .alias("group_key"),
        "start_seconds",
        "end_seconds",
        "sample_count",
    )


def window_sound_type(
    classifications: DataFrame, keys: Sequence[str] = ("asset_id", "slice_pos"), floor: float = VOICE_FLOOR
) -> DataFrame:
    """Best label of each window: confidence at least ``floor`` (missing counts
    as 1), the earliest item on a tie; ``is_voice`` for voiced types.
    """
    heard = confidence_floor(classifications, floor)
    rank = F.coalesce(F.col("confidence"), F.lit(1.0))
    best = heard.groupBy(*keys).agg(
        F.min_by(F.lower(F.trim("label")), F.struct(-rank, F.col("item_pos"))).alias("_best")
    )
    label = F.when(F.col("_best") != "", F.col("_best"))
    return best.select(
        *keys,
        label.alias("sound_type"),
        F.coalesce(label.isin(*VOICE_SOUND_TYPES), F.lit(False)).alias("is_voice"),
    )


def artifact_counts(tables: Mapping[str, DataFrame], keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows per key and artifact kind; kinds without rows do not appear."""
    tagged = [df.select(*keys, F.lit(kind).alias("artifact")) for kind, df in tables.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(*keys, "artifact").agg(F.count(F.lit(1)).alias("row_count"))


