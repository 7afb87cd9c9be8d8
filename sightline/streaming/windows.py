"""Observation windows of an unbounded stream of samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.config import DEFAULT_SLICE_SPAN, MINIMUM_SLICE_SPAN, TRACKS


def window_gap(span: float | None) -> float:
    """Seconds without a sample that end a window."""
    floor = max(MINIMUM_SLICE_SPAN, span if span is not None else DEFAULT_SLICE_SPAN)
    return max(TRACKS.window_gap_floor, floor * TRACKS.window_gap_spans)


def observation_windows_stream(
    samples: DataFrame, *, span: float | None, delay: str, keys: tuple[str, ...] = ("asset_id", "track_key")
) -> DataFrame:
    """Windows per track as sessions: a window closes once the watermark has
    passed it, samples arriving later than ``delay`` are dropped.

    ``samples`` (keys, ts, score). Use in append mode.
    """
    gap = window_gap(span)
    tail = max(MINIMUM_SLICE_SPAN, span if span is not None else DEFAULT_SLICE_SPAN)
    sessions = F.session_window("ts", f"{round(gap * 1000)} milliseconds")
    grouped = samples.withWatermark("ts", delay).groupBy(*keys, sessions)
    made = grouped.agg(
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max("score").alias("top_score"),
    )
    end = F.col("last_at") + F.make_dt_interval(secs=F.lit(tail))
    return made.select(*keys, "first_at", end.alias("end_at"), "sample_count", "top_score")


#: State of a track: open windows as microseconds of the first and last sample, count, best score, slice span.
_OPEN = "first_us bigint, last_us bigint, sample_count bigint, top_score double, span double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrackWindows(StatefulProcessor):
    """Windows of one track, whose gap follows from its own slice span.

    A window stays open until the watermark has passed its last sample by the
    gap: from then on every sample that could join it would be late. Samples
    may arrive in any order until then and join windows that turn out to be
    one. A track without open windows holds no state and no timer.
    """

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def close(self) -> None:
        pass

    @staticmethod
    def _gap(span: float) -> int:
        return round(window_gap(span) * 1_000_000)

    def _held(self) -> list[list]:
        return [list(w) for w in self.open.get()]

    def _settle(self, key: tuple, held: list[list], watermark_ms: int):
        """Emit what is complete, keep the rest and wake when the first of it may be."""
        done = [w for w in held if w[1] + self._gap(w[4]) <= watermark_ms * 1000]
        rest = [w for w in held if w[1] + self._gap(w[4]) > watermark_ms * 1000]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.open.put([tuple(w) for w in rest])
            self.handle.registerTimer(min(-(-(w[1] + self._gap(w[4])) // 1000) for w in rest))
        else:
            self.open.clear()
        if done:
            made = {k: [v] * len(done) for k, v in zip(self.keys, key)}
            tails = [max(MINIMUM_SLICE_SPAN, w[4]) for w in done]
            made["first_at"] = pd.to_datetime([w[0] for w in done], unit="us")
            made["end_at"] = pd.to_datetime([w[1] + round(t * 1_000_000) for w, t in zip(done, tails)], unit="us")
            made["sample_count"] = [w[2] for w in done]
            made["top_score"] = [w[3] for w in done]
            yield pd.DataFrame(made)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802 (names of the interface)
        held = self._held()
        for batch in rows:
            times = batch["ts"].to_numpy("datetime64[us]").astype("int64")
            for at, score, span in zip(times.tolist(), batch["score"].tolist(), batch["span"].tolist()):
                span = DEFAULT_SLICE_SPAN if span is None or span != span else span
                gap = self._gap(span)
                score = None if score is None or score != score else score
                joined = [at, at, 1, score, span]
                apart = []
                for w in held:
                    if at - w[1] > gap or w[0] - at > gap:
                        apart.append(w)
                        continue
                    best = [s for s in (joined[3], w[3]) if s is not None]
                    joined = [min(joined[0], w[0]), max(joined[1], w[1]), joined[2] + w[2], max(best) if best else None, max(joined[4], w[4])]
                held = [*apart, joined]
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        yield from self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())


def track_windows_stream(samples: DataFrame, *, delay: str, keys: tuple[str, ...] = ("asset_id", "track_key")) -> DataFrame:
    """Windows per track where each track has its own slice span.

    ``samples`` (keys, ts, score, span; a missing span counts as the default).
    Samples later than ``delay`` are dropped. Use in append mode. The state is
    held in RocksDB, which is set for the session here.
    """
    spark = samples.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, first_at timestamp, end_at timestamp, sample_count bigint, top_score double"
    kept = samples.select(*keys, "ts", F.col("score").cast("double"), F.col("span").cast("double"))
    return (
        kept.withWatermark("ts", delay)
        .groupBy(*keys)
        .transformWithStateInPandas(TrackWindows(tuple(keys)), schema, "Append", "EventTime")
    )
