"""Ordered operators that do not put one key into one task.

A plain window over a key sorts all of its rows in one task. Where a key is
too large for that, its rows are first split into buckets that follow the order (time slots or value
ranges); the window runs inside a bucket, and a second window over one summary
row per bucket carries what came before. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut_lineage

BUCKET = "_bucket"
RANGE = "_range"


def time_bucket(seconds: Column | str, width: float = 600.0) -> Column:
    """Order-preserving bucket of a time in seconds."""
    value = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(value / F.lit(float(width))).cast("bigint")


#: Rows of one key that a plain window may sort in one task.
HOT_ROWS = 1_000_000


def has_hot_key(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> bool:
    """Whether a key holds more than ``rows`` rows: one aggregate over the keys alone."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (largest or 0) > rows


def ranged(df: DataFrame, order: Sequence[Column | str], bucket: str = RANGE) -> DataFrame:
    """``df`` with an order-preserving bucket: the number of its sampled range.

    Spark samples the bounds, which works for any type that sorts and decides
    balance, never the result. Equal values share a bucket.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order)
    # Written out: the bounds are drawn anew whenever a plan runs.
    return cut_lineage(dealt.withColumn(bucket, F.spark_partition_id().cast("bigint")))


def bucketed_scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    *,
    rank: str | None = None,
    lag: Mapping[str, str] | None = None,
    running_sum: Mapping[str, str] | None = None,
    running_max_before: Mapping[str, str] | None = None,
    group_rows: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Add ordered columns over ``keys``.

    ``rank``: 1-based row number. ``lag``: previous row's value.
    ``running_sum``: inclusive cumulative sum. ``running_max_before``: maximum
    over the rows before this one (null on the first). ``group_rows``: number
    of rows of the key. ``bucket`` must not decrease along ``order``, and
    ``order`` must be total within a key. Null keys are a key of their own.

    Without a hot key these are plain windows, which neighbouring scans over
    the same keys share one shuffle for; with one, the key's buckets are
    scanned apart. The rows are the same. ``hot`` states which, where the
    caller has measured it (``has_hot_key``); otherwise it is measured here.
    """
    keys = list(keys)
    lag, running_sum = dict(lag or {}), dict(running_sum or {})
    running_max_before = dict(running_max_before or {})
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if hot is None:
        hot = has_hot_key(df, keys)
    if not hot:
        return _plain_scan(df, keys, order, rank, lag, running_sum, running_max_before, group_rows)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)

    columns = {"_rank": F.row_number().over(local)}
    for name, source in lag.items():
        columns[f"_lag_{name}"] = F.lag(source).over(local)
    for name, source in running_sum.items():
        columns[f"_sum_{name}"] = F.sum(source).over(upto)
    for name, source in running_max_before.items():
        columns[f"_max_{name}"] = F.max(source).over(before)
    # Written out once: the summary and the rows both read it, and nested scans don't repeat what lies below.
    scanned = cut_lineage(df.withColumn(BUCKET, bucket).withColumns(columns))

    facts = [F.max("_rank").alias("_n")]
    facts += [F.max_by(F.struct(s), F.col("_rank")).alias(f"_last_{n}") for n, s in lag.items()]
    facts += [F.sum(s).alias(f"_total_{n}") for n, s in running_sum.items()]
    facts += [F.max(s).alias(f"_top_{n}") for n, s in running_max_before.items()]
    summary = scanned.groupBy(*keys, BUCKET).agg(*facts)

    across = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
    for name, source in lag.items():
        carried[f"_from_{name}"] = F.lag(f"_last_{name}").over(across)[source]
    for name in running_sum:
        carried[f"_base_{name}"] = F.sum(f"_total_{name}").over(earlier)
    for name in running_max_before:
        carried[f"_floor_{name}"] = F.max(f"_top_{name}").over(earlier)
    if group_rows:
        carried[group_rows] = F.sum("_n").over(Window.partitionBy(*keys))
    mine = [F.col(k).alias(f"_key{i}") for i, k in enumerate([*keys, BUCKET])]
    carry = summary.withColumns(carried).select(*mine, *carried)

    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate([*keys, BUCKET])]
    joined = scanned.join(carry, same)
    out = {}
    if rank:
        out[rank] = F.col("_rank") + F.col("_offset")
    for name in lag:
        out[name] = F.when(F.col("_rank") == 1, F.col(f"_from_{name}")).otherwise(
            F.col(f"_lag_{name}")
        )
    for name in running_sum:
        out[name] = F.col(f"_sum_{name}") + F.coalesce(F.col(f"_base_{name}"), F.lit(0))
    for name in running_max_before:
        out[name] = F.greatest(F.col(f"_max_{name}"), F.col(f"_floor_{name}"))
    extra = [group_rows] if group_rows else []
    return joined.withColumns(out).select(*df.columns, *out, *extra)


def _plain_scan(df, keys, order, rank, lag, running_sum, running_max_before, group_rows) -> DataFrame:
    whole = Window.partitionBy(*keys).orderBy(*order)
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    if rank:
        out[rank] = F.row_number().over(whole).cast("bigint")
    out |= {name: F.lag(source).over(whole) for name, source in lag.items()}
    out |= {name: F.sum(source).over(upto) for name, source in running_sum.items()}
    out |= {name: F.max(source).over(before) for name, source in running_max_before.items()}
    if group_rows:
        out[group_rows] = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumns(out)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    salt: Column | None = None,
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows per key with their rank.

    Small ``k`` is cut on the map side by Spark itself. Larger ``k`` is cut
    twice when ``salt`` is given, so one key's candidates never meet whole in
    one task.
    """
    if salt is not None and k > 500:
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
            .withColumn("_pre", F.row_number().over(first))
            .filter(F.col("_pre") <= k)
            .drop("_salt", "_pre")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under ``order`` (ascending, nulls first).

    An aggregate, not a window: each map task keeps one row per key, so a key
    that holds much of the data costs no more than any other.
    """
    keys = list(keys)
    ordering = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    payload = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(payload, F.struct(*ordering)).alias("_first"))
    return best.select("_first.*")
