"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sightline.session import scratch_dir

#: White space as the contracts define it: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Text handed to one numpy step; keeps a Python worker's memory independent of the Arrow batch.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A given table, with only the columns asked for."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, however it is spelled."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together (a longer text stands alone)."""
    if not len(texts):
        return
    sizes = np.diff(offsets_of(texts))
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, row
            begin, held = row, 0
        held += size
    yield begin, len(texts)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + 1 + texts.offset)
    return raw[texts.offset :].astype(np.int64)


def plain(column: pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """One array without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != kind:
        column = column.cast(kind)
    return column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text array and the offsets of its rows in them, without a copy."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function that treats batches one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def record(names: Sequence[str], arrays: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], list(names))


#: What a worker keeps between tasks of one operator: (operator, key) and the object.
_HELD: dict[tuple, object] = {}


def held(operator: str, key: tuple, make: Callable[[], object]) -> object:
    """The one object that this worker keeps for ``operator`` between tasks, made anew for another key."""
    if (operator, key) not in _HELD:
        release()
        _HELD[operator, key] = make()
    return _HELD[operator, key]


def release() -> None:
    """Give back what tasks of earlier operators have left in this worker: for tasks that need the memory themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def rewritten(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written beside the checkpoints and read back.

    Like a checkpoint, but the plan also forgets how the rows were dealt out:
    a join that follows shuffles both sides anew, so that adaptive planning
    can split a hot key.
    """
    spark, folder = df.sparkSession, f"{scratch_dir(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
