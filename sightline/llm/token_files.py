"""Token ids of a corpus as ORC files in ascending document order.

Integers are run-length encoded within stripes; the row index and the Bloom
filters on document ids let a reader skip stripes and row groups. Files hold
disjoint ascending ranges of ids, are cut into stripes that are read in
parallel. A row holds its id, its place in the file's sequence of ids, and its
ids; where a document starts in the whole sequence is its place plus the
lengths of the files before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.byte_bpe import encoder
from sightline.llm.common import by_batch, plain, record, slices
from sightline.session import cut_lineage

#: Bytes of a stripe, rows of an index entry, false positives of the Bloom filter.
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 16 << 20, 1000, 0.01


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id``, ``place`` and ``tokens`` of every text (null: empty), closed by the id ``end``.

    ``place`` counts the ids of the rows before in the same partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, before = encoder(path), 0
        for batch in batches:
            texts = plain(batch.column(1), pa.string())
            for a, b in slices(texts):
                ids, counts = library.encode(texts[a:b])
                ends = np.cumsum(counts)
                closed = np.insert(ids, ends, end)  # the end id behind each document
                offsets = np.concatenate([[0], ends + np.arange(1, b - a + 1)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(closed.astype(np.int32)))
                yield record(["doc_id", "place", "tokens"], [batch.column(0)[a:b], before + offsets[:-1].astype(np.int64), tokens])
                before += int(offsets[-1])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, place bigint, tokens array<int>")


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` dealt into ``parts`` ascending ranges of ``doc_id``, sorted; null ids come first.

    The bounds come from the ids alone, so the texts are read and moved once.
    Rows that repeat an id stay side by side.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []))
    step = max(1, int(len(bounds) ** 0.5))

    def held(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    at = F.lit(0)
    if bounds:  # how many bounds lie at or below the id: first among every step-th, then among those that follow
        coarse = at_most(held(bounds[step - 1 :: step])) * step
        at = F.when(F.col("doc_id").isNull(), 0).otherwise(coarse + at_most(F.slice(held(bounds), coarse + 1, step)))
    ranged = docs.withColumn("_part", at.cast("int"))
    return ranged.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions("doc_id", "text").drop("_part")


def write(docs: DataFrame, folder: str, path: str, end: int, parts: int) -> None:
    """Encode ``docs`` and write the ORC files; an empty table gives no rows."""
    (
        encoded(in_ranges(docs.select("doc_id", "text"), parts), path, end)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``place`` (within its file) and ``tokens``; filters on ``doc_id`` skip stripes and row groups."""
    return spark.read.schema("doc_id bigint, place bigint, tokens array<int>").orc(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, read from the files.

    The crc is that of the document's ids as little-endian unsigned 32-bit
    integers. One number for each file passes through the driver; no task
    sorts or sums the corpus.
    """

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column(2)
        offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1 + tokens.offset)[tokens.offset :].tolist()
        raw = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8).data
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        names = ["file", "doc_id", "place", "n_tokens", "ids_crc32"]
        return record(names, [batch.column(3), *batch.columns[:2], np.diff(offsets).astype(np.int64), crcs])

    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file")
    rows = cut_lineage(
        read(spark, folder)
        .select("doc_id", "place", "tokens", part)
        .mapInArrow(run, "file int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    )
    before, bases = 0, []
    for r in sorted(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()):
        bases.append((r["file"], before))
        before += r["n"]
    joined = rows.join(spark.createDataFrame(bases, "file int, base bigint"), "file")
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
