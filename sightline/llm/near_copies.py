"""Near copies of whole texts: five-word shingles with a Jaccard similarity of 0.8 or more.

SimHash proposes (``simhash``: fingerprints of five-word shingles, all pairs
within four bits), which finds copies that are hardly touched. Pairs that are
similar enough but further apart in bits come from the Jaccard join, which
misses none. Whatever proposes a pair, the words of both texts decide. Texts
of the same words are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import jaccard_join, simhash
from sightline.llm.common import fresh, plain, quoted, record, release, slices
from sightline.session import cut_lineage

SHINGLE, PERCENT, RADIUS = 5, 80, 4


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (``a``, ``b``, digests of words) that SimHash links: of each fingerprint one text stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column(0), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                own = {jaccard_join.digest(t): simhash.fingerprint(t, SHINGLE) for t in texts[a:b].to_pylist() if t.strip()}
                if own:
                    signed = [f - (1 << 64) if f >> 63 else f for f in own.values()]
                    yield record(["digest", "fp"], [pa.array(list(own), pa.binary()), pa.array(signed, pa.int64())])

    prints = cut_lineage(docs.select(quoted(text)).mapInArrow(run, "digest binary, fp bigint").distinct())
    least = prints.groupBy("fp").agg(F.min("digest").alias("lead"))
    same = prints.join(least, "fp").filter("digest <> lead").select(F.col("lead").alias("a"), F.col("digest").alias("b"))
    met = simhash.links(least.select("fp"), RADIUS)
    other = met.join(least.toDF("a", "one"), "a").join(least.toDF("b", "other"), "b")
    pairs = other.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
    return cut_lineage(same.unionByName(pairs).distinct())


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``fp`` (digest of words) and ``label`` of every text that has near copies, as all similar pairs connect them."""
    return jaccard_join.classes(docs, text, SHINGLE, PERCENT, proposals(docs, text))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest key.

    Texts without words (null, empty, blanks alone) are one text, of which one
    row stays. Rows with a null key all stay: nothing tells which of them came
    first. Of rows that repeat a key, those in groups that others lead go;
    different texts that each lead a group of their own stay.
    """
    named, digest = docs.filter(F.col(quoted(key)).isNotNull()), fresh(docs, "digest")
    columns, place = docs.columns, docs.columns.index(text)
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in columns)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(place), pa.string()).cast(pa.binary())
            own = [jaccard_join.digest(t.as_py()) for t in texts]
            yield record([*columns, digest], [*batch.columns, pa.array(own, pa.binary())])

    own = jaccard_join.digested(named, text, key).groupBy("fp").agg(F.min("c0").alias("key"))
    label = classes(named, text)
    first = (
        own.join(label, "fp", "left")
        .groupBy(F.coalesce("label", "fp").alias("label"))
        .agg(F.min(F.struct("key", "fp")).alias("first"))
        .select(F.col("first.key").alias(key), F.col("first.fp").alias(digest))
    )
    rows = named.mapInArrow(marked, f"{schema}, {quoted(digest)} binary")
    kept = rows.join(first, [key, digest], "left_semi").dropDuplicates([key, digest])
    return kept.select(*map(quoted, docs.columns)).unionByName(docs.filter(F.col(quoted(key)).isNull()))
