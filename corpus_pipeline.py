"""A corpus pipeline: stages over the given documents, each one corpus operator.

Every stage takes all that the one before kept, is written as Parquet in the
shared folder and read again. All but the last return the columns of the
documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language, line_dedup, near_copies, word_bpe
from sightline.llm.common import fresh, quoted, table
from sightline.llm.queries import tokenizer
from sightline.session import scratch_dir, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject; the model is learned from their labels.

    Rejected are texts that are null, hold no letters, or are too far from
    every centroid of the languages learned.
    """
    ship_package(spark)
    found = language.identify(docs, language.learn(docs))
    return found.filter(~F.col("rejected")).select(*map(quoted, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines found in ten documents or more only the first occurrence stays, in the document with the smallest id.

    A document of which nothing but blank lines is left goes: all it held
    stands in others. One that had nothing to lose stays.
    """
    ship_package(spark)
    kept, lines, dropped = (fresh(docs, name) for name in ("kept", "n_lines", "n_dropped"))
    cut = line_dedup.dedup_lines(docs, least=10, shortest=1, keep="first", added=(kept, lines, dropped))
    changed = F.col(dropped) > 0
    emptied = changed & F.col(kept).rlike(r"^[\x20\x09-\x0D]*$")
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return cut.filter(~emptied).select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more), the one with the smallest id."""
    ship_package(spark)
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids by the word tokenizer, with the digests of the ids and of what they decode to."""
    ship_package(spark)
    path = tokenizer("word_bpe_49k.json")
    return word_bpe.round_trip(docs, path, word_bpe.lexicon_of(docs, path))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encoding", encode),
]

#: Clustering, random walks and the tokenizer can't be stated in SQL; tests hold every stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row for each document that is left."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
