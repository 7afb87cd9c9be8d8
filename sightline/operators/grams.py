"""Postings of three-character pieces, so that a text is found in titles without reading them all.

A value contains a text only if it contains all three-character pieces of it.
The index keeps, for every piece, the rows that hold it; a search intersects
the lists of the text's rarest pieces and looks at the rows that are left,
with the scores and the order of ``search.text_seeds``. Lists and rows are
Parquet in folders by hash, so a search opens the folders of its pieces and of
its rows only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.config import SEARCH
from sightline.functions.text import key_of
from sightline.operators.search import text_seeds
from sightline.operators.walk import firsts
from sightline.session import cut_lineage

#: Characters of a piece, and lists that a search intersects at most (fewer lists leave more rows, never fewer).
SIZE, LISTS = 3, 4
#: Rows that may be sent to the stored ones; more meet them in a shuffle.
FEW_ROWS = 100_000
#: Rows, or entries of lists, that a task of the build sorts, about.
TASK_ROWS = 250_000


def pieces_of(value: Column) -> Column:
    """The different pieces of a text; none of one that is shorter."""
    starts = F.sequence(F.lit(1), F.length(value) - (SIZE - 1))
    made = F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(SIZE))))
    return F.when(F.length(value) >= SIZE, made).otherwise(F.array().cast("array<string>"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``piece`` and ``_row`` without copies."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = firsts(batch["piece"].dictionary_encode().indices.to_numpy(), batch["_row"].to_numpy())
        ends = [(batch["piece"][i].as_py(), batch["_row"][i].as_py()) for i in (0, batch.num_rows - 1)]
        new[0] = ends[0] != last
        last = ends[1]
        yield batch.filter(pa.array(new))


class TextIndex:
    """An index in a folder: ``rows`` as they came, ``postings`` (piece, row), ``pieces`` with the length of each list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        self.fields, self.buckets = info["fields"], info["buckets"]
        self.schema = StructType.fromJson(info["schema"])

    @classmethod
    def build(cls, df: DataFrame, path: str, fields: Sequence[str], keys: Sequence[str] = ("host_type", "host_id"), buckets: int = 64) -> TextIndex:
        """Index the text of ``fields`` of every row. Rows of equal keys share a number; all of them are looked at."""
        spark, places = df.sparkSession, max(1, -(-df.count() // (buckets * TASK_ROWS)))
        numbered = df.withColumn("_row", F.xxhash64(*keys)).withColumn("_part", F.pmod(F.col("_row"), F.lit(buckets)).cast("int"))
        within = F.pmod(F.xxhash64("_row"), F.lit(places)).cast("int")
        dealt = numbered.repartitionById(buckets * places, F.col("_part") * places + within)
        dealt.sortWithinPartitions("_part", "_row").write.partitionBy("_part").parquet(f"{path}/rows")
        every = F.array_distinct(F.flatten(F.array(*[pieces_of(F.coalesce(key_of(f), F.lit(""))) for f in fields])))
        rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows").select(F.explode(every).alias("piece"), "_row")
        held = rows.withColumn("_part", cls._place(F.col("piece"), buckets))
        # A frequent piece has a long list: the folder that holds it is dealt out to as many tasks as it is long.
        sizes = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}  # at most all folders
        tasks = [max(1, -(-sizes.get(i, 0) // TASK_ROWS)) for i in range(buckets)]
        begins = [sum(tasks[:i]) for i in range(buckets)]
        own, first = (F.get(F.array(*map(F.lit, c)), F.col("_part")) for c in (tasks, begins))
        spread = held.repartitionById(sum(tasks), (first + F.pmod(F.xxhash64("_row"), own)).cast("int"))
        spread = spread.sortWithinPartitions("_part", "piece", "_row")
        # Rows that share a number repeat a piece; the copies lie together.
        spread.mapInArrow(_once, "piece string, _row bigint, _part int").write.partitionBy("_part").parquet(f"{path}/postings")
        stored = spark.read.schema("piece string, _row bigint, _part int").parquet(f"{path}/postings")
        stored.groupBy("piece").agg(F.count(F.lit(1)).alias("rows")).repartition(1).sortWithinPartitions("piece").write.parquet(f"{path}/pieces")
        info = {"fields": list(fields), "buckets": buckets, "schema": numbered.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{path}/info")
        return cls(spark, path)

    @staticmethod
    def _place(piece: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def lists(self, text: str) -> list[tuple[str, int, int]] | None:
        """(piece, rows, folder) of the text's rarest pieces; none if a piece is in no row."""
        query = text.strip().lower()
        wanted = list(dict.fromkeys(query[i : i + SIZE] for i in range(len(query) - SIZE + 1)))
        known = self.spark.read.schema("piece string, rows bigint").parquet(f"{self.path}/pieces").filter(F.col("piece").isin(wanted))
        found = known.select("piece", "rows", self._place(F.col("piece"), self.buckets).alias("part")).collect()  # one row a piece
        if len(found) < len(wanted):
            return None
        return [tuple(r) for r in sorted(found, key=lambda r: (r["rows"], r["piece"]))[:LISTS]]

    def candidates(self, text: str) -> DataFrame:
        """Numbers of the rows that hold the rarest pieces of a text of three characters or more."""
        lists = self.lists(text)
        postings = self.spark.read.schema("piece string, _row bigint, _part int").parquet(f"{self.path}/postings")
        if lists is None:
            return postings.select("_row").limit(0)
        parts, pieces = sorted({p for *_, p in lists}), [p for p, *_ in lists]
        near = postings.filter(F.col("_part").isin(parts) & F.col("piece").isin(pieces))
        return near.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(pieces)).select("_row")

    def matching(self, text: str) -> DataFrame:
        """Rows that may contain ``text``: all that do, and few others. A text shorter than a piece leaves all rows."""
        if len(text.strip()) < SIZE:
            return self._rows().drop("_row", "_part")
        wanted = cut_lineage(self.candidates(text))
        parts = [r[0] for r in wanted.select(F.pmod(F.col("_row"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most all folders
        some = F.broadcast(wanted) if wanted.count() <= FEW_ROWS else wanted
        return self._rows().filter(F.col("_part").isin(parts)).join(some, "_row", "left_semi").drop("_row", "_part")

    def seeds(self, text: str, *, limit: int = SEARCH.seed_limit) -> DataFrame:
        """The rows of ``text_seeds`` over everything indexed."""
        return text_seeds(self.matching(text), text, self.fields, limit=limit)
