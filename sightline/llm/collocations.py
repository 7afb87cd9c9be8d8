"""Phrase collocations from external count streams.

Three streams hold how often every phrase of one, two and three words occurs
in a language. They are laid out as sorted blocks: a task counts the phrases
of what it reads, sorts them by their first words, and cuts the sorted stream
into one block for each bucket of phrases. Blocks are what is shuffled; a
bucket's blocks are merged, and phrases below the least count leave the
stream. As every part of a frequent phrase is at least as frequent, what is
left holds all counts that a candidate can ask for.

The streams then lie in prefix order (first words lead) and in suffix order
(last words lead), and are merge-joined in lockstep: prefix order gives the
left counts and extensions to the right, suffix order the right counts and
extensions to the left. No table of phrases is hashed or broadcast.

A phrase goes to a bucket by all of its words and arrives at most once from
each block, so no frequent word or pair weighs on one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import plain, quoted, record
from sightline.llm.words import mixed
from sightline.session import cut_lineage

#: A chunk's blocks go out once it holds so many words, or so many different ones.
CHUNK_WORDS, CHUNK_VOCABULARY = 1 << 20, 1 << 18
SLICE_BYTES = 2 << 20
#: Bytes of text that a bucket of phrases stands for: what one merge holds.
BUCKET_BYTES = 4 << 20
#: Bytes of each text that end a piece become line feeds, blanks and tabs blanks, A-Z lower case.
_TRANSLATED = bytes(
    10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The texts translated, one after the other, in slices that end where a piece ends."""
    raw, at = b"\n".join(texts).translate(_TRANSLATED), 0
    while len(raw) - at > limit:
        cut = raw.find(b"\n", at + limit)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


class _Chunk:
    """Words as numbers, -1 where a piece ends, and the language of each."""

    def __init__(self):
        self.numbers, self.languages = _Numbers(), _Numbers()
        self.runs, self.owners, self.size = [], [], 0

    def add(self, raw: bytes, language: bytes) -> None:
        # Runs of blanks leave empty words; they and the ends of pieces are known by their own numbers.
        tokens = raw.replace(b"\n", b" \n ").split(b" ")
        run = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        empty, end = self.numbers.get(b"", -1), self.numbers.get(b"\n", -1)
        run = run[run != empty]
        run[run == end] = -1
        self.runs += [run, np.full(1, -1)]
        self.owners.append(np.full(len(run) + 1, self.languages[language]))
        self.size += len(run)

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or len(self.numbers) >= CHUNK_VOCABULARY

    def blocks(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, block) of all phrases in prefix order; the empty phrase counts the words of a language."""
        words = np.array(list(self.numbers), dtype=object)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        rank = np.empty(len(words) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(words)), -1
        run, owner = rank[np.concatenate(self.runs)], np.concatenate(self.owners)
        texts, hashes = _texts(words[order].tolist())
        tags, seeds = _texts([b"\n" + t for t in self.languages])
        inside = run >= 0
        totals = np.bincount(owner[inside], minlength=len(tags))
        found = [(tags, totals, seeds)]
        # What comes before the last word of a phrase is one number, its place among ``known``; the language leads.
        head, whole, known = owner, inside, [np.arange(len(tags))]
        for size in (1, 2, 3):
            if size > 1:
                head, whole = place[:-1], whole[:-1] & inside[size - 1 :]
            key = (head * len(words) + run[size - 1 :])[whole]
            if not len(key):
                break
            phrases, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            place = np.zeros(len(whole), np.int64)
            place[whole] = inverse
            lead, own = np.divmod(phrases, len(words))
            known = [*[p[lead] for p in known], own]
            mark = seeds[known[0]]
            for part in known[1:]:
                mark = mixed(mark * np.uint64(0x9E3779B97F4A7C15) + hashes[part])
            parts = [texts.take(pa.array(p)) for p in known[1:]]
            phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
            found.append((pc.binary_join_element_wise(phrase, tags.take(pa.array(known[0])), b""), count, mark))
        phrase, count, mark = pa.concat_arrays([f[0] for f in found]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))
        bucket = (mark % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        count, bucket = count[by_bucket], bucket[by_bucket]
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]):
            yield int(bucket[a]), packed(phrase.take(pa.array(by_bucket[a:b])), count[a:b])


def _texts(words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(words, pa.binary()), np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """A block: number of phrases, their lengths, their counts, their bytes."""
    offsets = np.frombuffer(phrases.buffers()[1], np.int32, len(phrases) + 1)
    data = phrases.buffers()[2]
    body = data[offsets[0] : offsets[-1]].to_pybytes() if data is not None else b""
    head = np.array([len(phrases)], np.int64).tobytes()
    lengths = np.diff(offsets).astype(np.int32).tobytes()
    return zstandard.compress(head + lengths + counts.astype(np.int64).tobytes() + body, 3)


def unpacked(block: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.decompress(block)
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int32, size, 8)
    counts = np.frombuffer(raw, np.int64, size, 8 + 4 * size)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    body = pa.py_buffer(raw[8 + 12 * size :])
    return pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), body]), counts


def blocks(docs: DataFrame, text: str, lang: str, buckets: int) -> DataFrame:
    """``bucket`` and ``block`` of every chunk of ``docs``; a block's phrases end with a line feed and their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chunk()

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in held.blocks(buckets):
                rows.append(row)
                if len(rows) == 512:
                    yield ready(rows)
                    rows = []
            if rows:
                yield ready(rows)

        def ready(rows: list[tuple]) -> pa.RecordBatch:
            where, block = zip(*rows)
            return record(["bucket", "block"], [pa.array(where, pa.int32()), pa.array(block, pa.binary())])

        for batch in batches:
            texts = plain(batch.column(0), pa.string()).cast(pa.binary())
            names = plain(batch.column(1), pa.string()).dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for place, name in enumerate(names.dictionary.to_pylist()):
                own = texts.take(pa.array(np.flatnonzero(which == place)))
                for a in range(0, len(own), 256):
                    for raw in _slices(own[a : a + 256].to_pylist()):
                        held.add(raw, name.encode())
                        if held.full():
                            yield from out()
                            held = _Chunk()
        if held.size:
            yield from out()

    own = docs.select(F.col(quoted(text)).alias("text"), F.coalesce(F.col(quoted(lang)), F.lit("und")).alias("lang"))
    return own.mapInArrow(run, "bucket int, block binary")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f`` of all phrases of one to three words found ``least`` times or more.

    Size 0 is the empty phrase: its count is that of all words of the language, however many there are.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    buckets = max(1, held // BUCKET_BYTES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            phrases, sums = zip(*map(unpacked, held))
            every = pa.table({"phrase": pa.concat_arrays(phrases), "f": np.concatenate(sums)})
            merged = every.group_by("phrase").aggregate([("f", "sum")])
            tagged, f = merged["phrase"].combine_chunks(), merged["f_sum"].to_numpy()
            stay = np.flatnonzero((f >= least) | pc.starts_with(tagged, b"\n").to_numpy(zero_copy_only=False))
            if len(stay):
                both = pc.split_pattern(tagged.take(pa.array(stay)).cast(pa.string()), "\n", max_splits=1)
                phrase, name = pc.list_element(both, 0), pc.list_element(both, 1)
                size = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
                yield record(["lang", "size", "phrase", "f"], [name, size, phrase, f[stay]])

        for batch in batches:
            for bucket, block in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from out()
                    now, held = bucket, []
                held.append(block)
        yield from out()

    laid = blocks(docs, text, lang, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return cut_lineage(laid.mapInArrow(merge, "lang string, size int, phrase string, f bigint"))


def _word(place: int) -> Column:
    """The word at ``place`` (from 0) of a phrase; white space other than a blank belongs to words."""
    return F.element_at(F.split("phrase", " "), place + 1)


def scored(stream: DataFrame, widest: int = 50) -> DataFrame:
    """Candidates of two and three words that no extension covers, with ``a``, ``l``, ``r`` and ``score`` of their weakest cut.

    ``stream`` is what ``counts`` returns. A candidate goes when its words lie
    in a longer one that has ``widest`` percent of its count or more.
    """
    one = stream.filter("size = 1").select("lang", F.col("phrase").alias("w"), "f")
    two = stream.filter("size = 2").select("lang", "phrase", F.col("f").alias("a"), _word(0).alias("w1"), _word(1).alias("w2"))
    three = stream.filter("size = 3").select(
        "lang", "phrase", F.col("f").alias("a"), *[_word(i).alias(f"w{i + 1}") for i in range(3)]
    )

    def meet(stream: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        return stream.join(other.hint("merge"), ["lang", *keys], how)

    # Prefix order: streams sorted by their first words meet the counts of what they begin with.
    pairs = meet(two, one.select("lang", F.col("w").alias("w1"), F.col("f").alias("l1")), ["w1"])
    triples = meet(three, one.select("lang", F.col("w").alias("w1"), F.col("f").alias("l1")), ["w1"])
    triples = meet(triples, two.select("lang", "w1", "w2", F.col("a").alias("l2")), ["w1", "w2"])
    right = three.groupBy("lang", "w1", "w2").agg(F.max("a").alias("right"))
    pairs = meet(pairs, right, ["w1", "w2"], "left")
    # Suffix order: last words lead.
    pairs = meet(pairs, one.select("lang", F.col("w").alias("w2"), F.col("f").alias("r1")), ["w2"])
    triples = meet(triples, one.select("lang", F.col("w").alias("w3"), F.col("f").alias("r2")), ["w3"])
    triples = meet(triples, two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["w2", "w3"])
    left = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("left"))
    pairs = meet(pairs, left, ["w1", "w2"], "left")
    longer = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("a", "l1", "r1")]
    pairs = pairs.filter(100 * longer < widest * F.col("a")).select(
        "lang", "phrase", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), _score(*wide).alias("score")
    )
    second = [F.col(c).cast("decimal(38,0)") for c in ("a", "l2", "r2")]
    cuts = triples.withColumns({"s1": _score(*wide), "s2": _score(*second)})
    first = F.col("s1") <= F.col("s2")
    triples = cuts.select(
        "lang",
        "phrase",
        "a",
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    return pairs.unionByName(triples)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)) in decimals of 38 digits: exact up to counts of ten quadrillions."""
    return F.call_function("div", 1_000_000 * a * a, left * right)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, widest: int = 50, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of each language: ``lang``, ``rank`` from 1, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A null text counts as empty, a null language as ``und``; without phrases
    found ``least`` times there are no rows. Repeated rows count each time.
    Ties go by count, then by the bytes of the phrase. Other columns of
    ``docs`` play no part, whatever their names.
    """
    stream = counts(docs, text, lang, least)
    total = stream.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(stream, widest).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
