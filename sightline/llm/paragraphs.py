"""Passages that repeat across documents: MinHash banding over paragraphs.

Paragraphs are cut by content, not by layout: one begins where the hash of
two neighbouring words is the smallest among ``reach`` words to either side.
A passage copied into the middle of another text thus falls into the same
paragraphs as in its source, except at its two ends. Paragraphs are compared
as sets of five-word shingles: equal ones by their hash, similar ones by
MinHash bands tuned to a target recall, with the Jaccard similarity of every
colliding pair computed exactly. Components of similar paragraphs found in
several documents repeat; consecutive repeated paragraphs of a document make
up a passage, and all occurrences but the first are removals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import offsets_of, plain, quoted, raw_bytes, record, rewritten, slices
from sightline.llm.components import components
from sightline.llm.words import mixed, sequences, words

#: Words to either side among which a paragraph's first has the smallest hash; words of a shingle.
REACH, SHINGLE = 6, 5
SIMILARITY, RECALL = 0.8, 0.95
#: Words of repeated paragraphs in a row that make a passage: a copied passage of fifty words holds about thirty in
#: whole paragraphs, a line of a dozen words never as many as this.
PASSAGE_WORDS = 16
#: Different paragraphs of a bucket that are compared pair by pair as they come; more go the way of ``_dense``.
FAMILY = 48


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """Bands of ``rows`` values each that find a pair of that similarity with at least that chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9)


def _least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


class Cut:
    """Paragraphs of a batch of texts: ranges of words, and of the batch's texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, reach: int = REACH):
        self.words = found = words(raw, offsets)
        n, bounds = len(found.hashes), found.bounds
        nothing = np.uint64(2**64 - 1)
        pairs = mixed(found.hashes + np.roll(found.hashes, -1) * np.uint64(3))
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        pairs[last] = nothing  # the last word of a text has no pair
        # A gap between texts as wide as the reach keeps them apart.
        filled = np.full(n + reach * (len(bounds) + 1), nothing, np.uint64)
        at = np.arange(n) + reach * (found.owner + 1)
        filled[at] = pairs
        left, right = filled.copy(), filled.copy()
        left[1:], right[:-1] = filled[:-1], filled[1:]
        left[:1], right[-1:] = nothing, nothing
        low, high = left.copy(), right.copy()
        for _ in range(reach - 1):
            low[1:], high[:-1] = low[:-1].copy(), high[1:].copy()
            left, right = np.minimum(left, low), np.minimum(right, high)
        begins = (pairs < left[at]) & (pairs <= right[at]) & (pairs != nothing)
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        self.begin = np.flatnonzero(begins)
        self.end = np.append(self.begin[1:], n)
        self.owner = found.owner[self.begin] if n else np.zeros(0, np.int64)
        first = np.searchsorted(self.begin, bounds[:-1])
        self.number = np.arange(len(self.begin)) - first[self.owner]
        self.first_word = self.begin - bounds[self.owner]
        self.hash = sequences(found.hashes, self.begin, self.end)

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit shingles, paragraph of each), sorted and distinct within each paragraph; short ones are one shingle."""
        length = self.end - self.begin
        number = np.maximum(length - size + 1, 1)
        owner = np.repeat(np.arange(len(length)), number)
        at = np.repeat(self.begin - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        values = sequences(self.words.hashes, at, np.minimum(at + size, self.end[owner])) >> np.uint64(32)
        both = np.unique(owner.astype(np.uint64) << np.uint64(32) | values)
        return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, Cut]]:
    for batch in batches:
        texts = plain(batch.column(place), pa.string())
        for a, b in slices(texts):
            yield batch.slice(a, b - a), Cut(*raw_bytes(texts[a:b]))


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, cut in _each(batches, 1):
        if len(cut.begin):
            yield record(
                ["doc", "number", "first_word", "n_words", "p"],
                [
                    batch.column(0).take(pa.array(cut.owner)),
                    cut.number.astype(np.int32),
                    cut.first_word.astype(np.int32),
                    (cut.end - cut.begin).astype(np.int32),
                    cut.hash.view(np.int64),
                ],
            )


def _banded(number: int, similarity: float):
    """Rows (key, p, shingles) of the paragraphs that can be similar to a different one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut in _each(batches, 1):
            if not len(cut.begin):
                continue
            values, owner = cut.shingles()
            start = np.searchsorted(owner, np.arange(len(cut.begin)))
            sizes = np.diff(np.append(start, len(owner)))
            # Two different sets of n and more shingles share n of n + 1 at best.
            fit = np.flatnonzero(sizes >= similarity * (sizes + 1) - 1e-9)
            _, once = np.unique(cut.hash[fit], return_index=True)
            fit = fit[once]
            if not len(fit):
                continue
            raw = values.astype("<u4").tobytes()
            sets = [raw[4 * a : 4 * (a + n)] for a, n in zip(start[fit].tolist(), sizes[fit].tolist())]
            for band in range(number):
                least = np.minimum.reduceat(mixed(values.astype(np.uint64), band + 1), start)[fit]
                yield record(["key", "p", "shingles"], [least.view(np.int64), cut.hash[fit].view(np.int64), sets])

    return run


def similar(a: np.ndarray, b: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sets (numbers into ``start`` and ``size`` over ``flat``) have at least that Jaccard similarity."""
    shared = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        keys = []
        for side in (x, y):
            n = size[side]
            ends = np.cumsum(n)
            places = np.repeat(start[side] - (ends - n), n) + np.arange(int(ends[-1]))
            keys.append(np.repeat(np.arange(len(side), dtype=np.uint64), n) << np.uint64(32) | flat[places])
        both = np.sort(np.concatenate(keys))  # sets hold a shingle once, so a repeated key is a shared one
        same = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
        shared[at : at + len(x)] = np.bincount(same.astype(np.int64), minlength=len(x))
    return shared >= least * (size[a] + size[b] - shared) - 1e-9


def _family_links(p: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs of one large bucket would connect.

    Sets are ordered by how rare their shingles are here; two similar ones
    share a shingle among the rarest of both. Pairs already connected give no
    further link, so there are fewer links than paragraphs.
    """
    count: dict[int, int] = {}
    for own in sets:
        for s in own.tolist():
            count[s] = count.get(s, 0) + 1
    lead = list(range(len(p)))

    def root(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    index: dict[int, list[int]] = {}
    held = [frozenset(own.tolist()) for own in sets]
    out = []
    for i, own in enumerate(held):
        ranked = sorted(own, key=lambda s: (count[s], s))
        prefix = ranked[: len(ranked) - _least_shared(len(ranked), least) + 1]
        for j in {j for s in prefix for j in index.get(s, ())}:
            if root(i) != root(j):
                shared = len(own & held[j])
                if shared >= least * (len(own) + len(held[j]) - shared) - 1e-9:
                    lead[root(i)] = root(j)
                    out.append((int(p[j]), int(p[i])))
        for s in prefix:
            index.setdefault(s, []).append(i)
    return out


def _compare(least: float, dense: bool):
    """Over rows sorted by (key, p): links (a, b). Large buckets give their members (a, null, shingles), or with
    ``dense`` are settled here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, p, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal key, p, sets
            n = len(key)
            if not n:
                return
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, n))
            cut = n if last else int(begin[-1])
            run_of = np.repeat(size, size)
            members = np.flatnonzero((run_of > FAMILY)[:cut])
            if not last and not dense and n - cut > 4 * FAMILY:
                members = np.concatenate([members, np.arange(cut, n - 2 * FAMILY)])
                cut = n - 2 * FAMILY
            offsets = offsets_of(sets)
            flat = np.frombuffer(sets.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4").astype(np.uint64)
            start, length = (offsets[:-1] - offsets[0]) // 4, np.diff(offsets) // 4
            place = np.arange(n) - np.repeat(begin, size)
            pairs = []
            for d in range(1, FAMILY):
                at = np.flatnonzero((place[:cut] >= d) & (run_of[:cut] <= FAMILY))
                if not len(at):
                    break
                at = at[p[at] != p[at - d]]
                at = at[np.minimum(length[at], length[at - d]) >= least * np.maximum(length[at], length[at - d]) - 1e-9]
                if len(at):
                    ok = similar(at - d, at, flat, start, length, least)
                    pairs.append(np.stack([p[at - d][ok], p[at][ok]]))
            if dense and len(members):
                for b, s in zip(begin[size > FAMILY].tolist(), size[size > FAMILY].tolist()):
                    if b < cut:
                        own = [flat[start[i] : start[i] + length[i]] for i in range(b, b + s)]
                        found = _family_links(p[b : b + s], own, least)
                        if found:
                            pairs.append(np.array(found, np.int64).T)
                members = members[:0]
            both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=1)
            if both.shape[1] + len(members):
                links = both.shape[1]
                a = np.concatenate([both[0], p[members]])
                b = pa.array(np.concatenate([both[1], p[members]]), mask=np.arange(len(a)) >= links)
                held = pa.concat_arrays([pa.nulls(links, pa.binary()), sets.take(pa.array(members))])
                yield record(["a", "b", "shingles"], [a, b, held])
            key, p, sets = key[cut:], p[cut:], pa.concat_arrays([sets[cut:]])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            p = np.concatenate([p, batch.column(1).to_numpy()])
            # Every part of the corpus hands in its own copy of a paragraph; they are neighbours here.
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1])])
            key, p, sets = key[new], p[new], pa.concat_arrays([sets, batch.column(2)]).filter(pa.array(new))
            if len(key) >= 1 << 15:
                yield from out(False)
        yield from out(True)

    return run


_LINKS = "a bigint, b bigint, shingles binary"


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "p")


def _dense(members: DataFrame, least: float) -> DataFrame:
    """Links among members of large buckets, by their rarest shingles.

    Sets are ordered by how many members hold each shingle. Similar sets share
    one of the first few, which for paragraphs that merely have a common line
    are their own words, so the large bucket falls apart; what stays together
    is similar indeed.
    """
    members = rewritten(members.groupBy(F.col("a").alias("p")).agg(F.first("shingles").alias("shingles")), "dense")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(own, "<u4").astype(np.int64)
                yield record(["p", "s"], [np.full(len(values), p, np.int64), values])

    each = members.mapInArrow(listed, "p bigint, s bigint")
    often = rewritten(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "often")
    ranked = each.join(often, "s").groupBy("p").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("ranked"))
    prefix = F.size("ranked") - F.ceil(F.size("ranked") * least - 1e-9) + 1
    keyed = ranked.select("p", F.explode(F.slice("ranked", F.lit(1), prefix.cast("int"))).alias("x")).select("p", F.col("x.s").alias("key"))
    return _bucketed(keyed.join(members, "p").select("key", "p", "shingles")).mapInArrow(_compare(least, True), _LINKS)


def paragraph_links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Links (``a``, ``b``) between hashes of different paragraphs that are similar."""
    rows = docs.select(F.lit(0).alias("none"), text).mapInArrow(
        _banded(bands(similarity, recall), similarity), "key bigint, p bigint, shingles binary"
    )
    found = rewritten(_bucketed(rows).mapInArrow(_compare(similarity, False), _LINKS), "links")
    near = found.filter(F.col("b").isNotNull()).select("a", "b")
    return near.unionByName(_dense(found.filter(F.col("b").isNull()), similarity).select("a", "b")).distinct()


def passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = PASSAGE_WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row for each repeated passage of each document, the first occurrences included.

    ``key``, ``first_word`` and ``n_words`` (where the passage stands), of
    them ``n_removed`` words that occur in an earlier document, ``n_paragraphs``,
    ``component_id`` (of its first paragraph) and ``source_id``, the smallest
    key among the documents its paragraphs come from first.

    A passage is a run of repeated paragraphs of ``least_words`` words or
    more. A paragraph repeats if its component has paragraphs of two
    different keys; repeats within one document alone don't count. Rows with
    a null key take no part, since no row could name them; rows that repeat a
    key are one document. Null and empty texts have no paragraphs.
    """
    named = docs.filter(F.col(quoted(key)).isNotNull()).select(F.col(quoted(key)).alias("doc"), F.col(quoted(text)).alias("text"))
    kind = named.schema["doc"].dataType.simpleString()
    table = rewritten(
        named.mapInArrow(_table, f"doc {kind}, number int, first_word int, n_words int, p bigint"), "paragraphs"
    )
    own = table.groupBy("p").agg(
        F.min(F.struct("doc", "number")).alias("first"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    labels = components(paragraph_links(named, "text", similarity, recall)).withColumnRenamed("node", "p")
    labels = rewritten(labels, "labels")
    linked = own.join(labels, "p")
    of_label = linked.groupBy("label").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    near = labels.join(rewritten(of_label, "classes"), "label").select("p", "label", "first", "low", "high")
    alone = own.filter(F.col("low") < F.col("high")).join(labels, "p", "left_anti").select("p", F.col("p").alias("label"), "first", "low", "high")
    repeated = rewritten(near.unionByName(alone).filter(F.col("low") < F.col("high")), "repeated")
    hits = table.join(repeated, "p").select(
        "doc",
        "number",
        "first_word",
        "n_words",
        "label",
        F.col("first.doc").alias("source"),
        ((F.col("first.doc") == F.col("doc")) & (F.col("first.number") == F.col("number"))).alias("is_first"),
    )
    run = F.col("number") - F.row_number().over(Window.partitionBy("doc").orderBy("number"))
    grouped = hits.withColumn("run", run).groupBy("doc", "run").agg(
        F.min("first_word").alias("first_word"),
        F.sum("n_words").alias("n_words"),
        F.sum(F.when(~F.col("is_first"), F.col("n_words")).otherwise(0)).alias("n_removed"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.min_by("label", "number").alias("component_id"),
        F.min("source").alias("source_id"),
    )
    return grouped.filter(F.col("n_words") >= least_words).select(
        F.col("doc").alias(key), "first_word", "n_words", "n_removed", "n_paragraphs", "component_id", "source_id"
    )
