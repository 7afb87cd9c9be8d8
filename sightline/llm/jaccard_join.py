"""Texts whose sets of word shingles have a Jaccard similarity of at least a given percentage, by adaptive prefixes.

All shingles are put in one order, the rarest (by a sketch of how many texts
hold each) first. Two sets similar enough share at least ``d`` shingles among
the first ``n - t + d`` of each, ``t`` being the least overlap of a set of
``n``; one shared shingle of the shortest prefix is the plain case. A text
lengthens its prefix, up to ``MOST_SHARED`` shingles beyond that, where it
expects a longer one to leave fewer candidates: it then asks for as many more
shared shingles. A pair shares what the less demanding of its two texts asks
for, counted within both prefixes of that length; only then are the texts
verified, word by word.

Links are wanted as components. Of a shingle that few texts have in their
prefix, all pairs are candidates. One that many have marks a family: each of
its texts is first held against one neighbour per shingle, in another order
each time, which ties most of a family together. Texts that are still apart
from the family's largest part are then compared with all of it, in blocks of
bounded size, as products of incidence matrices; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import plain, quoted, record, release, slices
from sightline.llm.components import components
from sightline.llm.words import mixed
from sightline.session import cut_lineage

#: Counters of the sketch (4 bytes each) and the parts it is summed in: its size doesn't depend on the corpus.
COUNTERS, PARTS = 1 << 22, 64
#: The most shared shingles a text may ask for.
MOST_SHARED = 8
#: What a row of a prefix, a pair counted and a pair verified cost, relative to each other.
ROW_COST, PAIR_COST, VERIFY_COST = 1.0, 1.0, 40.0
#: Other texts expected to have a shingle beyond those that the sketch tells apart from chance.
UNSEEN = 0.25
#: Texts sharing a shingle that are candidates pair by pair; more are a family.
FAMILY = 24
#: In families of sets of so many shingles or more, one shingle of so many ties neighbours; smaller sets have few to spare.
TIES = ((128, 8), (32, 4), (0, 1))
#: Shingles in a block of a family; texts wanted that may be sent to the corpus instead of shuffling it.
BLOCK, FEW_TEXTS = 1 << 19, 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """64-bit numbers of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.lower().split()


def shingle_set(text: bytes, size: int) -> set[bytes]:
    """The different shingles themselves; a text of fewer words is one shingle."""
    words = words_of(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Sets:
    """Of many texts: digests of their words, and their distinct shingles' numbers in ascending order."""

    def __init__(self, texts: list[bytes], size: int, numbers: _Numbers):
        parts = [words_of(t) for t in texts]
        self.digest = [xxhash.xxh3_128_digest(b" ".join(p)) for p in parts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        hashes = np.fromiter((h for p in parts for h in map(numbers.__getitem__, p)), np.uint64, int(count.sum()))
        whole = np.maximum(count - size + 1, 0)
        start = np.cumsum(whole) - whole
        at = np.arange(whole.sum()) + np.repeat(np.cumsum(count) - count - start, whole)
        values = hashes[at] if len(at) else np.zeros(0, np.uint64)
        for place in range(1, size):
            values = mixed(values * _SPREAD + hashes[at + place])
        short = np.flatnonzero((count > 0) & (whole == 0))
        if len(short):
            own = [xxhash.xxh3_64_intdigest(b"\0" + b" ".join(parts[i])) for i in short.tolist()]
            values = np.concatenate([values, np.array(own, np.uint64)])
        owner = np.concatenate([np.repeat(np.arange(len(parts)), whole), short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(parts))

    def only(self, rows: np.ndarray) -> None:
        """Forget the shingles of other rows."""
        keep = np.zeros(len(self.sizes), bool)
        keep[rows] = True
        stay = keep[self.owner]
        self.values, self.owner = self.values[stay], self.owner[stay]
        self.sizes = np.where(keep, self.sizes, 0)


def _read(batches: Iterator[pa.RecordBatch], place: int, size: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    release()
    numbers = _Numbers()
    for batch in batches:
        texts = plain(batch.column(place), pa.string()).cast(pa.binary())
        for a, b in slices(texts):
            yield batch.slice(a, b - a), Sets(texts[a:b].to_pylist(), size, numbers)


def _first_seen(found: Sets, seen: set[bytes]) -> np.ndarray:
    """Rows with words whose digest this task hasn't met lately."""
    rows = []
    for i, digest in enumerate(found.digest):
        if found.sizes[i] and digest not in seen:
            seen.add(digest)
            rows.append(i)
    if len(seen) > 1 << 20:
        seen.clear()
    return np.array(rows, np.int64)


def surveyed(docs: DataFrame, text: str, size: int, *others: str) -> tuple[DataFrame, np.ndarray]:
    """One pass: rows with ``fp`` (digest of a text's words), ``n`` (shingles of its set) and ``c0``... (``others``); the sketch.

    The sketch tells how many texts hold the shingles of each counter (copies met by several tasks count in each).
    """
    names = [f"c{i}" for i in range(len(others))]
    kinds = [docs.schema[c].dataType for c in others]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, types = np.zeros(COUNTERS, np.uint32), set(), None
        for batch, found in _read(batches, 0, size):
            types = [c.type for c in batch.columns[1:]]
            rows = len(found.digest)
            yield record(
                ["fp", "n", "part", "counts", *names],
                [pa.array(found.digest, pa.binary()), found.sizes, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), *batch.columns[1:]],
            )
            found.only(_first_seen(found, seen))
            at, often = np.unique(found.values % np.uint64(COUNTERS), return_counts=True)
            total[at.astype(np.int64)] += often.astype(np.uint32)
        for part, some in enumerate(np.split(total, PARTS)):
            if some.any():
                packed = pa.array([zstandard.compress(some.tobytes())], pa.binary())
                empty = [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
                yield record(["fp", "n", "part", "counts", *names], [*empty, [part], packed, *[pa.nulls(1, t) for t in types]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = np.frombuffer(zstandard.decompress(counts), np.uint32).astype(np.uint64)
                held[part] = held.get(part, 0) + some
        for part, some in held.items():
            yield record(["part", "counts"], [[part], [np.minimum(some, 0xFFFFFFFF).astype(np.uint32).tobytes()]])

    schema = ", ".join(["fp binary, n bigint, part bigint, counts binary", *[f"{n} {k.simpleString()}" for n, k in zip(names, kinds)]])
    own = docs.select(F.col(quoted(text)).alias("__text"), *[F.col(quoted(c)).alias(n) for c, n in zip(others, names)])
    made = cut_lineage(own.mapInArrow(count, schema))
    parts = made.filter("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part bigint, counts binary")
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    for row in parts.collect():  # at most PARTS rows
        out[row["part"]] = np.frombuffer(row["counts"], np.uint32)
    return made.filter("part IS NULL").select("fp", "n", *names), out.ravel()


def prefixes(sizes: np.ndarray, owner: np.ndarray, rivals: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared shingles that each text asks for, length of its prefix).

    ``rivals`` holds, for every shingle in order, how many other texts are
    expected to have it. A longer prefix costs its rows and the pairs they
    meet in; it saves candidates, of which each must share more.
    """
    least = -(-percent * sizes // 100)
    start = np.cumsum(sizes) - sizes
    sums = np.concatenate([[0.0], np.cumsum(rivals)])
    best, asked = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int64)
    for shared in range(1, MOST_SHARED + 1):
        length = sizes - least + shared
        pairs = sums[start + np.minimum(length, sizes)] - sums[start]
        cost = ROW_COST * length + PAIR_COST * pairs + VERIFY_COST * pairs / shared
        better = (cost < best) & (shared <= least)
        best[better], asked[better] = cost[better], shared
    return asked, np.where(sizes > 0, sizes - least + asked, 0)


def _prefix_rows(docs: DataFrame, text: str, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``shingle``, ``level`` (prefixes asking for so many shared shingles reach it), ``asked``, ``n``, ``fp`` of all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers, whatever the corpus
    noise = float(counts.mean())
    names = ["shingle", "level", "asked", "n", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, found in _read(batches, 0, size):
            found.only(_first_seen(found, seen))
            if not len(found.values):
                continue
            known = sent.value[(found.values % np.uint64(COUNTERS)).astype(np.int64)]
            order = np.lexsort((found.values, known, found.owner))
            values, known = found.values[order], known[order]
            rivals = np.maximum(known - 1.0 - noise, 0.0) + UNSEEN
            asked, length = prefixes(found.sizes, found.owner, rivals, percent)
            place = np.arange(len(values)) - np.repeat(np.cumsum(found.sizes) - found.sizes, found.sizes)
            # A counter of one is this text's own: no other has the shingle.
            out = np.flatnonzero((place < length[found.owner]) & (known > 1))
            rows = found.owner[out]
            level = np.maximum(place[out] + 1 - (length - asked)[rows], 1)
            fp = pa.array(found.digest, pa.binary()).take(pa.array(rows))
            yield record(
                names, [values[out].view(np.int64), level.astype(np.int8), asked[rows].astype(np.int8), found.sizes[rows].astype(np.int32), fp]
            )

    return docs.select(F.col(quoted(text))).mapInArrow(run, "shingle bigint, level tinyint, asked tinyint, n int, fp binary")


def _meet(percent: int, most: int):
    """Over rows sorted by shingle: pairs ``a``, ``b`` with what they ask for; of families the members, and one neighbour each."""
    names = ["a", "b", "asked", "near", "family"]

    def group(level, asked, n, fp: list[bytes]) -> tuple[list, list, list]:
        low, high = np.triu_indices(len(fp), 1)
        need = np.minimum(asked[low], asked[high])
        ok = (np.maximum(level[low], level[high]) <= need) & (100 * np.minimum(n[low], n[high]) >= percent * np.maximum(n[low], n[high]))
        low, high, need = low[ok], high[ok], need[ok]
        return [fp[i] for i in low.tolist()], [fp[i] for i in high.tolist()], need.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, large, last = None, [], False, None
        a, b, need, near, family = [], [], [], [], []

        def close(end: bool) -> None:
            """Take what is held of the shingle ``now``; ``end`` when it has no more rows."""
            nonlocal rows, large, last
            if not large and len(rows) <= most:
                if len(rows) > 1:
                    fp = [r[3] for r in rows]
                    own = group(*(np.array(c) for c in list(zip(*rows))[:3]), fp)
                    a.extend(own[0]), b.extend(own[1]), need.extend(own[2])
                    near.extend([False] * len(own[0])), family.extend([None] * len(own[0]))
            else:
                large = True
                salt = now.to_bytes(8, "little", signed=True)
                turn = sorted((r[3] for r in rows), key=lambda f: xxhash.xxh3_64_intdigest(f + salt))
                least = min((r[2] for r in rows), default=0)
                if now % next(one_of for size, one_of in TIES if least >= size) == 0:
                    for one, other in zip([last, *turn[:-1]] if last else turn, turn if last else turn[1:]):
                        a.append(min(one, other)), b.append(max(one, other))
                a.extend(turn), b.extend([None] * len(turn))
                family.extend([None] * (len(a) - len(family) - len(turn)) + [now] * len(turn))
                need.extend([0] * (len(a) - len(need))), near.extend([True] * (len(a) - len(near)))
                last = turn[-1] if turn else last
            rows = []
            if end:
                large, last = False, None

        def out() -> pa.RecordBatch:
            made = record(
                names, [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(need, pa.int32()), pa.array(near, pa.bool_()), pa.array(family, pa.int64())]
            )
            for column in (a, b, need, near, family):
                column.clear()
            return made

        for batch in batches:
            shingle = batch.column(0).to_numpy()
            columns = [c.to_pylist() for c in batch.columns[1:]]
            # Shingles met once, and not next to this batch's ends, have no partner.
            alone = np.zeros(len(shingle), bool)
            alone[1:-1] = (shingle[1:-1] != shingle[:-2]) & (shingle[1:-1] != shingle[2:])
            for i in np.flatnonzero(~alone).tolist():
                key = int(shingle[i])
                if key != now:
                    if rows or large:
                        close(True)
                    now, rows, large, last = key, [], False, None
                row = (columns[0][i], columns[1][i], columns[2][i], columns[3][i])
                if rows and rows[-1][3] == row[3] or not rows and last == row[3]:
                    continue  # the same text, from another part of the corpus
                rows.append(row)
                if len(rows) >= 4096:
                    close(False)
            if len(a) >= 1 << 14:
                yield out()
        if rows or large:
            close(True)
        if a:
            yield out()

    return run


def _verify(size: int, percent: int):
    """Over (a, b, left, right): the pairs whose texts are similar, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: tuple = (None, set())
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in (0, 1)]
            texts = [plain(batch.column(i), pa.string()).cast(pa.binary()) for i in (2, 3)]
            stay = []
            for i, a in enumerate(keys[0]):
                if a != one[0]:
                    one = (a, shingle_set(texts[0][i].as_py(), size))
                other = shingle_set(texts[1][i].as_py(), size)
                both = len(one[1] & other)
                if 100 * both >= percent * (len(one[1]) + len(other) - both):
                    stay.append(i)
            yield record(["a", "b"], [pa.array([k[i] for i in stay], pa.binary()) for k in keys])

    return run


def _apart(size: int, percent: int):
    """Of one block of a family: links of its probes that join what is apart."""

    def run(table: pa.Table) -> pa.Table:
        found = Sets(plain(table["text"], pa.string()).cast(pa.binary()).to_pylist(), size, _Numbers())
        fp, label = table["fp"].to_pylist(), table["label"].to_pylist()
        probe = np.flatnonzero(table["probe"].to_numpy(zero_copy_only=False))
        target = np.flatnonzero(~table["probe"].to_numpy(zero_copy_only=False))
        known, number, often = np.unique(found.values, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often > 1)
        place = np.full(len(known), -1)
        place[shared] = np.arange(len(shared))
        column = place[number]
        lead = {x: x for x in label}

        def root(x):
            while lead[x] != x:
                lead[x] = lead[lead[x]]
                x = lead[x]
            return x

        def matrix(rows: np.ndarray, low: int, high: int) -> np.ndarray:
            at = np.full(len(found.sizes), -1)
            at[rows] = np.arange(len(rows))
            own = (column >= low) & (column < high) & (at[found.owner] >= 0)
            out = np.zeros((len(rows), high - low), np.float32)
            out[at[found.owner[own]], column[own] - low] = 1
            return out

        links: list[tuple[bytes, bytes]] = []
        width = 2048
        for at in range(0, len(probe), 512):
            some = probe[at : at + 512]
            both = np.zeros((len(some), len(target)), np.float32)
            for low in range(0, len(shared), width):
                high = min(low + width, len(shared))
                both += matrix(some, low, high) @ matrix(target, low, high).T
            union = found.sizes[some][:, None] + found.sizes[target][None, :] - both
            for i, j in zip(*np.nonzero(100 * both >= percent * union)):
                one, other = root(label[some[i]]), root(label[target[j]])
                if one != other:
                    lead[max(one, other)] = min(one, other)
                    links.append((fp[some[i]], fp[target[j]]))
        return pa.table([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp``, ``text`` of the texts wanted, each once; few enough are sent to the corpus, more meet it in a shuffle."""
    wanted = cut_lineage(wanted.distinct())
    if wanted.count() <= FEW_TEXTS:
        wanted = F.broadcast(wanted)
    return cut_lineage(texts.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")))


def digested(docs: DataFrame, text: str, *others: str) -> DataFrame:
    """``fp`` (digest of the text's words) and ``c0``... (the columns ``others``) of every row of ``docs``."""
    names = [f"c{i}" for i in range(len(others))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(0), pa.string()).cast(pa.binary())
            yield record(["fp", *names], [pa.array([digest(t.as_py()) for t in texts], pa.binary()), *batch.columns[1:]])

    own = docs.select(F.col(quoted(text)).alias("__text"), *[F.col(quoted(c)).alias(n) for c, n in zip(others, names)])
    return own.mapInArrow(run, ", ".join(["fp binary", *[f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, others)]]))


def digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words_of(text)))


def classes(
    docs: DataFrame,
    text: str = "text",
    size: int = 3,
    percent: int = 90,
    proposed: DataFrame | None = None,
    counts: np.ndarray | None = None,
) -> DataFrame:
    """``fp`` (digest of a text's words) and ``label`` (the smallest digest reachable by links) of every text that has links.

    Pairs ``proposed`` by another method (``a``, ``b``) are verified first, so
    that what they link needs no further comparison. ``counts`` is the sketch,
    if it has been made.
    """
    if counts is None:
        _, counts = surveyed(docs, text, size)
    rows = _prefix_rows(docs, text, size, percent, counts).repartition("shingle").sortWithinPartitions("shingle", "fp")
    met = cut_lineage(rows.mapInArrow(_meet(percent, FAMILY), "a binary, b binary, asked int, near boolean, family bigint"))
    pairs = (
        met.filter("b IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.max("near").alias("near"), F.min("asked").alias("asked"), F.sum(F.expr("int(not near)")).alias("shared"))
        .filter("near OR shared >= asked")
    )
    pairs = pairs.select("a", "b", "near")
    if proposed is not None:
        pairs = pairs.unionByName(proposed.select("a", "b", F.lit(True).alias("near"))).groupBy("a", "b").agg(F.max("near").alias("near"))
    pairs = cut_lineage(pairs)
    family = met.filter("b IS NULL").select("family", F.col("a").alias("fp"))
    texts = digested(docs, text, text).select("fp", F.col("c0").alias("text"))
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(family.select("fp"))
    held = _texts_of(texts, wanted)

    def similar(some: DataFrame) -> DataFrame:
        sides = some.join(held.toDF("a", "left"), "a").join(held.toDF("b", "right"), "b")
        return cut_lineage(sides.select("a", "b", "left", "right").mapInArrow(_verify(size, percent), "a binary, b binary"))

    # One link for each text first; most of a group then is one component, and only what is apart is compared further.
    label = cut_lineage(components(similar(_one_each(pairs))).toDF("fp", "label"))
    label = _joined(label, similar(_different(pairs, label)))
    return _joined(label, _families(family, held, label, size, percent))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only those that the links join are looked at again."""
    if links.isEmpty():
        return label
    one, other = label.toDF("a", "label_a"), label.toDF("b", "label_b")
    short = links.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    top = cut_lineage(components(short).toDF("label", "top"))
    moved = label.join(top, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))
    alone = top.join(label.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("fp"), F.col("top").alias("label"))
    return cut_lineage(moved.unionByName(alone))


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of each text the neighbours in families, and its pair with the least other text."""
    least = pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", "b")
    most = pairs.groupBy("b").agg(F.max("a").alias("a")).select("a", "b")
    return pairs.filter("near").select("a", "b").unionByName(least).unionByName(most).distinct()


def _different(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs that lie in different components so far."""
    return (
        pairs.filter("not near")
        .join(label.toDF("a", "label_a"), "a", "left")
        .join(label.toDF("b", "label_b"), "b", "left")
        .filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        .select("a", "b")
    )


def _families(family: DataFrame, held: DataFrame, label: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within families between what is still apart: every text outside a family's largest part meets all of it."""
    members = cut_lineage(family.join(label, "fp", "left").select("family", "fp", F.coalesce("label", "fp").alias("label")))
    parts = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("texts"))
    largest = parts.groupBy("family").agg(
        F.max_by("label", F.struct("texts", "label")).alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    # The shingles of one family mostly have the same largest part: they are compared together, each text once.
    mixed_ = members.join(largest.filter("parts > 1"), "family").select(F.col("largest").alias("family"), "fp", "label").distinct()
    open_ = mixed_.join(held, "fp").withColumn("largest", F.col("family"))
    # Blocks by the bytes of texts, of which a shingle takes a few.
    weight = open_.groupBy("family").agg(
        F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(F.col("label") != F.col("largest"), F.octet_length("text")).otherwise(0)).alias("outside")
    )
    blocks = [F.ceil(F.col(c) / (BLOCK * 6)).cast("int").alias(n) for c, n in (("all", "n_all"), ("outside", "n_out"))]
    open_ = open_.join(weight.select("family", *blocks), "family")
    place = F.xxhash64("fp")
    own = [F.col(c) for c in ("family", "fp", "label", "text")]
    every = F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i")
    targets = open_.select(*own, F.lit(False).alias("probe"), every, F.pmod(place, "n_all").alias("j"))
    reach = F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j")
    probes = open_.filter("label <> largest").select(*own, F.lit(True).alias("probe"), F.pmod(place, "n_out").alias("i"), reach)
    both = targets.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}).unionByName(
        probes.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})
    )
    made = both.groupBy("family", "i", "j").applyInArrow(_apart(size, percent), "a binary, b binary")
    return cut_lineage(made.distinct())


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of every row of ``docs``.

    Texts of the same words are linked. A text without words (null, empty,
    blanks alone) has an empty set and no links: it is its own component.
    Repeated keys stay rows of their own; a null key counts for no component,
    and among null keys alone the id is null. Without rows there are none.
    """
    rows, counts = surveyed(docs, text, size, key)
    worded = rows.filter("n > 0")
    own = worded.groupBy("fp").agg(F.min("c0").alias("least"))
    label = classes(docs, text, size, percent, counts=counts)
    labelled = cut_lineage(own.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_text = labelled.join(smallest, "label").select("fp", "component_id")
    linked = worded.join(of_text, "fp").select("c0", "n", "component_id")
    alone = rows.filter("n = 0").select("c0", "n", F.col("c0").alias("component_id"))
    return linked.unionByName(alone).toDF(key, "n_shingles", "component_id")
