"""Near duplicates by SimHash, found by meeting in the middle.

Two fingerprints within ``radius`` bits meet if each emits every variant
within half the radius: some variant is on both lists. Emitting all of them
takes 2,081 variants of 64 bits for radius 4. The bits are therefore cut in
``parts``: of three thirds, the two with fewest differences hold at most half
of them, so for each pair of thirds (the other one masked) it is enough to
meet within half of that: 131 variants in all, and nothing is missed. Variants
are shuffled, fingerprints that share one are held against each other in full,
and links go to connected components. ``parts=1`` is the plain ball.

Many different fingerprints that all share a variant (a dense family) aren't
compared pair by pair: they emit their plain balls, where sharing a variant
of all 64 bits is proof of a link, and neighbours in the shuffled order are
linked as a chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import plain, quoted, record, slices
from sightline.llm.components import components
from sightline.session import cut_lineage

SEED = 42
#: Fingerprints sharing a variant that are compared pair by pair; more are linked by their plain balls.
FAMILY = 48


def fingerprint(text: bytes, words: int = 4) -> int:
    """Of one text: a bit is set if it is set in over half of the shingles' hashes; no words: zero."""
    parts = text.lower().split()  # bytes: lower-cases A-Z and splits at the six ASCII blanks only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    # Counts of set bits in blocks that fit a byte, then in full.
    count, whole = np.zeros(64, np.int64), len(bits) // 255 * 255
    if whole:
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    count += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``key`` and ``fp`` (long, the 64 bits as they are) of every text; a null text has no words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                found = np.array([fingerprint(t, words) for t in texts[a:b].to_pylist()], np.uint64).view(np.int64)
                yield record([key, "fp"], [batch.column(0)[a:b], found])

    return docs.select(key, text).mapInArrow(run, f"{quoted(key)} {kind}, fp bigint")


def masks(parts: int, radius: int) -> tuple[list[int], int]:
    """Bits kept by each way of leaving out the worst part, and the radius left among them."""
    if parts == 1:
        return [(1 << 64) - 1], radius
    bounds = [64 * i // parts for i in range(parts + 1)]
    own = [(1 << bounds[i + 1]) - (1 << bounds[i]) for i in range(parts)]
    # The worst of n parts holds at least radius/n of the differences.
    return [sum(o for o in own if o != out) for out in own], radius - -(-radius // parts)


def ball(mask: int, reach: int) -> list[int]:
    """All patterns of at most ``reach`` bits within ``mask``."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for n in range(reach + 1) for c in combinations(bits, n)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(fps: DataFrame, parts: int, radius: int) -> DataFrame:
    """``fp`` and each ``variant`` it emits, with the number of the mask in ``way``."""
    kept, rest = masks(parts, radius)
    reach = -(-rest // 2)
    patterns = [(way, m, np.array(ball(m, reach), np.uint64)) for way, m in enumerate(kept)]
    width = sum(len(p) for _, _, p in patterns)
    ways = np.concatenate([np.full(len(p), way, np.int8) for way, _, p in patterns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), max(1, (1 << 19) // width)):
                own = every[at : at + max(1, (1 << 19) // width)]
                out = np.concatenate([(own[:, None] & np.uint64(m)) ^ p[None, :] for _, m, p in patterns], axis=1)
                yield record(
                    ["way", "variant", "fp"],
                    [np.tile(ways, len(own)), out.view(np.int64).ravel(), np.repeat(own.view(np.int64), width)],
                )

    return fps.select("fp").mapInArrow(run, "way tinyint, variant bigint, fp bigint")


def _sorted_runs(variants: DataFrame) -> DataFrame:
    return variants.repartition("way", "variant").sortWithinPartitions("way", "variant", "fp")


def _compare(radius: int):
    """Over sorted (way, variant, fp): links within short runs; of longer runs the members, as (fp, null)."""

    def close(same: np.ndarray, fp: np.ndarray, last: bool) -> tuple[list, list, int]:
        """Links, members of long runs, and how many rows at the end to keep for the next batch."""
        n = len(fp)
        begin = np.flatnonzero(np.concatenate([[True], ~same]))  # where runs begin
        size = np.diff(np.append(begin, n))
        keep = 0 if last else int(size[-1])
        used = n - keep
        run = np.repeat(size, size)
        long = np.flatnonzero((run > FAMILY)[:used])
        pairs = []
        place = np.arange(n) - np.repeat(begin, size)
        for d in range(1, FAMILY):
            at = np.flatnonzero((place[:used] >= d) & (run[:used] <= FAMILY))
            if not len(at):
                break
            a, b = fp[at - d], fp[at]
            ok = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            pairs.append(np.stack([a[ok], b[ok]]))
        return pairs, [fp[long]], keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, variant, fp = np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal way, variant, fp
            if not len(fp):
                return
            same = (way[1:] == way[:-1]) & (variant[1:] == variant[:-1])
            pairs, members, keep = close(same, fp, last)
            cut = len(fp) - keep
            if keep > 4 * FAMILY and not last:  # a run known to be long: its members go out now, two families' worth stays
                members.append(fp[cut : len(fp) - 2 * FAMILY])
                cut = len(fp) - 2 * FAMILY
            way, variant, fp = way[cut:], variant[cut:], fp[cut:]
            both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=1)
            alone = np.unique(np.concatenate(members))
            if both.shape[1] + len(alone):
                a = np.concatenate([both[0], alone])
                b = pa.array(np.concatenate([both[1], alone]), mask=np.arange(len(a)) >= both.shape[1])
                yield record(["a", "b"], [a, b])

        for batch in batches:
            way = np.concatenate([way, batch.column(0).to_numpy()])
            variant = np.concatenate([variant, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy()])
            if len(fp) >= 1 << 16:
                yield from out(False)
        yield from out(True)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (way, variant, fp) of plain balls: a link from each row to the one before in its run."""
    tail = None
    for batch in batches:
        variant, fp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if tail is not None:
            variant, fp = np.concatenate([[tail[0]], variant]), np.concatenate([[tail[1]], fp])
        if len(fp):
            tail = (variant[-1], fp[-1])
        ok = (variant[1:] == variant[:-1]) & (fp[1:] != fp[:-1])
        pairs = np.unique(np.stack([fp[:-1][ok], fp[1:][ok]]), axis=1)
        if pairs.shape[1]:
            yield record(["a", "b"], [pairs[0], pairs[1]])


def links(fps: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """Distinct pairs (``a`` < ``b`` not implied) whose links connect all fingerprints within ``radius`` bits.

    ``fps`` has distinct ``fp``. Pairs outside dense families are complete;
    within one they connect the same fingerprints as all its pairs would.
    """
    if radius % 2:
        raise ValueError("the radius must be even: half of it is what both sides reach")
    # A fingerprint grows to its variants: deal them out by number, or a small table would end up in few tasks.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut_lineage(_sorted_runs(_variants(fps, parts, radius)).mapInArrow(_compare(radius), "a bigint, b bigint"))
    near = found.filter(F.col("b").isNotNull())
    family = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    dense = _sorted_runs(_variants(family, 1, radius)).mapInArrow(_chain, "a bigint, b bigint")
    return near.unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, parts: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (smallest key reachable by links) of every row of ``docs``.

    Equal fingerprints are linked; so are all texts without words, whose
    fingerprint is zero. Rows that repeat a key stay rows of their own. A
    null key counts for no component: among null keys alone the id is null.
    """
    prints = cut_lineage(fingerprints(docs, key, text, words))
    own = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(links(own.select("fp"), radius, parts))
    labelled = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(smallest, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component.

    Rows with a null key all stay: nothing tells which of them came first. Of
    rows that repeat a key at most one stays.
    """
    named = docs.filter(F.col(key).isNotNull())
    classes = near_duplicates(named, key, text, **how)
    first = classes.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = named.join(first, key, "left_semi").dropDuplicates([key])
    return kept.select(*map(quoted, docs.columns)).unionByName(docs.filter(F.col(key).isNull()))
