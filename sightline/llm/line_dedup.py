"""Lines that repeat across documents, found with two Bloom filters.

A first pass over the texts builds two filters of fixed size: one for line
keys seen in a document, one for those seen in a second one. Parts of the
corpus build bit lists on their own; folded together, a bit set by two parts
is a bit seen twice. A second pass lets only keys through that the
second filter knows. These suspects, a small share of all lines, are shuffled
as hashes, counted exactly, and where one occurrence is to stay, the first is
chosen. Documents then lose their lines by a join on a document's own hash.

Keys are compared by 128-bit hashes: among ten thousand million keys two
different ones agree with a chance below 1e-18. When the corpus outgrows the
filters more keys become suspects; the counts, and so the rows, stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ASCII_SPACE, fresh, plain, quoted, record, release, rewritten, slices

#: Bits of a filter: sixteen for each of sixteen lines of a document, within these bounds (at most 32 MB).
FEWEST_BITS, MOST_BITS, BITS_PER_DOCUMENT = 1 << 20, 1 << 28, 256
HASHES, BLOCK = 2, 1 << 20
#: Keys a task holds before it hands on what it knows.
HELD = 1 << 19


def keys_of(text: bytes) -> list[bytes]:
    """A key for each line: blanks stripped at both ends, A-Z lower-cased. An empty text is one empty line."""
    return [line.strip(ASCII_SPACE).lower() for line in text.split(b"\n")]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), np.uint64).reshape(-1, 2)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each key in a filter, one row for each hash function."""
    a, b = hashes[:, 0], hashes[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(HASHES)])


def distinct_keys(text: bytes, shortest: int) -> list[bytes]:
    """Different keys of a text with at least ``shortest`` code points."""
    return [k for k in dict.fromkeys(keys_of(text)) if len(k) >= shortest and len(k.decode()) >= shortest and k]


def _bit_lists(bits: int, shortest: int):
    """Of each part of the corpus: for every block of the filters, the bits seen once and seen twice."""

    def parts(held: list[np.ndarray]) -> pa.RecordBatch | None:
        if not held:
            return None
        # A 128-bit key may occur once for each document that has it.
        every = np.concatenate(held)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        first = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
        begin = np.flatnonzero(first)
        again = np.diff(np.append(begin, len(every))) > 1
        distinct = every[begin]
        once = np.sort(places(distinct, bits).ravel())
        twice = np.sort(places(distinct[again], bits).ravel())
        # Different keys of this part may share a bit: seen twice as well, if wrongly; that only adds suspects.
        rows = []
        for block in np.unique(once >> np.uint64(20)).tolist():
            low, high = np.uint64(block << 20), np.uint64((block + 1) << 20)
            cut = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] - low for x in (once, twice)]
            rows.append((block, *[np.unique(c).astype(np.uint32).tobytes() for c in cut]))
        return record(["block", "once", "twice"], [pa.array([r[0] for r in rows], pa.int32()), *([r[i] for r in rows] for i in (1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, number = [], 0
        for batch in batches:
            texts = plain(batch.column(0), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                own = hashes_of([k for t in texts[a:b].to_pylist() for k in distinct_keys(t, shortest)])
                held.append(own)
                number += len(own)
                if number >= HELD:
                    yield parts(held)
                    held, number = [], 0
        if number:
            yield parts(held)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, the bits of the second filter, packed. A task holds only the two bit rows of its blocks."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, one, two in zip(*[c.to_pylist() for c in batch.columns]):
            seen = once.setdefault(block, np.zeros(BLOCK, bool))
            more = twice.setdefault(block, np.zeros(BLOCK, bool))
            bits = np.frombuffer(one, np.uint32)
            more[bits[seen[bits]]] = True
            seen[bits] = True
            more[np.frombuffer(two, np.uint32)] = True
    for block, bits in twice.items():
        yield record(["block", "bits"], [pa.array([block], pa.int32()), [np.packbits(bits, bitorder="little").tobytes()]])


def second_filter(docs: DataFrame, text: str, shortest: int) -> tuple[int, bytes]:
    """(bits, packed bits) of the filter of keys seen in two documents."""
    bits = FEWEST_BITS
    while bits < MOST_BITS and bits < BITS_PER_DOCUMENT * docs.count():
        bits *= 2
    lists = docs.select(text).mapInArrow(_bit_lists(bits, shortest), "block int, once binary, twice binary")
    folded = lists.repartition("block").mapInArrow(_fold, "block int, bits binary")
    whole = bytearray(bits // 8)
    for row in folded.toLocalIterator():  # at most MOST_BITS / 8 bytes in all
        whole[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = row["bits"]
    return bits, bytes(whole)


def _suspects(bits: int, known: Broadcast, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        filled = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            texts = plain(batch.column(0), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                keys, owner, lines = [], [], []
                for row, text in enumerate(texts[a:b].to_pylist(), a):
                    first: dict[bytes, int] = {}
                    for number, key in enumerate(keys_of(text)):
                        if key and len(key) >= shortest:
                            first.setdefault(key, number)
                    own = [k for k in first if shortest < 2 or len(k.decode()) >= shortest]
                    keys += own
                    lines += [first[k] for k in own]
                    owner += [row] * len(own)
                if not keys:
                    continue
                hashes = hashes_of(keys)
                at = places(hashes, bits)
                seen = (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
                chosen = np.flatnonzero(seen)
                if len(chosen):
                    of = pa.array(np.array(owner)[chosen])
                    yield record(
                        ["k1", "k2", "line", "doc_key", "d1", "d2"],
                        [
                            hashes[chosen, 0].view(np.int64),
                            hashes[chosen, 1].view(np.int64),
                            np.array(lines, np.int32)[chosen],
                            *[batch.column(i).take(of) for i in (1, 2, 3)],
                        ],
                    )

    return run


def _cut(first: int, names: list[str]):
    """Drops the listed lines. ``first``: place of the text column; the drop lists come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column(first), pa.string()).cast(pa.binary())
            drops = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                kept, total, gone = [], [], []
                for text, drop in zip(texts[a:b].to_pylist(), drops[a:b].to_pylist()):
                    lines = text.split(b"\n")
                    if drop:
                        # (key's two hashes, line to keep or -1) of each repeated key of this document
                        stays = {(d["k1"], d["k2"]): d["keep"] for d in drop}
                        pairs = hashes_of(keys_of(text)).view(np.int64).tolist()
                        own = [x for i, (x, p) in enumerate(zip(lines, map(tuple, pairs))) if stays.get(p, i) == i]
                    else:
                        own = lines
                    kept.append(b"\n".join(own))
                    total.append(len(lines))
                    gone.append(len(lines) - len(own))
                rest = batch.slice(a, b - a).columns[:-1]
                yield record(names, [*rest, pa.array(kept, pa.binary()).cast(pa.string()), np.array(total), np.array(gone)])

    return run


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 10,
    shortest: int = 1,
    keep: str = "none",
    added: tuple[str, str, str] = ("kept", "n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the columns ``kept`` (text), ``n_lines`` and ``n_dropped`` (or as ``added`` names them).

    A line's key is the line stripped of blanks at both ends, A-Z in lower
    case. Keys of at least ``shortest`` code points found in ``least``
    documents or more are repeated; a blank line never is. With
    ``keep="none"`` every line with a repeated key goes, with ``"first"`` the
    first such line of the first document (by ``key``, nulls last) stays.

    Each row counts as one document, also if it repeats another one. A null
    or empty text is one empty line and stays as it is. All columns of
    ``docs`` stay, save ones called like the added three; an empty table
    gives no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    rest = [c for c in docs.columns if c.lower() not in map(str.lower, added)]
    docs = docs.select(*map(quoted, rest))
    d1, d2, drops = (fresh(docs, n) for n in ("d1", "d2", "drops"))
    # What a row is known by: two 64-bit hashes of its key and text. Rows alike in both lose the same lines.
    marks = [F.xxhash64(F.lit(i), F.coalesce(F.col(quoted(key)).cast("string"), F.lit("\x00")), F.coalesce(F.col(quoted(text)), F.lit(""))) for i in (1, 2)]
    bits, filled = second_filter(docs, quoted(text), shortest)
    known = docs.sparkSession.sparkContext.broadcast(filled)
    order = docs.schema[key].dataType.simpleString()
    suspects = rewritten(
        docs.select(quoted(text), quoted(key), *marks).mapInArrow(
            _suspects(bits, known, shortest), f"k1 bigint, k2 bigint, line int, doc_key {order}, d1 bigint, d2 bigint"
        ),
        "suspects",
    )
    place = F.struct(F.col("doc_key").isNull().alias("last"), "doc_key", "d1", "d2", "line")
    repeated = rewritten(
        suspects.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
        .filter(F.col("n") >= least)
        .select("k1", "k2", "at"),
        "repeated",
    )
    stays = F.lit(-1)
    if keep == "first":
        own = (F.col("at.d1") == F.col("d1")) & (F.col("at.d2") == F.col("d2"))
        stays = F.when(own, F.col("at.line")).otherwise(F.lit(-1))
    lists = (
        suspects.join(repeated, ["k1", "k2"])
        .select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.struct("k1", "k2", stays.alias("keep")).alias("own"))
        .groupBy(d1, d2)
        .agg(F.collect_set("own").alias(drops))
    )
    marked = docs.select("*", marks[0].alias(d1), marks[1].alias(d2)).join(lists, [d1, d2], "left")
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return marked.select(*map(quoted, rest), drops).mapInArrow(
        _cut(rest.index(text), [*rest, *added]), ", ".join([schema, *(f"{quoted(c)} {kind}" for c, kind in zip(added, ("string", "bigint", "bigint")))])
    )
