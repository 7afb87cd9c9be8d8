"""Benchmark passages in a corpus, found by embedding edits into a lattice of samples.

The CGK embedding walks through a sequence of words, emits the word it stands
on, and moves on or not by a random bit that the step and the word decide. Two
sequences a few edits apart are walked in step again soon after each edit, so
their embeddings differ in few places: edit distance becomes Hamming
distance. Sampling places of the embedding is then a locality-sensitive hash.

Every word of every text starts a window of an item's size, walked with each
of several random walks; items are walked from several of their words, so that
edits at one end leave another start untouched. A window that agrees with an
item in all sampled places of a walk is a candidate. Places are compared one
after the other, so most windows are left after a few steps. Walks find almost
all, so every item is also cut into one segment more than it may have edits:
one of them stands in the text as it is, and nothing is missed. Candidates are
verified by the edit distance, in words, of the whole item to the best
matching part of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import plain, quoted, raw_bytes, record, release, slices
from sightline.llm.words import LETTERS, Words, mixed, sequences, words

#: Random walks, sampled places of each (the first is the start), and the steps they are taken from.
WALKS, SAMPLES, STEPS = 8, 5, 20
#: Edits of an item's words, as a share of them, up to which a text contains it; starts within an item.
TOLERANCE, STARTS = 0.2, 4
#: Words of windows around segments that are looked through at a time.
WINDOW_WORDS = 1 << 19
#: Words of the items of one block; larger benchmarks are searched block by block.
BLOCK_WORDS = 2_000_000
_TABLE = 1 << 18
#: Odd factors of the multiply-shift hash, one for each walk and step: at most so many of either.
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plans(walks: int, samples: int, steps: int) -> list[list[int]]:
    """Sampled steps of each walk, ascending; all begin with the start."""
    rng = np.random.Generator(np.random.PCG64(7))
    return [[0, *sorted(rng.choice(np.arange(1, steps), samples - 1, replace=False).tolist())] for _ in range(walks)]


def moves(tokens: np.ndarray, walk: int, step: int) -> np.ndarray:
    """The random bit of a walk's step on each word."""
    return (tokens * _FACTORS[walk, step]) >> np.uint64(63)


@dataclass(frozen=True)
class Items:
    """A block of items, with the keys that windows are compared with."""

    ids: list
    tokens: list[np.ndarray]
    #: For each walk and sample: sorted partial keys, and with the last sample of an item, (item, start) of each.
    levels: list[list[np.ndarray]]
    final: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    tables: list[list[np.ndarray]]
    #: For each length of segments: sorted hashes, the item and the first word of each.
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    tolerance: float = TOLERANCE


def cut(tokens: list[np.ndarray], tolerance: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of the items by their length: one more than the edits allowed, so that one is free of edits."""
    rows: dict[int, list] = {}
    for item, own in enumerate(tokens):
        number = allowed(len(own), tolerance) + 1
        if number > len(own):
            continue
        bounds = np.array([len(own) * i // number for i in range(number + 1)])
        for value, a, b in zip(sequences(own, bounds[:-1], bounds[1:]), bounds[:-1].tolist(), bounds[1:].tolist()):
            rows.setdefault(b - a, []).append((int(value), item, a))
    out = {}
    for length, found in rows.items():
        values, owners, offsets = zip(*sorted(found))
        out[length] = np.array(values, np.uint64), np.array(owners, np.int64), np.array(offsets, np.int64)
    return out


def embed(ids: list, tokens: list[np.ndarray], walks: int, samples: int, steps: int, starts: int, tolerance: float = TOLERANCE) -> Items:
    """Walk every item from its starts. An item too short for a walk ends with the last place it reaches."""
    plan = plans(walks, samples, steps)
    levels = [[[] for _ in range(samples)] for _ in plan]
    final = [[[] for _ in range(samples)] for _ in plan]
    for item, own in enumerate(tokens):
        offsets = sorted({len(own) * i // starts for i in range(starts)}) if len(own) else []
        walked = []  # (samples reached, start, walk, partial keys)
        for walk, sampled in enumerate(plan):
            for start in offsets:
                at, key, keys = start, np.zeros(1, np.uint64), []
                for step in range(sampled[-1] + 1):
                    if at >= len(own):
                        break
                    here = own[at : at + 1]
                    if step in sampled:
                        key = chained(key, here)
                        keys.append(key[0])
                    at += int(moves(here, walk, step)[0])
                walked.append((len(keys), start, walk, keys))
        # Walks that stop at the item's end say less; they count only for items too short for enough whole ones.
        whole = [w for w in walked if w[0] == samples]
        if len(whole) < walks:
            most = max((w[0] for w in walked), default=0)
            whole = [w for w in walked if w[0] == samples or (w[1] == 0 and w[0] >= min(most, 3))]
        for number, start, walk, keys in whole:
            for level, key in enumerate(keys):
                levels[walk][level].append(key)
            final[walk][number - 1].append((keys[-1], item, start))
    pack = lambda keys: np.unique(np.array(keys, np.uint64))
    ends = []
    for walk in final:
        ends.append([])
        for found in walk:
            found = sorted(found, key=lambda x: int(x[0]))
            ends[-1].append(
                (np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64))
            )
    tables = [[_lookup(pack(keys)) for keys in walk] for walk in levels]
    return Items(ids, tokens, [[pack(k) for k in walk] for walk in levels], ends, tables, cut(tokens, tolerance), tolerance)


def chained(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(key * np.uint64(0x9E3779B97F4A7C15) + token)


def _lookup(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(_TABLE, bool)
    table[(keys & np.uint64(_TABLE - 1)).astype(np.int64)] = True
    return table


def _members(keys: np.ndarray, sorted_keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the list; the table leaves few to search for."""
    at = np.flatnonzero(table[(keys & np.uint64(_TABLE - 1)).astype(np.int64)])
    if not len(at) or not len(sorted_keys):
        return at[:0]
    place = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
    return at[sorted_keys[place] == keys[at]]


def candidates(tokens: np.ndarray, items: Items, walks: int, samples: int, steps: int) -> np.ndarray:
    """Distinct (item, word of the text where the item would begin), over all walks."""
    found = [np.zeros((0, 2), np.int64)]
    begin = np.arange(len(tokens))
    first_keys = chained(np.zeros(1, np.uint64), tokens)
    # Every walk samples its start: windows left after it are those of all walks together, found once.
    starts = np.unique(np.concatenate([walk[0] for walk in items.levels]))
    shared = _members(first_keys, starts, _lookup(starts))
    for walk, sampled in enumerate(plans(walks, samples, steps)):
        start, at, key = begin[shared], begin[shared], first_keys[shared]
        step = 0
        for level, wanted in enumerate(sampled):
            while step < wanted:
                at = at + moves(tokens[at], walk, step).astype(np.int64)
                step += 1
                inside = at < len(tokens)
                if not inside.all():
                    start, at, key = start[inside], at[inside], key[inside]
            if level:
                key = chained(key, tokens[at])
                left = _members(key, items.levels[walk][level], items.tables[walk][level])
                start, at, key = start[left], at[left], key[left]
            keys, owner, offset = items.final[walk][level]
            if len(keys) and len(key):
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                many = high - low
                if many.any():
                    which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    found.append(np.stack([owner[which], np.repeat(start, many) - offset[which]], axis=1))
            if not len(at):
                break
    return np.unique(np.concatenate([*found, segmented(tokens, items)]), axis=0)


def segmented(tokens: np.ndarray, items: Items) -> np.ndarray:
    """(item, word where it would begin) of the items that have a segment in the text and enough words around it."""
    found = [np.zeros((0, 2), np.int64)]
    for length, (keys, owner, offset) in items.segments.items():
        begin = np.arange(len(tokens) - length + 1)
        if not len(begin):
            continue
        here = sequences(tokens, begin, begin + length)
        at = _members(here, keys, _lookup(keys))
        low, high = np.searchsorted(keys, here[at], "left"), np.searchsorted(keys, here[at], "right")
        many = high - low
        which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found.append(np.stack([owner[which], np.repeat(at, many) - offset[which]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    heads = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
    left = [np.zeros((0, 2), np.int64)]
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(every)]):
        own = items.tokens[every[a, 0]]
        slack, wanted = allowed(len(own), items.tolerance), np.unique(own)
        step = max(1, WINDOW_WORDS // (len(own) + 2 * slack))
        for part in np.split(every[a:b], range(step, b - a, step)):
            # All words of the item but the edited ones stand in the window.
            near = tokens[np.clip(part[:, 1, None] + np.arange(-slack, len(own) + slack), 0, len(tokens) - 1)]
            inside = wanted[np.minimum(np.searchsorted(wanted, near), len(wanted) - 1)] == near
            left.append(part[inside.sum(axis=1) >= len(own) - slack])
    return np.concatenate(left)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the part of ``text`` nearest to the whole item; by bit-parallel rows over a whole integer."""
    length = len(item)
    full, top = (1 << length) - 1, 1 << (length - 1)
    where: dict[int, int] = {}
    for i, token in enumerate(item.tolist()):
        where[token] = where.get(token, 0) | 1 << i
    plus, minus, score = full, 0, length
    best, end = length, 0
    for i, token in enumerate(text.tolist(), 1):
        eq = where.get(token, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, i
    return best, end


def allowed(length: int, tolerance: float) -> int:
    return int(tolerance * length + 1e-9)


def _search(blocks: list[Items], walks: int, samples: int, steps: int, tolerance: float, key: str):
    def verified(found: Words, items: Items) -> list[tuple[int, int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        checked: dict[tuple[int, int], int] = {}
        for item, place in candidates(found.hashes, items, walks, samples, steps).tolist():
            own = items.tokens[item]
            slack = allowed(len(own), tolerance)
            # Of all texts that the window touches one holds the candidate's own words; with edits it may be shorter than the item.
            doc = int(np.searchsorted(found.bounds, max(place, 0), "right")) - 1
            for text in range(doc, int(np.searchsorted(found.bounds, min(place + len(own) - 1, len(found.hashes) - 1), "right"))):
                low, high = int(found.bounds[text]), int(found.bounds[text + 1])
                a, b = max(low, place - slack), min(high, place + len(own) + slack)
                if b <= a or checked.get((item, text), -1) >= b:
                    continue  # an earlier window of this item reached as far
                edits, end = best_match(own, found.hashes[a:b])
                if edits <= slack and (edits, a) < best.get((text, item), (1 << 30, 0, 0))[:2]:
                    best[text, item] = (edits, a, a + end - low)
                if edits == 0:
                    checked[item, text] = high
        return [(text, item, edits, end, int(found.bounds[text])) for (text, item), (edits, _, end) in best.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column(1), pa.string())
            for a, b in slices(texts):
                found = words(*raw_bytes(texts[a:b]), LETTERS)
                if not len(found.hashes):
                    continue
                for items in blocks:
                    hits = verified(found, items)
                    if hits:
                        yield record(
                            [key, "item_id", "edits", "item_words", "end_word"],
                            [
                                batch.column(0).take(pa.array([a + h[0] for h in hits])),
                                [items.ids[h[1]] for h in hits],
                                pa.array([h[2] for h in hits], pa.int32()),
                                pa.array([len(items.tokens[h[1]]) for h in hits], pa.int32()),
                                pa.array([h[3] for h in hits], pa.int32()),
                            ],
                        )

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = TOLERANCE,
    walks: int = WALKS,
    samples: int = SAMPLES,
    steps: int = STEPS,
    starts: int = STARTS,
) -> DataFrame:
    """One row for each text and item it contains: ``key``, ``item_id``, ``edits``, ``item_words``, ``end_word``.

    ``items`` (``item_id``, ``text``) is the stated query set; it is held by
    every task, in blocks of bounded size. A text contains an item if a part
    of it is at most ``tolerance`` times the item's words edits away; words
    are runs of letters and digits, A-Z in lower case. Items without words
    are in no text; items that repeat another's words are found like it. Null
    and empty texts contain nothing. ``end_word`` counts words up to the end
    of the nearest part.
    """
    rows = items.select("item_id", "text").collect()  # the query set
    packed = words(*raw_bytes(pa.array([r[1] or "" for r in rows], pa.string())), LETTERS)
    tokens = [packed.hashes[packed.bounds[i] : packed.bounds[i + 1]] for i in range(len(rows))]
    blocks, ids, own, size = [], [], [], 0
    for row, item in zip(rows, tokens):
        if not len(item):
            continue
        ids.append(row[0])
        own.append(item)
        size += len(item)
        if size >= BLOCK_WORDS:
            blocks.append(embed(ids, own, walks, samples, steps, starts, tolerance))
            ids, own, size = [], [], 0
    if own:
        blocks.append(embed(ids, own, walks, samples, steps, starts, tolerance))
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    found = None
    for block in blocks or [Items([], [], [], [], [])]:
        shared = spark.sparkContext.broadcast([block] if block.ids else [])

        def run(batches, shared=shared):
            return _search(shared.value, walks, samples, steps, tolerance, key)(batches)

        part = docs.select(quoted(key), quoted(text)).mapInArrow(
            run, f"{quoted(key)} {kinds[0]}, item_id {kinds[1]}, edits int, item_words int, end_word int"
        )
        found = part if found is None else found.unionByName(part)
    return found


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without those that contain an item; rows with a null key are judged by a hash of their text."""
    mark = F.coalesce(F.col(quoted(key)).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256)))
    name = "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "mark"
    marked = docs.withColumn(name, mark)
    bad = contaminated(marked, items, name, text, **how).select(name).distinct()
    return marked.join(bad, name, "left_anti").select(*map(quoted, docs.columns))
