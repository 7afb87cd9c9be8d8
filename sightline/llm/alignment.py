"""Two tokenizers' tokens of the same texts, aligned where both end at the same byte.

A text's tokens are cut into groups by divide and conquer. An interval holds
tokens of both sides that cover the same bytes; a common end near its middle
is looked for by bisection, going outwards from the token that ends nearest
to it. Where there is one the interval falls in two halves; one without is a
leaf: a group. All intervals of a level are halved together, as arrays.

How often two token ids are linked in the whole corpus takes one pass over
the texts. A task hands in its documents in chunks: per chunk the sorted list
of its different id pairs, per document the places of its pairs in that list.
Only the lists are counted and joined with the counts, and they come back to
their chunk to settle its documents. No id pair weighs on one task: it is on
each chunk's list once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.byte_bpe import Encoder
from sightline.llm.common import plain, quoted, record, rewritten, slices
from sightline.session import renamed

#: Links of a chunk of documents; pairs in one row of a chunk's list.
CHUNK_LINKS, LIST_ROWS = 2 << 20, 1 << 16
#: What a worker remembers of the words that it has encoded.
MOST_WORDS, MOST_IDS = 1 << 20, 8 << 20


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as they are and the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel(Encoder):
    """Ids of a byte-level tokenizer file; the strings of special tokens are plain text."""

    def full(self) -> bool:
        return len(self._place) > MOST_WORDS or self._used > MOST_IDS

    def forget(self) -> None:
        self._forget()

    def places(self, words: list[str]) -> np.ndarray:
        return self._places(words)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self._ids, self._starts, self._sizes, places)

    def doubtful(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts whose words the tokenizer may join across white space."""
        return self._doubtful(places, bounds)

    def __init__(self, path: str):
        super().__init__(path)
        self._library.encode_special_tokens = True
        back = byte_of_character()
        size = max(self._library.get_vocab(with_added_tokens=True).values()) + 1
        tokens = [self._library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]


class Pieces:
    """Ids of a piece model that leads every text with a blank.

    No piece goes on behind a blank or a line feed, so words with the blank
    before them are encoded alone, and each different one once. Texts with
    runs of blanks, whose pieces may be longer, go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._library.id_to_piece(i) for i in range(len(self._library))]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self._library.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self._blank = self._library.piece_to_id("▁")
        self._whole_words = not any("\n" in n or "▁" in n.lstrip("▁") for n in names)
        self.forget()

    def forget(self) -> None:
        self._place: dict[str, int] = {"": 0}
        self._parts, self._sizes = [np.array([self._blank], np.int64)], [np.ones(1, np.int64)]
        self._pool, self._size, self._start = self._parts[0], self._sizes[0], np.zeros(1, np.int64)

    def _learn(self, keys: list[str]) -> None:
        new = [k for k in dict.fromkeys(keys) if k not in self._place]
        if not new:
            return
        found = self._library.encode(new, num_threads=1)
        for i, key in enumerate(new):
            if key[0] == "\n":  # a line feed follows what is before it without a blank
                if found[i][0] != self._blank:
                    raise AssertionError("the model joins a blank to a line feed")
                del found[i][0]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._place.update(zip(new, range(len(self._place), len(self._place) + len(new))))
        self._parts.append(np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())))
        self._sizes.append(sizes)
        self._parts, self._sizes = [np.concatenate(self._parts)], [np.concatenate(self._sizes)]
        self._pool, self._size = self._parts[0], self._sizes[0]
        self._start = np.cumsum(self._size) - self._size

    def full(self) -> bool:
        return len(self._place) > MOST_WORDS or len(self._pool) > MOST_IDS

    def words(self, text: str) -> list[str] | None:
        """The words of a text, a line feed leading its own; none if only the library can tell the text's pieces."""
        if not self._whole_words or text[0] == " " or "  " in text or "▁" in text:
            return None
        return text.replace("\n", " \n").split(" ")

    def places(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)
            return np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))

    def known(self, start: int) -> list[str]:
        """Words from place ``start`` on."""
        return list(islice(self._place, start, None))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self._pool, self._start, self._size, places)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches of a pool one after the other, where each ends)."""
    sizes = size[places]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start[places] - (ends - sizes), sizes) + np.arange(total)], ends


def shared_cuts(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens on both sides that end each group, in order.

    ``end_a`` and ``end_b`` are where the tokens of all documents end, in
    bytes counted through; ``first`` has the first token on side A of every
    document, and one more at the end. Both sides end with every document.
    """
    ended = np.zeros(end_a[-1] + 1, bool)
    ended[end_b] = True
    low, high = first[:-1], first[1:] - 1  # tokens of A; the last one ends the interval
    start = np.concatenate([[0], end_a[high[:-1]]])
    cuts = [high]
    while len(low):
        inner = high > low
        low, high, start = low[inner], high[inner], start[inner]
        middle = (low + high) // 2
        wide = np.flatnonzero(high - low > 8)
        middle[wide] = np.searchsorted(end_a, (start[wide] + end_a[high[wide]]) // 2)
        middle = np.clip(middle, low, high - 1)
        found = np.full(len(low), -1)
        open_, step = np.arange(len(low)), 0
        while len(open_):
            # Outwards from the middle: 0, +1, -1, +2, -2, ...
            at = middle[open_] + (-(step // 2) if step % 2 == 0 else (step + 1) // 2)
            inside = (at >= low[open_]) & (at < high[open_])
            place = at[inside]
            hit = ended[end_a[place]]
            found[open_[inside][hit]] = place[hit]
            reach = (step + 1) // 2
            more = (middle[open_] + reach < high[open_]) | (middle[open_] - reach >= low[open_])
            open_ = open_[more & (found[open_] < 0)]
            step += 1
        some = found >= 0
        cut = found[some]
        cuts.append(cut)
        low, high, start = (
            np.concatenate([low[some], cut + 1]),
            np.concatenate([cut, high[some]]),
            np.concatenate([start[some], end_a[cut]]),
        )
    last_a = np.sort(np.concatenate(cuts))
    return last_a, (np.cumsum(ended, dtype=np.int32)[end_a[last_a]] - 1).astype(np.int64)


@dataclass
class Aligned:
    """Of consecutive texts: numbers of tokens, groups and links, the groups' digests, and every link's id pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    pairs: np.ndarray


class Aligner:
    """Aligns texts by two tokenizer files."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = ByteLevel(bytes_path), Pieces(pieces_path)
        self._in_a = np.zeros(0, np.int64)  # side A's place of each word of side B
        self._sizes = [np.array([len(b) for b in side.bytes], np.int64) for side in (self.a, self.b)]
        self._begin = [np.cumsum(sizes) - sizes for sizes in self._sizes]
        self._bytes = [np.frombuffer(b"".join(side.bytes), np.uint8) for side in (self.a, self.b)]
        many_a, many_b = len(self.a.bytes), len(self.b.bytes)
        self._shift = [0, many_a, 2 * many_a, 2 * many_a + many_b]
        self._names = [f"{i}{m}" for n, m in ((many_a, ","), (many_a, "|"), (many_b, ","), (many_b, ";")) for i in range(n)]

    def align(self, texts: list[str]) -> Aligned:
        """A text that is empty, or that either side's tokens don't spell with its leading blank, has no tokens."""
        n = len(texts)
        ids_a, n_a, ids_b, n_b = self._encode(texts)
        whole = b"".join([b" " + t.encode() if t else b"" for t in texts])
        size = np.fromiter((1 + len(t.encode()) if t else 0 for t in texts), np.int64, n)
        spelt = self._spelt(0, ids_a, n_a, whole, size) & self._spelt(1, ids_b, n_b, whole, size)
        if not spelt.all():
            ids_a, ids_b = ids_a[np.repeat(spelt, n_a)], ids_b[np.repeat(spelt, n_b)]
            n_a, n_b = n_a * spelt, n_b * spelt
        none = np.zeros(n, np.int64)
        if not len(ids_a):
            return Aligned(none, none, none, none, [""] * n, none[:0])
        end_a, end_b = np.cumsum(self._sizes[0][ids_a]), np.cumsum(self._sizes[1][ids_b])
        some = np.flatnonzero(n_a)
        first_a = np.concatenate([[0], np.cumsum(n_a[some])])
        last_a, last_b = shared_cuts(end_a, end_b, first_a)
        # Groups: how many end by the last token of each document.
        upto = np.concatenate([[0], np.searchsorted(last_a, first_a[1:] - 1) + 1])
        n_groups = none.copy()
        n_groups[some] = np.diff(upto)
        digest = [""] * n
        for place, text in zip(some.tolist(), self._shown(ids_a, ids_b, last_a, last_b, n_a[some] + n_b[some])):
            digest[place] = text
        # A link for every stretch between neighbouring ends of either side.
        ends_a, ends_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        ends_a[end_a] = ends_b[end_b] = True
        ends = np.flatnonzero(ends_a | ends_b)
        own_a, own_b = (np.cumsum(e[ends]) - e[ends] for e in (ends_a, ends_b))
        pairs = (ids_a[own_a] << 32) | ids_b[own_b]
        return Aligned(n_a, n_b, n_groups, n_a + n_b - n_groups, digest, pairs)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, one text after the other, and the number of each text's; words are looked up once for both."""
        if self.a.full() or self.b.full():
            self.a.forget()
            self.b.forget()
            self._in_a = np.zeros(0, np.int64)
        words = [None if not t or "<|" in t else self.b.words(t) for t in texts]
        quick = np.array([i for i, own in enumerate(words) if own is not None], np.int64)
        places = self.b.places(list(chain.from_iterable(words[i] for i in quick.tolist())))
        new = self.b.known(len(self._in_a))
        if new:
            self._in_a = np.concatenate([self._in_a, self.a.places(new)])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(words[i]) for i in quick.tolist()), np.int64, len(quick)))])
        in_a = self._in_a[places]
        doubtful = np.zeros(len(quick), bool)
        if len(places):
            doubtful[self.a.doubtful(in_a, bounds)] = True
        if doubtful.any():
            stay = np.repeat(~doubtful, np.diff(bounds))
            places, in_a = places[stay], in_a[stay]
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[~doubtful])])
            quick = quick[~doubtful]
        rest = np.setdiff1d(np.flatnonzero([bool(t) for t in texts]), quick)
        slow = [texts[i] for i in rest.tolist()]
        out = []
        for side, own, whole in ((self.a, in_a, [" " + t for t in slow]), (self.b, places, slow)):
            ids, ends = side.ids(own)
            sizes = np.zeros(len(texts), np.int64)
            sizes[quick] = np.diff(np.concatenate([[0], ends])[bounds])
            if slow:
                more, sizes[rest] = side.encode(whole) if side is self.a else side.library(whole)
                owner = np.concatenate([np.repeat(quick, sizes[quick]), np.repeat(rest, sizes[rest])])
                ids = np.concatenate([ids, more])[np.argsort(owner, kind="stable")]
            out += [ids.astype(np.int64), sizes]
        return tuple(out)

    def _spelt(self, side: int, ids: np.ndarray, tokens: np.ndarray, whole: bytes, size: np.ndarray) -> np.ndarray:
        """Texts whose tokens have exactly the bytes that ``whole`` has for them, ``size`` of each."""
        lengths = self._sizes[side][ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        spelling = self._bytes[side][np.repeat(self._begin[side][ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        mine = ends[np.concatenate([[0], np.cumsum(tokens)])]
        theirs = np.concatenate([[0], np.cumsum(size)])
        if spelling == whole and (mine == theirs).all():
            return size > 0
        stretches = zip(mine.tolist(), mine[1:].tolist(), theirs.tolist(), theirs[1:].tolist())
        return np.array([d > c and spelling[a:b] == whole[c:d] for a, b, c, d in stretches], bool)

    def _shown(self, ids_a, ids_b, last_a, last_b, tokens) -> Iterator[str]:
        """SHA-256 of ``a,a|b,b;a|b`` of each text's groups."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # Side A's tokens of a group stand behind all tokens of the groups before it, side B's behind those of A too.
        at_a = np.arange(len(ids_a)) + np.repeat(last_b + 1 - size_b, size_a)
        at_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        shown[at_a] = ids_a + self._shift[0]
        shown[at_b] = ids_b + self._shift[2]
        shown[at_a[last_a]] += self._shift[1] - self._shift[0]
        shown[at_b[last_b]] += self._shift[3] - self._shift[2]
        parts, end = shown.tolist(), 0
        for size in tokens.tolist():
            text = "".join(map(self._names.__getitem__, parts[end : end + size]))
            end += size
            yield hashlib.sha256(text[:-1].encode()).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The worker's aligner for two files."""
    key = (bytes_path, pieces_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


DIGEST = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _chunks(docs: DataFrame, key: str, text: str, bytes_path: str, pieces_path: str) -> DataFrame:
    """Rows of documents (with ``places``) and rows of their chunk's pairs (with ``pairs`` and ``times``)."""
    kind = docs.schema[key].dataType
    names = ["chunk", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(bytes_path, pieces_path)
        held: list[tuple[pa.Array, Aligned]] = []
        links = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk = uuid.uuid4().hex
            keys = pa.concat_arrays([k for k, _ in held])
            n = len(keys)
            each = [np.concatenate([getattr(a, name) for _, a in held]) for name in ("n_a", "n_b", "n_groups", "n_links")]
            digests = [d for _, a in held for d in a.digest]
            listed, inverse, times = np.unique(np.concatenate([a.pairs for _, a in held]), return_inverse=True, return_counts=True)
            bounds = np.concatenate([[0], np.cumsum(each[3])]).tolist()
            places = []
            for a, b in zip(bounds, bounds[1:]):
                own, often = np.unique(inverse[a:b], return_counts=True)
                places.append(zstandard.compress(np.diff(own, prepend=0).astype(np.uint32).tobytes() + often.astype(np.uint32).tobytes()))
            columns = [pa.array([chunk] * n), keys, *map(pa.array, each), pa.array(digests), pa.array(places, pa.binary())]
            yield record(names, [*columns, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))])
            for at in range(0, len(listed), LIST_ROWS):
                some = [pa.array([x[at : at + LIST_ROWS].tolist()], pa.list_(pa.int64())) for x in (listed, times)]
                yield record(names, [pa.array([chunk]), *[pa.nulls(1, c.type) for c in columns[1:]], *some])

        for batch in batches:
            texts = plain(batch.column(1), pa.string())
            for a, b in slices(texts):
                found = both.align(texts[a:b].to_pylist())
                held.append((batch.column(0)[a:b], found))
                links += len(found.pairs)
                if links >= CHUNK_LINKS:
                    yield from out()
                    held, links = [], 0
        if held:
            yield from out()

    schema = (
        f"chunk string, key {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, places binary, pairs array<bigint>, times array<bigint>"
    )
    return docs.select(quoted(key), quoted(text)).mapInArrow(run, schema)


def _settled(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links; ``counts`` has the chunk's pairs."""
    order = np.argsort(counts["pair"].to_numpy())
    n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for packed in docs["places"].to_pylist():
        step, times = np.frombuffer(zstandard.decompress(packed), np.uint32).astype(np.int64).reshape(2, -1)
        own = np.cumsum(step)
        n_best.append(int(times[best[own]].sum()))
        count_sum.append(int((times * n[own]).sum()))
    columns = [docs[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(n_best), pa.array(count_sum), docs["groups_sha256"]], names=["key", *DIGEST, "groups_sha256"])


def align(docs: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the numbers of ``DIGEST`` and ``groups_sha256`` of every row of ``docs``.

    A null or empty text, and one that either tokenizer doesn't spell byte by
    byte (one with U+2581, say), has no tokens: zeros and an empty digest.
    Null and repeated keys stay rows of their own, and equal texts count each
    time. Without rows there are none; columns of ``docs`` beside the two
    named play no part.
    """
    rows = rewritten(_chunks(docs, key, text, bytes_path, pieces_path), "aligned")
    lists = rows.filter("pairs IS NOT NULL")
    flat = lists.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    count = flat.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    count = rewritten(count, "pair_counts")
    most = count.groupBy("b").agg(F.max("n").alias("most"))
    weights = count.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = flat.select("chunk", "pair").join(weights, "pair").select("chunk", "pair", "n", "best")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{c} bigint" for c in DIGEST) + ", groups_sha256 string"
    own = rows.filter("pairs IS NULL").drop("pairs", "times")
    done = renamed(own).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_settled, schema)
    return done.withColumnRenamed("key", key)
