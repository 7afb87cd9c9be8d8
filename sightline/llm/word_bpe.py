"""BPE encoding through a lexicon of frequent words, and decoding.

The lexicon is a minimal acyclic transducer: a word automaton whose equal
suffixes are shared, with a number on each arc. The numbers along a word's
path add up to its rank among the lexicon's words, and the rank leads to its
ids. It is compiled from the corpus's most frequent words, shipped as one flat
file, and memory-mapped by the workers, so that those of one machine share its
pages. Lookups walk all new words of a batch at once, a letter at a time.
Words it doesn't hold are merged by the tokenizer itself, so ids are always
those of the whole text.

Words are cut at blanks and line feeds only, both of which the tokenizer drops
as white space before it looks at words, and which no normalisation joins to
a neighbour; anything else stays inside a word and is the tokenizer's to cut.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.byte_bpe import shown_bytes
from sightline.llm.common import held, plain, quoted, record, release, slices
from sightline.session import cut_lineage

#: Words of the lexicon; what a worker keeps between batches (words, characters); words counted before handing on.
LEXICON_WORDS, MOST_WORDS, MOST_CHARS, COUNTED = 100_000, 500_000, 12 << 20, 400_000
_MAGIC = b"SLEXICON"
#: A word of Latin letters (each one composed, with one lower-case form) and what may close it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")
#: Counts from here on are told apart no further when the lexicon's words are chosen.
_FREQUENT = 1 << 16


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


# The lexicon --------------------------------------------------------------------------------------------------------


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The flat transducer of (word, ids) pairs; words are distinct.

    Built from the sorted words one by one: when a word is done, the part of
    the path that the next one leaves is frozen, and a frozen state equal to
    an earlier one is replaced by it. That keeps the automaton minimal.
    """
    entries = sorted(entries)
    registered: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # frozen: (accepts, ((letter, state), ...))

    def freeze(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in registered:
            registered[shape] = len(states)
            states.append(shape)
        return registered[shape]

    path: list[list] = [[False, []]]  # open states along the current word: [accepts, arcs]
    before = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        for depth in range(len(before), common, -1):
            path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    below = np.zeros(len(states), np.int64)  # words that can be completed from a state
    first, letter, to, add = [0], [], [], []
    for number, (accepts, arcs) in enumerate(states):  # children are frozen before their parents
        passed = int(accepts)
        for byte, state in arcs:
            letter.append(byte)
            to.append(state)
            add.append(passed)
            passed += int(below[state])
        below[number] = passed
        first.append(len(letter))
    ids = [i for _, i in entries]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32) if ids else np.zeros(1, np.int32)
    # Arcs are found by state * 256 + letter in one sorted array.
    arcs_of = np.repeat(np.arange(len(states), dtype=np.int64), np.diff(first)) * 256 + np.array(letter, np.int64)
    order = np.argsort(arcs_of)
    tables = [
        arcs_of[order],
        np.array(to, np.int32)[order],
        np.array(add, np.int32)[order],
        np.array([s[0] for s in states], np.uint8),
        starts,
        np.fromiter(chain.from_iterable(ids), np.int32, int(starts[-1])),
    ]
    head = np.array([root, *[len(t) for t in tables]], np.int64).tobytes()
    return _MAGIC + head + b"".join(t.tobytes() + b"\0" * (-t.nbytes % 8) for t in tables)


class Lexicon:
    """A memory-mapped lexicon."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        head = raw[8:64].view(np.int64)
        self.root, at, tables = int(head[0]), 64, []
        for length, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            size = length * np.dtype(kind).itemsize
            tables.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        self.arcs, self.to, self.add, self.accepts, self.starts, self.ids = tables

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words it doesn't hold."""
        if not words or not len(self.arcs):
            return np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(sizes > 0)
        lost = sizes == 0
        step = 0
        while len(alive):
            wanted = state[alive] * 256 + letters[at[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            found = self.arcs[arc] == wanted
            lost[alive[~found]] = True
            alive, arc = alive[found], arc[found]
            rank[alive] += self.add[arc]
            state[alive] = self.to[arc]
            step += 1
            alive = alive[sizes[alive] > step]
        return np.where(lost | (self.accepts[state] == 0), -1, rank)

    def ids_of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each)."""
        sizes = (self.starts[ranks + 1] - self.starts[ranks]).astype(np.int64)
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ranks] - (ends - sizes), sizes)
        return self.ids[shift + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


# Encoding and decoding ----------------------------------------------------------------------------------------------


class Coder:
    """Encodes and decodes whole texts as the tokenizer file does."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._lexicon = lexicon
        self._model, self._shown, self._closing = self._library.model, shown_bytes(self._library), {}
        vocabulary = self._library.get_vocab(with_added_tokens=True)
        self._tokens = [""] * (max(vocabulary.values()) + 1)
        for token, ident in vocabulary.items():
            self._tokens[ident] = token
        self._specials = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._numbers = [str(i) for i in range(len(self._tokens))]
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._chars = 0
        self._ids = np.zeros(0, np.int32)
        self._sizes = np.zeros(0, np.int64)
        self._starts = np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the tokenizer itself: (ids one after the other, number of each).

        A plain word and the marks behind it are two pre-tokens; its merges come from the tokenizer's model, without
        the way through normaliser and pre-tokenizer.
        """
        found: list[list[int] | None] = []
        for word in words:
            parts = _WORD.fullmatch(word)
            if parts is None:
                found.append(None)
                continue
            stem, marks = parts.groups()
            shown = stem.lower().encode().decode("latin-1").translate(self._shown)
            ids = [t.id for t in self._model.tokenize(shown)]
            found.append(ids + self._marks(marks) if marks else ids)
        rest = [w for w, own in zip(words, found) if own is None]
        others = iter([e.ids for e in self._library.encode_batch_fast(rest, add_special_tokens=False)])
        found = [own if own is not None else next(others) for own in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _marks(self, marks: str) -> list[int]:
        if marks not in self._closing:
            self._closing[marks] = self._library.encode(marks, add_special_tokens=False).ids
        return self._closing[marks]

    def _learn(self, words: list[str]) -> None:
        if self._lexicon is not None:
            ranks = self._lexicon.ranks([w.encode() for w in words])
        else:
            ranks = np.full(len(words), -1, np.int64)
        held = np.flatnonzero(ranks >= 0)
        unseen = np.flatnonzero(ranks < 0)
        parts = [self._lexicon.ids_of(ranks[held])] if len(held) else []
        parts.append(self.merge([words[i] for i in unseen.tolist()]))
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        base = len(self._ids)
        starts = base + np.cumsum(sizes) - sizes
        first = len(self._place)
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        self._sizes, self._starts = np.concatenate([self._sizes, sizes]), np.concatenate([self._starts, starts])
        ordered = [words[i] for i in np.concatenate([held, unseen]).tolist()]
        self._place.update(zip(ordered, range(first, first + len(ordered))))
        self._chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self._place) > MOST_WORDS or self._chars > MOST_CHARS:
            self._forget()
        words = [[t] if any(s in t for s in self._specials) else words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        places = np.fromiter(map(self._place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            wanted = [every[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(wanted)))
            places[missing] = np.fromiter(map(self._place.__getitem__, wanted), np.int64, len(wanted))
        sizes = self._sizes[places]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self._ids[np.repeat(self._starts[places] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])])

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's ``decode(ids, skip_special_tokens=False)``: it has no decoder and joins its tokens by blanks."""
        return " ".join(map(self._tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self._numbers.__getitem__, ids))


def coder(path: str, lexicon: str | None = None) -> Coder:
    """The worker's coder; what it has learned is kept between tasks. ``lexicon`` names a file sent with ``ship``."""
    return held("word_bpe", (path, lexicon), lambda: Coder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None))


# Over a corpus ------------------------------------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    counted: Counter[str] = Counter()
    for batch in batches:
        texts = plain(batch.column(0), pa.string())
        for a, b in slices(texts):
            for text in texts[a:b].to_pylist():
                counted.update(words_of(text))
            if len(counted) > COUNTED:
                yield record(["word", "n"], [list(counted), list(counted.values())])
                counted.clear()
    if counted:
        yield record(["word", "n"], [list(counted), list(counted.values())])


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all texts with their counts ``n``: at most ``most``, and all that are as frequent
    as the rarest of them or none.

    A histogram of the counts (at most ``_FREQUENT`` rows) tells from which count on they are few enough, so that no
    task sends its own best ones to the driver.
    """
    counted = cut_lineage(
        docs.select(text)
        .mapInArrow(_counts, "word string, n bigint")
        .filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > 1)
    )
    held, least = 0, _FREQUENT + 1
    steps = counted.groupBy(F.least("n", F.lit(_FREQUENT)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    for step in sorted(steps, reverse=True):
        held += step["words"]
        if held > most:
            break
        least = step["n"]
    return counted.filter(F.col("n") >= least)


def ship(spark: SparkSession, words: list[str], path: str) -> str:
    """Compile the lexicon of ``words`` (at most some hundred thousand) and send it to every machine; its file's name.

    The file's name is that of its content, so an equal lexicon is sent once.
    """
    plain_coder = Coder(path)
    words = [w for w in words if not any(s in w for s in plain_coder._specials)]
    ids, sizes = plain_coder.merge(words)
    ends = np.cumsum(sizes)
    entries = [(w.encode(), ids[e - s : e].tolist()) for w, s, e in zip(words, sizes.tolist(), ends.tolist())]
    flat = compile_lexicon(entries)
    name = f"lexicon-{hashlib.sha256(flat).hexdigest()[:16]}.bin"
    if name not in getattr(spark.sparkContext, "_lexicons", set()):
        local = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)  # the driver's own; Spark copies it to executors
        with open(local, "wb") as file:
            file.write(flat)
        spark.sparkContext.addFile(local)
        spark.sparkContext._lexicons = getattr(spark.sparkContext, "_lexicons", set()) | {name}
    return name


def lexicon_of(docs: DataFrame, path: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Ship the lexicon of a corpus's most frequent words; at most ``most`` of them pass through the driver."""
    words = [r["word"] for r in frequent_words(docs, text, most).collect()]
    return ship(docs.sparkSession, words, path)


def _kept(docs: DataFrame, text: str, added: tuple[str, ...]) -> tuple[list[str], str]:
    rest = [c for c in docs.columns if c.lower() not in added]
    return rest, ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest)


def encode(docs: DataFrame, path: str, lexicon: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text (null: none); a column called ``out`` is replaced."""
    rest, schema = _kept(docs, text, (out.lower(),))
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon)
        for batch in batches:
            texts = plain(batch.column(place), pa.string())
            for a, b in slices(texts):
                ids, counts = own.encode(texts[a:b].to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield record([*rest, out], [*batch.slice(a, b - a).columns, lists])

    return docs.select(*map(quoted, rest)).mapInArrow(run, f"{schema}, {quoted(out)} array<int>")


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of every list of ids (null: empty); a column called ``out`` is replaced."""
    rest, schema = _kept(docs, ids, (out.lower(),))
    place = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [own.decode(x or []) for x in part.column(place).to_pylist()]
                yield record([*rest, out], [*part.columns, pa.array(texts, pa.string())])

    return docs.select(*map(quoted, rest)).mapInArrow(run, f"{schema}, {quoted(out)} string")


def round_trip(docs: DataFrame, path: str, lexicon: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: each text encoded, and its ids decoded, in one pass.

    ``ids_sha256`` is of the decimal ids joined by one blank, both digests in
    lower-case hexadecimal. A null or empty text has no ids and decodes to an
    empty text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon)
        for batch in batches:
            texts = plain(batch.column(1), pa.string())
            for a, b in slices(texts):
                ids, counts = own.encode(texts[a:b].to_pylist())
                numbers, at, digests = ids.tolist(), 0, []
                for count in counts.tolist():
                    mine = numbers[at : at + count]
                    at += count
                    digests.append([hashlib.sha256(f(mine).encode()).hexdigest() for f in (own.decimal, own.decode)])
                yield record(
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                    [batch.column(0)[a:b], counts, [d[0] for d in digests], [d[1] for d in digests]],
                )

    return docs.select(key, text).mapInArrow(
        run, f"{quoted(key)} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
