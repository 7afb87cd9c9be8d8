"""Token ids of texts by the ``tokenizers`` library, many texts at a time.

The library spends most of its time on words it has met before. Its
pre-tokenizer never joins a word to white space that follows it, so a text
may be cut before its blanks and line feeds and the pieces encoded alone:
each distinct piece goes to the library once, and texts are put together from
the ids of their pieces. Where white space meets white space a cut could
matter; such a text goes to the library whole (``_doubtful``).
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.llm.common import held

#: What a worker keeps between batches: at most so many pieces, and so many characters of them.
MOST_PIECES, MOST_CHARS = 800_000, 24 << 20
#: A word of Latin letters and what may close it: two pre-tokens at most, whatever the library's Unicode tables.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
_ID = attrgetter("id")
#: New pieces handed to the library as one text.
TOGETHER = 4096


def _actual(key: str) -> str:
    """The piece a key stands for: a line feed leads itself, a text's first piece is marked by one blank; every
    other piece follows a blank of the text.
    """
    if key[:1] == "\n":
        return key
    return key[1:] if key[:1] == " " else f" {key}"


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids`` of the file's tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        tokens = sorted(self._library.get_vocab(with_added_tokens=True).items(), key=lambda t: t[1])
        self._leads = np.zeros(tokens[-1][1] + 1, bool)  # tokens that start with a blank or a line feed
        for token, ident in tokens:
            self._leads[ident] = token[:1] in ("Ġ", "Ċ")
        self._model = self._library.model
        self._shown = shown_bytes(self._library) | {32: "\u0120"}
        self._closing: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._chars = 0
        self._ids = np.zeros(1 << 20, np.int32)  # ids of the pieces, one after the other
        self._starts, self._sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._opens, self._closes = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self._uses = np.zeros(1 << 16, np.int8)  # calls of ``encode`` that met a piece, as far as they are counted
        self._used = 0

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self._place), len(self._place) + len(keys)
        self._ids = _room(self._ids, self._used + len(ids))
        self._ids[self._used : self._used + len(ids)] = ids
        for name in ("_starts", "_sizes", "_opens", "_closes"):
            setattr(self, name, _room(getattr(self, name), last))
        self._sizes[first:last] = sizes
        self._starts[first:last] = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        self._place.update(zip(keys, range(first, last)))
        self._chars += sum(map(len, keys))

    def _learn(self, keys: list[str]) -> None:
        # One pre-token of letters with its blank, one of marks: the library's model merges each on its own.
        words = [m for m in map(_WORD.fullmatch, keys) if m]
        if words:
            pairs = [m.groups() for m in words]
            unknown = list(dict.fromkeys(stem for stem, _ in pairs if stem not in self._place))
            new, starts = self._stems(unknown)
            at = dict(zip(unknown, zip(starts.tolist(), starts[1:].tolist())))
            ids: list[int] = []
            sizes = []
            for stem, marks in pairs:
                own = at.get(stem)
                ids += new[own[0] : own[1]] if own else self._known(stem)
                if marks:
                    ids += self._marks(marks)
                sizes.append(len(ids))
            self._add([m.string for m in words], np.array(ids, np.int32), np.diff(np.array([0, *sizes], np.int64)))
        if len(words) < len(keys):
            self._learn_others([k for k in keys if k not in self._place])

    def _known(self, stem: str) -> list[int]:
        place = self._place[stem]
        return self._ids[self._starts[place] : self._starts[place] + self._sizes[place]].tolist()

    def _stems(self, stems: list[str]) -> tuple[list[int], np.ndarray]:
        """(ids of all stems one after the other, where each begins, and the end).

        Several go to the model at once: no token holds a blank behind a letter, so none spans two of them.
        """
        ids: list[int] = []
        for at in range(0, len(stems), 32):
            shown = "\u0120" + " ".join(stems[at : at + 32]).encode().decode("latin-1").translate(self._shown)
            ids.extend(map(_ID, self._model.tokenize(shown)))
        starts = np.append(np.flatnonzero(self._leads[np.array(ids, np.int64)]), len(ids))
        if len(starts) != len(stems) + 1:
            raise AssertionError("the tokenizer joins words to white space")
        return ids, starts

    def _marks(self, marks: str) -> list[int]:
        if marks not in self._closing:
            self._closing[marks] = self._library.encode(marks, add_special_tokens=False).ids
        return self._closing[marks]

    def _learn_others(self, keys: list[str]) -> None:
        # Words without further white space are encoded as one text: each begins where a token starts with its blank.
        cores = [k[1:] if k[:1] == "\n" else k for k in keys]
        words = [k for k, core in zip(keys, cores) if k[:1] != " " and core.split() == [core]]
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            joined = self._library.encode_batch_fast(["".join(map(_actual, some))], add_special_tokens=False)
            ids = np.array(joined[0].ids, np.int32)
            begins = np.flatnonzero(self._leads[ids])
            if len(begins) != len(some):
                raise AssertionError("the tokenizer joins words to white space")
            self._add(some, ids, np.diff(np.append(begins, len(ids))))
        taken = set(words)
        others = [k for k in keys if k not in taken]
        found = [e.ids for e in self._library.encode_batch_fast(list(map(_actual, others)), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self._place)
        self._add(others, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)
        for place, key in enumerate(others, first):
            piece = _actual(key)
            self._opens[place] = len(piece) < 2 or piece[1].isspace()  # white space follows the white space it begins with
            self._closes[place] = piece[-1:].isspace()

    def _places(self, keys: list[str]) -> np.ndarray:
        places = np.fromiter(map(self._place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            wanted = [keys[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(wanted)))
            places[missing] = np.fromiter(map(self._place.__getitem__, wanted), np.int64, len(wanted))
        return places

    def _thin(self) -> None:
        """Forget the pieces that no more than one call of ``encode`` has met: of many words most are met once."""
        used = np.flatnonzero(self._uses[: len(self._place)] > 1)
        chars = np.fromiter(map(len, self._place), np.int64, len(self._place))
        if 2 * len(used) > MOST_PIECES or 2 * chars[used].sum() > MOST_CHARS:
            return self._forget()
        keys = list(self._place)
        kept = [keys[i] for i in used.tolist()]
        sizes = self._sizes[used]
        ends = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._starts[used] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        opens, closes = self._opens[used], self._closes[used]
        self._forget()
        self._add(kept, ids, sizes)
        self._opens[: len(kept)], self._closes[: len(kept)] = opens, closes

    def _doubtful(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows with a cut between white space and white space (or the end)."""
        cut = self._closes[places[:-1]] & self._opens[places[1:]]
        heads = bounds[1:-1]
        cut[heads[heads > 0] - 1] = False  # the next text begins here
        return np.unique(np.searchsorted(bounds, np.flatnonzero(cut), side="right") - 1)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self._place) > MOST_PIECES or self._chars > MOST_CHARS:
            self._thin()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        special = pc.match_substring(texts, "<|")  # may hold a special token
        plain = pc.if_else(special, "", texts) if special.true_count else texts
        pieces = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.dictionary_encode()  # most pieces of a call are repeated in it
        indices, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = indices[bounds[:-1]]
        counts = np.bincount(indices, minlength=len(words)) - np.bincount(heads, minlength=len(words))
        inner = np.flatnonzero(counts)  # the rest only begin texts
        place_of = np.zeros(len(words), np.int64)
        place_of[inner] = self._places([words[i] for i in inner.tolist()])
        firsts = self._places([" " + words[i] for i in heads.tolist()])
        self._met(np.concatenate([place_of[inner], np.unique(firsts)]))
        places = place_of[indices]
        places[bounds[:-1]] = firsts
        whole = np.union1d(np.flatnonzero(special.to_numpy(zero_copy_only=False)), self._doubtful(places, bounds))
        sizes = self._sizes[places]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        # Where each output id stands in the pool: runs of consecutive places.
        ids = self._ids[np.repeat(self._starts[places] - ends[:-1], sizes) + np.arange(ends[-1])]
        starts = ends[bounds]
        if not len(whole):
            return ids, np.diff(starts)
        found = self._library.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
        of_row = dict(zip(whole.tolist(), found))
        parts, counts, at = [], np.diff(starts), 0
        for row, encoding in of_row.items():
            parts += [ids[at : starts[row]], np.array(encoding.ids, np.int32)]
            at, counts[row] = starts[row + 1], len(parts[-1])
        return np.concatenate([*parts, ids[at:]]), counts

    def _met(self, places: np.ndarray) -> None:
        self._uses = _room(self._uses, len(self._place))
        self._uses[places] = np.minimum(self._uses[places], 2) + 1


def shown_bytes(library) -> dict[int, str]:
    """How a byte-level pre-tokenizer shows the bytes of Latin letters: for ``str.translate`` of Latin-1 text."""
    letters = {b: chr(b) for b in range(128) if chr(b).isalpha()}
    return letters | {b: _shown_as(library, b) for b in range(128, 256)}


def _shown_as(library, byte: int) -> str:
    """The character that stands for a byte above ASCII: it is the second or the first byte of some letter."""
    text = bytes([0xC3, byte]).decode() if byte < 0xC0 else (bytes([byte, 0x80]).decode() if 0xC2 <= byte < 0xE0 else "")
    if not text:
        return "\0"  # no byte of a Latin letter
    shown = "".join(piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(text))
    return shown[-1] if byte < 0xC0 else shown[0]


def _room(array: np.ndarray, length: int) -> np.ndarray:
    while length > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; what it has learned is kept between tasks."""
    return held("byte_bpe", (path,), lambda: Encoder(path))
