"""Words of many texts as arrays: places and 64-bit hashes, computed a whole batch at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Odd, so that it can be undone; powers count bytes from the start of the batch.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters as random numbers, so that short words differ in all bits.
_LETTERS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes that belong to words: everything but the six ASCII blanks, or ASCII letters and digits and all bytes beyond ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, length: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < length:
        full = np.full(max(length, 1 << 16), base, np.uint64)
        full[0] = 1
        held = _POWERS[base] = np.cumprod(full, dtype=np.uint64)
    return held[:length]


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = values + np.uint64(salt * 0xD1342543DE82EF95 & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xDA942042E4DD58B5)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of consecutive texts. ``begin`` and ``end`` are bytes within the batch, ``bounds`` words of each text."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_BLANK) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``, A-Z in lower case; no word spans two texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = kind[raw]
    before = np.concatenate([[False], inside[:-1]])
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    before[heads] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    tails = offsets[1:][(offsets[1:] > 0)] - 1
    after[tails] = False
    end = np.flatnonzero(inside & ~after) + 1
    up = powers(_BASE, len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[_LOWER[raw]] * up[:-1], dtype=np.uint64)])
    down = powers(_INVERSE, len(raw) + 1)
    hashes = mixed((sums[end] - sums[begin]) * down[begin])
    return Words(hashes, begin, end, np.searchsorted(begin, offsets))


def sequences(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run ``hashes[begin[i]:end[i]]``."""
    up = powers(_BASE, len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    down = powers(_INVERSE, len(hashes) + 1)
    return mixed((sums[end] - sums[begin]) * down[np.minimum(begin, len(hashes))] + (end - begin).astype(np.uint64))
