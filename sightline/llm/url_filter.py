"""URL filtering by Bloom filter cascades, in DataFrame functions only.

A listed rule is a host and a path prefix. A url fits a rule if its host is
the rule's or a subdomain of it and its path starts with the rule's. So the
keys that a url could be listed under are its host's suffixes joined with the
prefixes of its path; whether one of them is listed is a set membership test.

A cascade answers it exactly without holding the keys and without a join.
Level 0 is a Bloom filter of the listed keys. Of the corpus's complete key
universe, those it lets through by mistake make up level 1; the listed keys
that level 1 lets through make up level 2, and so on until nothing is left. A
key is listed if the first level that stops it has an odd number. Every level
is a small constant array of bit words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import fresh, quoted
from sightline.session import cut_lineage

#: Hash functions of a level, and bits for each key of a level.
HASHES, BITS_PER_KEY = 3, 8
#: A level is one constant of a plan: at most so many bits (32 MB), else the list must be cut into several.
MOST_BITS = 1 << 28
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *A_TO_Z)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Array of the keys a url could be listed under, longest host first.

    A key is a host suffix joined with a path prefix whose length some rule
    has. Paths start with ``/``, which a host has not, so keys are unambiguous.
    """
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _filter_words(keys: DataFrame, level: int, bits: int) -> str:
    """The level's bit words in hexadecimal, 16 digits each, set by the rows of ``keys`` (column ``key``)."""
    places = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))).alias("bits")
    )
    got = {r["word"]: r["bits"] & ((1 << 64) - 1) for r in words.collect()}  # at most bits / 64 words
    return ",".join(str(v - (1 << 64) if v >> 63 else v) for v in (got.get(w, 0) for w in range(bits // 64)))


class Cascade:
    """Exact membership in a list, for the keys of one universe."""

    def __init__(self, levels: list[tuple[int, str]]):
        self.levels = levels
        self._words = [F.split(F.lit(words), ",").cast("array<bigint>") for _, words in levels]

    def passes(self, key: Column, level: int) -> Column:
        bits = self.levels[level][0]
        held = [
            F.getbit(F.element_at(self._words[level], (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1
            for p in _positions(key, level, bits)
        ]
        both = held[0]
        for h in held[1:]:
            both = both & h
        return both

    def contains(self, key: Column) -> Column:
        """True for listed keys: the first level that stops a key is an odd one."""
        last = len(self.levels)
        answer = F.lit(last % 2 == 1)  # what every level lets through belongs to the side of the last one
        for level in reversed(range(last)):
            answer = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def build(listed: DataFrame, universe: DataFrame, most_levels: int = 40) -> Cascade:
    """A cascade of the ``key`` column of ``listed``, exact on that of ``universe``.

    Nulls are left out and repeated keys count once. An empty list gives a
    cascade that contains nothing; an empty universe one level. The universe
    is tested where it lies: only the few keys that a level lets through
    wrongly are gathered, and each level holds a small share of the one but
    one before.
    """
    listed = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    universe = universe.select("key").filter(F.col("key").isNotNull())
    levels: list[tuple[int, str]] = []
    inside, outside = listed, universe
    for level in range(most_levels):
        mine = inside if level % 2 == 0 else outside
        number = mine.count()
        if number == 0:
            return Cascade(levels)
        bits = max(64, -(-number * BITS_PER_KEY // 64) * 64)
        if bits > MOST_BITS:
            raise ValueError(f"a level of {number} keys exceeds {MOST_BITS} bits; judge the list in parts")
        levels.append((bits, _filter_words(mine, level, bits)))
        passed = Cascade(levels).passes(F.col("key"), level)
        if level == 0:
            # Listed keys always pass; what else passes is small and settles here.
            outside = cut_lineage(universe.filter(passed).join(listed, "key", "left_anti").distinct())
        elif level % 2 == 0:
            outside = cut_lineage(outside.filter(passed))
        else:
            inside = cut_lineage(inside.filter(passed))
    raise ValueError("the cascade doesn't end: two keys agree in every hash")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``block`` or ``allow``);
    a rule listed under both is an error of the list and counts as ``block``.
    The longest fitting rule decides, of two equally long ones the one that
    blocks; a url that no rule fits gets ``default``: a list of names lets
    pass what it doesn't name. A null url, or one
    without ``://``, has an empty host and path and fits no rule. Columns of
    ``pages`` called like the added ones are replaced.
    """
    listed = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(F.translate("host", *A_TO_Z), "path").alias("key"), "verdict", F.length("path").alias("length")
    )
    lengths = [r["length"] for r in listed.select("length").distinct().collect()]  # as many as paths are long
    added = ("host", "path", "rule", "verdict")
    rest = [quoted(c) for c in pages.columns if c.lower() not in added]
    split = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = split.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    cascades = {v: build(listed.filter(F.col("verdict") == v), universe) for v in ("block", "allow")}
    keys = keys_of(F.col("host"), F.col("path"), lengths)

    def longest(verdict: str) -> Column:
        fits = F.filter(keys, lambda k: cascades[verdict].contains(k))
        return F.aggregate(
            fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a)
        )

    block, allow = fresh(pages, "block"), fresh(pages, "allow")
    found = split.select(*rest, "host", "path", longest("block").alias(block), longest("allow").alias(allow))
    blocked = F.col(allow).isNull() | (F.length(block) >= F.length(allow))
    return found.select(
        *rest,
        "host",
        "path",
        F.when(F.col(block).isNotNull() & blocked, F.col(block)).otherwise(F.col(allow)).alias("rule"),
        F.when(F.col(block).isNotNull() & blocked, F.lit("block"))
        .when(F.col(allow).isNotNull(), F.lit("allow"))
        .otherwise(F.lit(default))
        .alias("verdict"),
    )
