"""The Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightline.llm import jaccard_join

from .test_corpus import classes, lower


def plain_sets(texts, size):
    out = []
    for text in texts:
        words = lower(text or "").encode().split()
        last = max(len(words) - size + 1, 1 if words else 0)
        out.append({tuple(words[i : i + size]) for i in range(last)})
    return out


def plain_links(sets, percent):
    where, both = defaultdict(list), Counter()
    for i, own in enumerate(sets):
        for s in own:
            where[s].append(i)
    for found in where.values():
        both.update((a, b) for i, b in enumerate(found) for a in found[:i])
    return [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def family(rnd, base, number, changes):
    out = []
    for i in range(number):
        words = list(base)
        for _ in range(rnd.choice(changes)):
            words[rnd.randrange(len(words))] = f"q{rnd.randrange(40)}"
        out.append(" ".join(words))
    return out


def corpus(rnd):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choices(vocabulary, k=k) for k in (60, 150, 12)]
    texts = family(rnd, base[0], 150, [0, 1, 1, 2, 3]) + family(rnd, base[1], 90, [0, 1, 2, 4, 6, 9]) + family(rnd, base[2], 40, [0, 1])
    shared = " ".join(rnd.choices(vocabulary, k=9))
    texts += [f"{shared} {' '.join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 30])))}" for _ in range(80)]
    texts += [" ".join(rnd.choices("ab", k=rnd.randrange(6))) for _ in range(60)]
    texts += [None, "", " \n\t", "One two", "one\x0btwo", "ONE  TWO", "É two", "é two", "a b c " * 40_000, "x y z " * 3, texts[0], texts[3].upper()]
    return texts


@pytest.mark.parametrize("size, percent, limit, block", [(3, 90, 24, 1 << 19), (5, 80, 3, 900)])
def test_components_of(spark, monkeypatch, size, percent, limit, block):
    rnd = random.Random(size)
    texts = corpus(rnd)
    rows = [(None if i % 97 == 5 else i // 2 if i < 40 else i, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, fp binary").repartition(4)
    sets = plain_sets(texts, size)
    lead = classes(range(len(texts)), plain_links(sets, percent))
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[lead[i]] = min(least.get(lead[i], key), key)
    expected = sorted(((r[0], len(s), least.get(lead[i])) for i, (r, s) in enumerate(zip(rows, sets))), key=str)
    monkeypatch.setattr(jaccard_join, "FAMILY", limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW_TEXTS", block)
    got = jaccard_join.components_of(docs, size=size, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == expected
    if size == 3:
        assert jaccard_join.components_of(docs.filter("doc_id < 0"), size=size, percent=percent).collect() == []


def test_crowded_family_keeps_every_link(spark):
    """Pairs just above the limit among hundreds of texts just below it, all of one family."""
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(250):
        one = list(base)
        for j, at in enumerate(rnd.sample(range(0, 200, 6), 4)):
            one[at] = f"c{i}x{j}"
        other = list(one)
        for j, at in enumerate(rnd.sample(range(3, 200, 6), 3)):
            other[at] = f"d{i}x{j}"
        texts += [" ".join(one), " ".join(other)]
    sets = plain_sets(texts, 5)
    lead = classes(range(len(texts)), plain_links(sets, 80))
    assert 100 < len(set(lead.values())) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components_of(docs, size=5, percent=80).collect()}
    assert got == lead


def test_prefixes_hold_the_shared_shingles():
    rnd = random.Random(2)
    for _ in range(400):
        percent = rnd.choice([50, 80, 90, 100])
        one = {rnd.randrange(30) for _ in range(rnd.randrange(1, 25))}
        other = {x for x in one if rnd.random() < 0.95} | {rnd.randrange(40) for _ in range(rnd.randrange(3))}
        both = len(one & other)
        if 100 * both < percent * len(one | other):
            continue
        order = rnd.sample(range(40), 40)
        sides = [sorted(s, key=order.index) for s in (one, other)]
        sizes = np.array([len(s) for s in sides])
        rivals = np.array([rnd.choice([0, 1, 5, 90]) for s in sides for _ in s], float)
        asked, length = jaccard_join.prefixes(sizes, np.repeat([0, 1], sizes), rivals, percent)
        need = min(asked)
        cut = [set(s[: n - a + need]) for s, n, a in zip(sides, length.tolist(), asked.tolist())]
        assert len(cut[0] & cut[1]) >= need
