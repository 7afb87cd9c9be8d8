"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

from sightline.llm import collocations

from .test_corpus import lower

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain_collocations(rows, least, widest, most):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [c for p, c in f.items() if len(p) == 3 and len(phrase) == 2 and phrase in (p[:2], p[1:])]
            if any(100 * c >= widest * a for c in longer if c >= least):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def test_collocations(spark):
    rnd = random.Random(8)
    words = ["a", "B", "c", "Dd", "é", " ", "z\x0by", "\U0001f600", "k\x00"]
    rows = []
    for _ in range(160):
        text = "".join(rnd.choice(words[: rnd.choice([3, 9])]) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]) for _ in range(rnd.randrange(60)))
        rows.append((text, rnd.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), ("a b c. " * 3000, "en"), ("of the kind " * 40, "fr"), ("x y", "fr"), ("\n\n.", "it")]
    rows += [rows[0]] * 5
    frame = spark.createDataFrame([(*r, 1, b"x") for r in rows], "text string, lang string, phrase int, bucket binary").repartition(3)
    for least, widest, most in ((10, 50, 2000), (2, 90, 7)):
        got = collocations.collocations(frame, least=least, widest=widest, most=most).collect()
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_collocations(rows, least, widest, most)
    assert collocations.collocations(frame.filter("phrase = 2")).collect() == []


def test_large_counts_stay_exact(spark):
    stream = [("en", 1, "x", 9_000_000_000), ("en", 1, "y", 7_000_000_001), ("en", 2, "x y", 6_999_999_999)]
    frame = spark.createDataFrame(stream, "lang string, size int, phrase string, f long")
    row = collocations.scored(frame).first()
    assert row["score"] == 10**6 * 6_999_999_999**2 // (9_000_000_000 * 7_000_000_001)


def test_slices_end_with_pieces():
    texts = [b"A b, c\td", b"", b"one.two three" * 50, b"no end here " * 30]
    whole = b"\n".join(texts).lower().replace(b",", b"\n").replace(b".", b"\n").replace(b"\t", b" ")
    found = list(collocations._slices(texts, 40))
    assert b"\n".join(found) == whole and len(found) > 10
