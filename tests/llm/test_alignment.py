"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from sightline.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n", " \n", "a\nb", "a \nb\n", "x  y", "tab\tq", "<|endoftext|> <s> </s>", "▁x", "日本語テキスト é\U0001f600x"]
ODD += ["a\x00b", "  lead", "trail ", "trail  ", "　wide nb", "\r\n\r\n", "<0x41>", "don't I'll 12345 6789", "x" * 3000, " é" * 400]


def plain_alignment(texts):
    library = Tokenizer.from_file(A_FILE)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    back, found, links = alignment.byte_of_character(), [], []
    for text in texts:
        ids = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        spelt = [
            [bytes(back[c] for c in library.id_to_token(i)) for i in ids[0]],
            [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        ]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            found.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(b) for b in s]).tolist() for s in spelt]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(cut) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, i[a:u])) for i, a, u in zip(ids, at, upto)))
            at = upto
        own, i, j = [], 0, 0
        while i < len(ids[0]):
            own.append((ids[0][i], ids[1][j]))
            i, j = i + (ends[0][i] <= ends[1][j]), j + (ends[1][j] <= ends[0][i])
        links.append(own)
        found.append((len(ids[0]), len(ids[1]), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(*f[:4], sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), f[4]) for f, own in zip(found, links)]


def odd_texts(seed, number):
    rnd = random.Random(seed)
    parts = ["the", "Word", "é", "\U0001f600", " ", " ", "  ", "\n", "\t", "1984", "'s", "日本", "▁", "\x00", "<s>", "-", " "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(number)]


def test_align(spark, small):
    texts = ODD + odd_texts(3, 150) + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()]
    texts += [texts[-1]] * 7
    rows = [(None if i % 50 == 3 else i // 2, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, chunk binary").repartition(3)
    got = alignment.align(docs, A_FILE, B_FILE).collect()
    columns = ("doc_id", *alignment.DIGEST, "groups_sha256")
    expected = [(r[0], *f) for r, f in zip(rows, plain_alignment(texts))]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(expected, key=str)
    assert alignment.align(docs.filter("doc_id < 0"), A_FILE, B_FILE).collect() == []


def test_shared_cuts_halve_whole_intervals():
    rnd = random.Random(5)
    for _ in range(300):
        end_a, end_b, first, base = [], [], [0], 0
        for _ in range(rnd.randrange(1, 5)):
            size = rnd.randrange(1, 60)
            for ends in (end_a, end_b):
                ends += sorted(base + x for x in {*rnd.sample(range(1, size + 1), rnd.randrange(size)), size})
            first.append(len(end_a))
            base += size
        a, b = alignment.shared_cuts(np.array(end_a), np.array(end_b), np.array(first))
        common = sorted(set(end_a) & set(end_b))
        assert [end_a[i] for i in a] == common == [end_b[i] for i in b]


def test_what_a_worker_knows_is_bounded(monkeypatch):
    texts = ["".join(p) for p in zip(odd_texts(9, 240), odd_texts(10, 240))] + ["The same few words. " * 9] * 5
    whole = alignment.Aligner(A_FILE, B_FILE).align(texts)
    monkeypatch.setattr(alignment, "MOST_WORDS", 5)
    small = alignment.Aligner(A_FILE, B_FILE)
    parts = [small.align(texts[at : at + 10]) for at in range(0, len(texts), 10)]
    assert len(small.b.known(0)) < 500
    assert [d for p in parts for d in p.digest] == whole.digest
    assert np.concatenate([p.pairs for p in parts]).tolist() == whole.pairs.tolist()
