"""Every stage of the pipeline against a plain version, on small tables with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from sightline.llm import decontaminate, language, near_copies
from sightline.session import scratch_dir

from .test_corpus import BLANKS, classes, lower, plain_distance

WIDTH = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def corpus(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rnd = random.Random(4)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    more = [None, "", "12 34 %%", "Привет, как дела сегодня вечером", rows[3][1], rows[3][1], rows[3][1] + " tail", bench[2][1], "the end of it"]
    more += [f"An ever repeated line\n{r[1][:150]}" for r in rows[:14]] + [rows[7][1]] * 12 + ["the and of " * 20_000]
    rows += [(5000 + i, t, rnd.choice(["en", None]), "odd", len(t or "")) for i, t in enumerate(more)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], WIDTH)
    folder = scratch_dir(spark, "corpus")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, bench


def test_stages(spark, corpus):
    folder, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        after = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/{name}").collect()}
        assert len(after) == spark.read.parquet(f"{folder}/{name}").count()
        if name != "encoding":
            assert out.columns == docs.columns
        globals()[f"check_{name}"](spark, docs, before, after, bench)
        docs, before = spark.read.parquet(f"{folder}/{name}"), after
    whole = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {tuple(r) for r in after.values()}


def check_language_id(spark, docs, before, after, bench):
    model = language.learn(docs)
    keys = sorted(before)
    _, _, rejected = model.predict([(before[k]["text"] or "").encode() for k in keys])
    gone = {k for k, r in zip(keys, rejected) if r}
    assert before.keys() - after.keys() == gone == {5000, 5001, 5002, 5003}
    assert all(after[k] == before[k] for k in after)


def check_line_dedup(spark, docs, before, after, bench):
    where = defaultdict(list)
    for k, r in before.items():
        seen = {}
        for i, line in enumerate((r["text"] or "").split("\n")):
            seen.setdefault(lower(line.strip(BLANKS)), i)
        for line, i in seen.items():
            where[line].append((k, i))
    repeated = {line: min(at) for line, at in where.items() if line and len(at) >= 10}
    assert repeated
    for k, r in before.items():
        lines = r["text"].split("\n")
        kept = [x for i, x in enumerate(lines) if repeated.get(lower(x.strip(BLANKS)), (k, i)) == (k, i)]
        if len(kept) < len(lines) and not "".join(kept).strip(BLANKS):
            assert k not in after
        else:
            assert after[k]["text"] == "\n".join(kept)
            assert after[k]["n_chars"] == (len("\n".join(kept)) if len(kept) < len(lines) else r["n_chars"])
            assert after[k]["kept"] == "extra"


def check_near_duplicates(spark, docs, before, after, bench):
    keys = list(before)
    sets = dict(zip(keys, shingle_sets([before[k]["text"] for k in keys])))
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert after.keys() == set(classes(keys, links).values()) < before.keys()
    assert all(after[k] == before[k] for k in after)


def check_decontamination(spark, docs, before, after, bench):
    split = lambda t: [lower(w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
    gone = before.keys() - after.keys()
    for k, r in before.items():
        own, dirty, exact = split(r["text"]), False, False
        if len(own) < 5000:
            held = set(own)
            for _, passage in bench:
                item = split(passage)
                if sum(w in held for w in item) >= 0.8 * len(item):
                    edits = plain_distance(item, own)
                    dirty |= edits <= decontaminate.allowed(len(item), decontaminate.TOLERANCE)
                    exact |= edits == 0
        assert not (exact and k not in gone) and not (k in gone and not dirty and len(own) < 5000)
    assert gone


def check_encoding(spark, docs, before, after, bench):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert after.keys() == before.keys()
    for k, r in list(before.items())[::3]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert after[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert after[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_stage_takes_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.createDataFrame([], WIDTH)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "encoding":
            assert out.columns == docs.columns


def shingle_sets(texts):
    split = [lower(t or "").split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def test_near_copies_against_brute_force_jaccard(spark):
    rnd = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for words_, edits in [(200, 1), (200, 2), (200, 4), (500, 10), (60, 1)] * 20:
        own = rnd.choices(pool, k=words_)
        copy = list(own)
        for at in rnd.sample(range(5, words_ - 5), edits):
            copy[at] = "edited"
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(copy))]
    base = rnd.choices(pool, k=300)
    for _ in range(150):  # a large family, and half copies that must stay apart
        copy = list(base)
        copy[rnd.randrange(300)] = rnd.choice(pool)
        rows.append((len(rows), " ".join(copy)))
    for _ in range(20):
        rows.append((len(rows), " ".join(base[:150] + rnd.choices(pool, k=150))))
    rows += [(len(rows) + i, t) for i, t in enumerate(["A b", "a  B", "a b c", "", None, "rep " * 30_000, rows[0][1].upper()])]
    sets = shingle_sets([t for _, t in rows])
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    true = [(a, b) for a in range(len(rows)) for b in range(a) if alike(a, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    after = {r["doc_id"] for r in near_copies.keep_one(frame).collect()}
    expected = set(classes(range(len(rows)), true).values())
    assert after == expected
    planted = [b for a, b in pairs if alike(a, b)]
    assert len(planted) > 60 and not after & set(planted)


def test_near_copies_keep_texts_that_share_an_id(spark):
    text, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, text), (5, text + " end"), (5, other), (5, other), (None, text), (None, text)]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text), (5, other), (None, text), (None, text)], key=str)
    assert near_copies.keep_one(got.limit(0)).count() == 0


def test_leaks_of_longer_items_are_found_wherever_they_are_edited(spark):
    rnd = random.Random(21)
    pool = [f"w{i}" for i in range(2000)]
    items, rows = [], []
    for number in range(600):
        item = rnd.choices(pool, k=rnd.choice([26, 30, 35, 40, 59, 80, 120]))
        own = list(item)
        for at in sorted(rnd.sample(range(len(own)), len(own) // 5), reverse=True):
            own[at : at + 1] = rnd.choice([[], ["edited"], [own[at], "more"]])
        items.append((number, " ".join(item)))
        rows.append((number, " ".join(rnd.choices(pool, k=30) + own + rnd.choices(pool, k=30))))
    clean = [(1000 + i, " ".join(rnd.choices(pool, k=150))) for i in range(50)]
    folder = scratch_dir(spark, "leaks")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, corpus_pipeline.drop_benchmark_leaks(spark, docs, folder).collect())) == clean


def test_windows_of_very_long_items_are_looked_through_in_bounded_steps(monkeypatch):
    seen, clip = [], decontaminate.np.clip
    monkeypatch.setattr(decontaminate.np, "clip", lambda x, *a: (seen.append(x.size), clip(x, *a))[1])
    own = decontaminate.np.arange(1, 20_001).astype("uint64") * decontaminate.np.uint64(0x9E3779B97F4A7C15)
    items = decontaminate.embed([1], [own], 8, 5, 20, 4)
    text = decontaminate.np.concatenate([own[:10], own])
    assert [1 if p == 10 else 0 for p in decontaminate.segmented(text, items)[:, 1].tolist()].count(1) == 1
    assert max(seen) <= 1 << 20
