"""Corpus operators against brute force, and their edge cases."""

import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language, line_dedup, paragraphs, sharding, simhash, url_filter
from sightline.llm.common import raw_bytes
from sightline.llm.components import components
from sightline.llm.words import LETTERS, words

BLANKS = "\t\n\x0b\x0c\r "


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def classes(nodes, links):
    """Smallest node reachable from each."""
    lead = {n: n for n in nodes}

    def root(n):
        while lead[n] != n:
            n = lead[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        lead[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Components


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == classes(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def plain_lines(rows, least, shortest, keep):
    where = defaultdict(list)
    for place, (key, text, _) in enumerate(rows):
        seen = {}
        for i, line in enumerate((text or "").split("\n")):
            k = lower(line.strip(BLANKS))
            if k and len(k) >= shortest:
                seen.setdefault(k, i)
        for k, i in seen.items():
            where[k].append(((key is None, key or 0, place), i))
    repeated = {k: min(v) for k, v in where.items() if len(v) >= least}
    out = []
    for place, (key, text, _) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = []
        for i, line in enumerate(lines):
            k = lower(line.strip(BLANKS))
            if k in repeated and not (keep == "first" and repeated[k] == ((key is None, key or 0, place), i)):
                continue
            kept.append(line)
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("least,shortest", [(3, 1), (2, 4)])
def test_line_dedup(spark, keep, least, shortest):
    rnd = random.Random(least)
    pool = ["", " ", "Same Line", "same line\r", "\tÉté", "été", "x", "ab", *[f"line {i}" for i in range(30)]]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 9))), "k") for i in range(60)]
    rows += [(100, None, "k"), (101, "", "k"), (None, "same line\nonly here", "k"), (102, "word " * 30_000 + "\nx\nx", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(5)
    cut = line_dedup.dedup_lines(frame, least=least, shortest=shortest, keep=keep)
    assert cut.columns == ["doc_id", "text", "k1", "kept", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in cut.collect()), key=str)
    assert got == plain_lines(rows, least, shortest, keep)


def test_line_dedup_counts_repeated_rows_and_takes_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "a\nb", "z")] * 3 + [(2, "b\nc", "z")], "doc_id long, text string, kept string")
    got = Counter(r["kept"] for r in line_dedup.dedup_lines(frame, least=3).collect())
    assert got == {"": 3, "c": 1}
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


# URL filter


def test_url_filter(spark):
    rnd = random.Random(5)
    hosts = ["example.net", "net", "a.example.net", "b.a.example.net", "notexample.net", "example.org", "org", "x.com:80", ""]
    paths = ["", "/", "/en/", "/en/x", "/e", "/fr/1", "/en"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/e", "block"), ("Org", "/fr/", "allow"), ("net", "/e", "allow")]
    urls = [rnd.choice(["http://", "HTTPS://", "x://y://", ""]) + rnd.choice(hosts).upper() + rnd.choice(paths) + rnd.choice(["", "?q=/en/", "#/fr/"]) for _ in range(300)]
    urls += [None, "", "://", "http://", "http://net/\nen/", "HTTP://NET/"]
    frame = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [(len(h + p), v == "block", lower(h) + p, v) for h, p, v in rules if (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)]
        best = max(fits, default=(0, False, None, "allow"))
        return host, path, best[2], best[3]

    judged = url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filter.judge(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("pmod(hash(key), 7) = 0").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = url_filter.build(listed, universe)
    assert 3 <= len(cascade.levels) < 20
    wrong = universe.filter(cascade.contains(F.col("key")) != F.expr("pmod(hash(key), 7) = 0"))
    assert wrong.count() == 0
    none = url_filter.build(listed.limit(0), universe)
    assert universe.filter(none.contains(F.col("key"))).count() == 0


# Sharding


@pytest.mark.parametrize("rows,shards", [(0, 5), (3, 5), (1000, 7), (1003, 40)])
def test_ring_holds_its_law(spark, rows, shards):
    data = [(None if i % 50 == 0 else i // 2, i) for i in range(rows)]
    frame = spark.createDataFrame(data, "doc_id long, slot long").withColumnRenamed("slot", "size")
    got = sharding.assign(frame, "doc_id", shards, points=16).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((k or -1, s) for k, s in data)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == rows


def test_ring_settles_as_documents_walking_clockwise_would():
    nodes = sharding.ring(5, 8)
    rnd = random.Random(2)
    counts = {a: rnd.randint(0, 30) for a in range(len(nodes))}
    room = sharding.capacities(sum(counts.values()), 5)
    placed = Counter()
    left, waiting = list(room), [(0, a, r) for a, n in counts.items() for r in range(n)]
    while waiting:  # one document at a time, nearest first
        waiting.sort()
        steps, arc, rank = waiting.pop(0)
        shard = nodes[(arc + steps) % len(nodes)][1]
        if left[shard]:
            left[shard] -= 1
            placed[arc, shard] += 1
        else:
            waiting.append((steps + 1, arc, rank))
    own = Counter()
    for arc, _, number, shard in sharding.settle(counts, nodes, room):
        own[arc, shard] += number
    assert own == placed


def test_ring_moves_little_when_rows_are_added(spark):
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(spark.range(4000).toDF("doc_id"), "doc_id", 8).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign(spark.range(4400).toDF("doc_id"), "doc_id", 8).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


# Language identification


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    model = language.learn(docs, per_language=60)
    assert np.array_equal(model.centroids, language.learn(docs.repartition(7), per_language=60).centroids)
    named = docs.withColumns({"score": docs.lang, "key": docs.doc_id, "label": docs.lang})
    assert np.array_equal(model.centroids, language.learn(named, per_language=60).centroids)
    rows = language.identify(named, model).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r["out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97 and not any(r["rejected"] for r in rows)
    odd = [None, "", "123 %%", "\u0301", "é", "Привет, как дела сегодня", "今天天气很好我们去公园", "the " * 50_000]
    got = language.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True] * 4 + [False] * 4
    assert [r["rejected"] for r in got[:7]] == [True] * 4 + [got[4]["rejected"], True, True]
    assert all(0 <= r["score"] <= 1 for r in [*rows, *got])
    none = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.learn(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).languages == ()


def test_language_rejects_what_is_no_learned_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.learn(docs)
    rnd = random.Random(11)
    letters = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(n))
    odd = [letters(n) for n in (20, 60, 200, 500)]
    odd += [base64.b64encode(rnd.randbytes(n)).decode() for n in (150, 600, 2000)] + [rnd.randbytes(n).hex() for n in (200, 1000)]
    odd += [
        "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach, są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan.",
        "for i in range(n):\n    buf[i] = x ^ (y << 7) & 0xFF\n    if key not in idx: idx[key] = np.zeros(k, dtype=np.uint8)\nreturn {k: v for k, v in map(f, buf)}\n",
    ]
    _, _, rejected = model.predict([t.encode() for t in odd])
    assert rejected.all()
    assert language.identify(docs, model).filter("rejected").count() == 0


# Decontamination


def plain_distance(item, text):
    rows = list(range(len(item) + 1))
    best = len(item)
    for x in text:
        now = [0]
        for j, y in enumerate(item, 1):
            now.append(min(rows[j - 1] + (x != y), rows[j] + 1, now[-1] + 1))
        rows, best = now, min(best, now[-1])
    return best


def test_decontamination_recall_and_exactness(spark, small):
    rnd = random.Random(8)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    pool = [w for r in spark.read.parquet(f"{small}/documents.parquet").limit(50).collect() for w in r["text"].split()]
    docs, split = [], lambda t: [lower(w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]
    for number in range(160):
        _, text = rnd.choice(bench)
        own = text.split()
        for _ in range(rnd.choice([0, 1, 2, len(own) // 8, len(own) // 5, len(own) // 2])):
            at = rnd.randrange(len(own))
            own[at : at + rnd.randint(0, 1)] = rnd.choices(pool, k=rnd.randint(0, 1))
        docs.append((number, " ".join(rnd.choices(pool, k=rnd.randint(0, 60)) + own + rnd.choices(pool, k=rnd.randint(0, 60)))))
    docs += [(900, None), (901, ""), (902, " ".join(rnd.choices(pool, k=20_000))), (903, bench[0][1].upper()), (903, bench[0][1])]
    items = [*bench, (7000, None), (7001, "%%"), (7002, bench[0][1]), (7003, "zyx wvu tsr")]
    docs.append((904, "before zyx wvu, tsr after"))
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    truth = {}
    for key, text in docs:
        own = split(text)
        for item, passage in items:
            words_ = split(passage)
            if words_ and len(Counter(own) & Counter(words_)) and sum((Counter(own) & Counter(words_)).values()) >= 0.8 * len(words_):
                edits = plain_distance(words_, own)
                if edits <= int(0.2 * len(words_) + 1e-9):
                    truth[key, item] = min(edits, truth.get((key, item), 99))
    assert found.keys() <= truth.keys() and all(found[k] >= truth[k] for k in found)
    assert len(found) >= 0.9 * len(truth) and {k for k, e in truth.items() if e == 0} <= found.keys()
    assert (904, 7003) in found and (903, 0) in found and (903, 7002) in found
    kept = decontaminate.remove(spark.createDataFrame([(None, bench[0][1], 1), (1, "x", 2)], "doc_id long, text string, mark int"), spark.createDataFrame(items, "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "x", 2)]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), nothing).count() == 0


def test_short_items_are_found_wherever_they_are_edited(spark):
    rnd = random.Random(9)
    pool = [f"w{i}" for i in range(2000)]
    items, docs, gone = [], [], 0
    for number in range(400):
        item = rnd.choices(pool, k=rnd.choice([5, 6, 8, 10, 15, 20, 25]))
        own = list(item)
        places = rnd.sample(range(len(own)), len(own) // 5) if number % 2 else [0]
        for at in sorted(places, reverse=True):
            own[at : at + 1] = rnd.choice([[], ["edited"]])
        if number % 5 == 4:  # a whole text, shorter than the item at both ends
            own = item[1:-1] if len(item) >= 10 else item[1:]
        around = [] if number % 5 == 4 else rnd.choices(pool, k=30)
        items.append((number, " ".join(item)))
        docs.append((number, " ".join(around + own + around)))
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] == r["item_id"]} == set(range(400))


def test_walks_stay_together_after_edits():
    own = words(*raw_bytes(pa.array([" ".join(f"w{i}" for i in range(60))])), LETTERS).hashes
    block = decontaminate.embed([1], [own], 8, 5, 20, 4)
    assert len(decontaminate.candidates(np.delete(own, [3, 30]), block, 8, 5, 20)) > 0
    assert len(decontaminate.candidates(own[::-1].copy(), block, 8, 5, 20)) == 0


# SimHash


def plain_print(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 4]).encode(), 42) for i in range(max(1, len(parts) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_simhash_components(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [None, "", " \n", "A b", "a B", "a b c d", "a b c d a b c d", "é é é é é", "rep " * 40_000, *texts[:9]]
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
    prints = {k: plain_print(t) for k, t, _ in rows}
    assert {k: v[0] for k, v in got.items()} == {k: signed(p) for k, p in prints.items()}
    keys = list(prints)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = classes(keys, links)
    assert {k: v[1] for k, v in got.items()} == expected
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(expected.values())


def test_simhash_dense_family_and_plain_ball(spark):
    rnd = random.Random(3)
    values = set()
    for centre, many, most in [(rnd.getrandbits(64), 200, 3), *[(rnd.getrandbits(64), 6, 7) for _ in range(40)]]:
        for _ in range(many):
            x = centre
            for _ in range(rnd.randint(0, most)):
                x ^= 1 << rnd.randrange(64)
            values.add(signed(x))
    values = sorted(values)
    links = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    expected = classes({n for x in links for n in x}, links)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for parts in (3, 1):
        assert {r["node"]: r["label"] for r in components(simhash.links(frame, 4, parts)).collect()} == expected


def test_simhash_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "other words here"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == {(None, 5): 2, (None, None): 1, (5, 5): 2}
    assert Counter(r["doc_id"] for r in simhash.keep_one(frame).collect()) == {None: 3, 5: 1}
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


# Paragraphs


def test_bands_reach_the_target():
    assert paragraphs.bands(0.8, 0.95) == 2 and paragraphs.bands(0.8, 0.999) == 5 and paragraphs.bands(0.8, 0.95, rows=2) == 3


def test_paragraph_links_against_brute_force(spark):
    rnd = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    base = [rnd.choices(pool, k=400) for _ in range(5)]
    texts = []
    for i in range(70):  # variants: edited copies of five sources, a hundred different neighbours of one line
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(len(own))] = rnd.choice(pool)
        texts.append(" ".join(own))
    line = " ".join(rnd.choices(pool, k=9))
    texts += [" ".join(rnd.choices(pool, k=6)) + f" {line} " + " ".join(rnd.choices(pool, k=6)) for _ in range(120)]
    cut = paragraphs.Cut(*raw_bytes(pa.array(texts)))
    values, owner = cut.shingles()
    sets = {}
    for i, h in enumerate(cut.hash.view(np.int64).tolist()):
        sets[h] = frozenset(values[np.searchsorted(owner, i) : np.searchsorted(owner, i + 1)].tolist())
    keys = list(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [(r["a"], r["b"]) for r in paragraphs.paragraph_links(frame, recall=0.9999).collect()]
    true = {(min(x), max(x)) for x in links}
    assert {(min(x), max(x)) for x in got} <= true
    assert classes(keys, got) == classes(keys, links)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "FAMILY", 3)
    test_paragraph_links_against_brute_force(spark)


def test_passages(spark):
    rnd = random.Random(7)
    fresh = lambda k: [f"u{rnd.randrange(10**9)}" for _ in range(k)]
    passage, line = fresh(60), fresh(10)
    docs = {i: fresh(200) for i in range(40)}
    for i in (3, 9, 20):
        docs[i][50:50] = passage[:30] + ["\n"] + passage[30:]
    for i in range(25, 40):
        docs[i][10:10] = line  # too short to be a passage
    twice = fresh(60)
    docs[5] += twice + twice  # repeats within one document only
    rows = [(i, " ".join(t), 1) for i, t in docs.items()] + [(77, None, 1), (78, "", 1), (None, " ".join(passage), 1)]
    rows += [(80, " ".join(docs[1]), 1), (81, "same " * 30_000, 1)]
    got = paragraphs.passages(spark.createDataFrame(rows, "doc_id long, text string, p int").repartition(5)).collect()
    assert {r["doc_id"] for r in got} == {1, 3, 9, 20, 80}
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_removed"] == 0 and by[9]["n_removed"] == by[9]["n_words"] and by[20]["source_id"] == 3
    assert by[80]["source_id"] == 1 and by[80]["n_removed"] == 200 and by[1]["n_removed"] == 0
    assert all(50 <= by[i]["first_word"] and by[i]["first_word"] + by[i]["n_words"] <= 110 for i in (3, 9, 20))
    assert paragraphs.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
