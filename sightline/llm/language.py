"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of its byte n-grams (letters only, A-Z
in lower case, everything else one blank), hashed to a fixed number of
dimensions. Each language has several centroids, found by clustering a bounded
sample of its labelled texts; a text takes the language of the centroid with
the largest cosine, and is rejected if even that one is too far away.

How near a text can come depends on how many different n-grams it has: a short
one of the language is as far away as a long one of random letters. The floor
is therefore a curve over that number. At each point it lies in the gap between
what random letters reach and what learned texts, cut to that size, have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import plain, quoted, record, release, slices

#: Dimensions (a power of two), lengths of n-grams, texts held as dense vectors at a time.
DIMENSIONS, GRAMS, AT_ONCE = 2048, (1, 2, 3), 256
#: Labelled texts learned from per language, centroids per language, rounds of clustering.
PER_LANGUAGE, CENTROIDS, ROUNDS = 500, 4, 12
#: The floor's place in the gap between random letters and the least similar learned texts (their 1 % quantile); where
#: there is no gap, the share of that quantile.
REJECTION, NO_GAP = 0.25, 0.75
#: Bytes that learned texts and random letters are cut to; numbers of different n-grams at which the floors are known.
CUTS, SIZES = [10 << k for k in range(10)], np.array([1 << k for k in range(4, 12)])
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text; a blank stands at both ends of every text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    every = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    blank = every == 32
    head = np.zeros(len(every), bool)
    head[np.cumsum(sizes) - sizes] = True
    stays = ~blank | head | ~np.concatenate([[True], blank[:-1]])  # runs of blanks become one
    letters, owner = every[stays].astype(np.uint32), owner[stays]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    code = np.zeros(len(letters), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(letters) - n + 1] * np.uint32(257) + letters[n - 1 :]
        if n not in GRAMS:
            continue
        within = owner[n - 1 :] == owner[: len(owner) - n + 1]
        hashed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> shift
        out += np.bincount(owner[: len(within)][within] * DIMENSIONS + hashed[within], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of counts, at length one."""
    vectors = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def has_letters(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, at length one
    owners: np.ndarray  # language of each centroid
    floors: np.ndarray  # cosine below which a language rejects, at each of SIZES

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine in 0..1, whether rejected) of each text."""
        languages, scores, out = [], [], []
        for at in range(0, len(texts), AT_ONCE):
            own = texts[at : at + AT_ONCE]
            lettered = np.fromiter(map(has_letters, own), bool, len(own))
            if not len(self.languages):
                lettered[:] = False
            languages += [UNKNOWN] * len(own)
            score, rejected = np.zeros(len(own)), np.ones(len(own), bool)
            some = np.flatnonzero(lettered)
            if len(some):
                found = counts([own[i] for i in some.tolist()])
                near = weighted(found, self.idf) @ self.centroids.T
                best = near.argmax(axis=1)
                score[some] = np.clip(near[np.arange(len(some)), best], 0, 1)
                rejected[some] = score[some] < floor_at(self.floors[self.owners[best]], (found > 0).sum(axis=1))
                for i, b in zip(some.tolist(), self.owners[best].tolist()):
                    languages[at + i] = self.languages[b]
            scores.append(score)
            out.append(rejected)
        return languages, np.concatenate(scores), np.concatenate(out)


def place(sizes: np.ndarray) -> np.ndarray:
    """Of numbers of different n-grams among SIZES, as a fraction between two of them."""
    return np.clip(np.log2(np.maximum(sizes, 1)) - np.log2(SIZES[0]), 0, len(SIZES) - 1)


def floor_at(curves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's value at its size."""
    at = place(sizes)
    low = at.astype(np.int64)
    high, row = np.minimum(low + 1, len(SIZES) - 1), np.arange(len(at))
    return curves[row, low] + (at - low) * (curves[row, high] - curves[row, low])


def noise() -> list[bytes]:
    """Words of random letters, cut to all sizes; the same ones each time."""
    rng = np.random.Generator(np.random.PCG64(13))
    out = []
    for size in CUTS:
        for _ in range(40):
            raw = rng.integers(97, 123, size, dtype=np.uint8)
            raw[np.cumsum(rng.integers(4, 11, size))[: size // 5] % size] = 32
            out.append(raw.tobytes())
    return out


def curve(sizes: np.ndarray, cosines: np.ndarray, share: float) -> np.ndarray:
    """That quantile of the cosines at each of SIZES, each over the sizes nearest to it; what is not known is as at the nearest known."""
    near = np.rint(place(sizes)).astype(np.int64)
    known = [k for k in range(len(SIZES)) if (near == k).sum() >= 20] or sorted(set(near.tolist()))
    values = [float(np.quantile(cosines[near == k], share)) for k in known]
    return np.interp(np.arange(len(SIZES)), known, values)


def cluster(vectors: np.ndarray, number: int) -> np.ndarray:
    """Centroids of vectors of length one, by cosine. Starts from the vectors farthest apart; the same input gives the same."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(number, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        chosen.append(int(near.argmin()))
    centroids = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id isn't in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit the model on a bounded sample: ``per_language`` labelled texts, the ones whose ids hash lowest.

    Texts of the held-out fold, without a label, an id or letters are left
    out. Without any labelled text the model knows no language.
    """
    ids = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(key).alias("key"), F.col(lang).alias("label"), F.xxhash64(key).alias("at")
    )
    # Ranked in parts first, so that a language with most of the corpus isn't sorted in one task.
    parts = Window.partitionBy("label", F.pmod("at", F.lit(64))).orderBy("at")
    whole = Window.partitionBy("label").orderBy("at", "key")
    some = ids.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= per_language)
    some = some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= per_language)
    texts = docs.select(F.col(key).alias("key"), F.col(lang).alias("label"), F.col(text).alias("text"))
    # At most per_language rows of each language: a bounded side.
    sample = texts.join(F.broadcast(some.select("key", "label")), ["key", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column(1), pa.string()).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                own = [t for t in texts[at : at + AT_ONCE]]
                keep = [i for i, t in enumerate(own) if has_letters(t)]
                if keep:
                    found = counts([own[i] for i in keep]).astype(np.int32)
                    yield record(["label", "at", "found", "head"], [batch.column(0).take(pa.array([at + i for i in keep])),
                        batch.column(2).take(pa.array([at + i for i in keep])), [row.tobytes() for row in found],
                        [own[i][: CUTS[-1]] for i in keep]])

    rows = sample.select("label", "text", F.xxhash64("key")).mapInArrow(run, "label string, at bigint, found binary, head binary").toPandas()
    rows = rows.sort_values(["label", "at"], kind="stable")
    languages = tuple(sorted(rows["label"].unique()))
    if not languages:
        return Model((), np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, np.int64), np.zeros((0, len(SIZES))))
    found = np.stack([np.frombuffer(x, np.int32) for x in rows["found"]])
    idf = np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1
    vectors, labels = weighted(found, idf), rows["label"].to_numpy()
    centroids, owners, floors, random = [], [], [], counts(noise())
    random_size, random = (random > 0).sum(axis=1), weighted(random, idf)
    heads = rows["head"].to_numpy()
    for number, language in enumerate(languages):
        own = vectors[labels == language]
        clustered = cluster(own, CENTROIDS)
        centroids.append(clustered)
        owners += [number] * len(clustered)
        size, cosine = [(found[labels == language] > 0).sum(axis=1)], [(own @ clustered.T).max(axis=1)]
        for cut in CUTS:
            texts = [h[:cut] for h in heads[labels == language] if len(h) > cut]
            for at in range(0, len(texts), AT_ONCE):
                some = counts(texts[at : at + AT_ONCE])
                size.append((some > 0).sum(axis=1))
                cosine.append((weighted(some, idf) @ clustered.T).max(axis=1))
        least = curve(np.concatenate(size), np.concatenate(cosine), 0.01)
        most = curve(random_size, (random @ clustered.T).max(axis=1), 0.99)
        floors.append(np.where(least > most, most + REJECTION * (least - most), NO_GAP * least))
    return Model(languages, idf, np.concatenate(centroids), np.array(owners), np.stack(floors))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns called like these are replaced.

    A null text, or one without letters, is ``und`` with score 0 and
    rejected. The score is the cosine to the nearest centroid.
    """
    added = ("lang_pred", "score", "rejected")
    rest = [c for c in docs.columns if c.lower() not in added]
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest)
    place, shared = rest.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column(place), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                languages, scores, rejected = shared.value.predict(texts[a:b].to_pylist())
                yield record([*rest, *added], [*batch.slice(a, b - a).columns, languages, scores, rejected])

    return docs.select(*map(quoted, rest)).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
