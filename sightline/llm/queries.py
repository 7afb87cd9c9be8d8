"""Queries over the corpus operators, and SQL stating the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import alignment, collocations, decontaminate, jaccard_join, language, line_dedup, matroska, paragraphs, sharding, simhash, token_files, url_filter, word_bpe
from sightline.llm.common import table
from sightline.registry.base import query
from sightline.session import scratch_dir

OP4_COLUMNS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u),
rules(h, pre, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, h || pre AS rule, says,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS rn
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON p.page_id = f.page_id
"""


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_url_filter", _OP2_SQL)
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict; a url that no rule fits is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(table(spark, folder, "pages", "page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_consistent_ring_shards")
def op6_consistent_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharding.assign(docs, "doc_id", shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )



@query("op4_matroska_media")
def op4_matroska_media(spark: SparkSession, folder: str) -> DataFrame:
    """Texts stored as Matroska files in a media table, read back as packets."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    stored = f"{scratch_dir(spark, 'media')}/files"
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    matroska.with_media(sized).select("doc_id", "n_bytes", "media").write.option("compression", "zstd").parquet(stored)
    back = spark.read.parquet(stored).select(F.struct("doc_id", "n_bytes").alias("doc"), "media")
    return matroska.features(back, "doc").select("doc.doc_id", "doc.n_bytes", *OP4_COLUMNS)


@query("op3_orc_token_files")
def op3_orc_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's ids from the ORC files they were written to."""
    files = f"{scratch_dir(spark, 'tokens')}/files"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, folder, "documents", "doc_id", "text")
    token_files.write(docs, files, tokenizer("byte_bpe_50k.json"), end=2, parts=parts)
    return token_files.index(spark, files)


@query("op8_simhash_near_duplicates")
def op8_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and class of near duplicates."""
    found = simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op1_line_dedup", _OP1_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    cut = line_dedup.dedup_lines(table(spark, folder, "documents", "doc_id", "text"), least=10, shortest=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_word_bpe_round_trip")
def op9_word_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded through a lexicon of the corpus's frequent words, and decoded again."""
    docs, path = table(spark, folder, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json")
    return word_bpe.round_trip(docs, path, word_bpe.lexicon_of(docs, path))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's language; learned from the labelled documents outside the held-out fold."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_paragraph_dedup")
def op10_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage that repeats across documents."""
    return paragraphs.passages(table(spark, folder, "documents", "doc_id", "text"))


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and its edits."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, folder, "benchmark", "item_id", "text"))


_OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (
  SELECT lang, unnest(ws) AS phrase, 1 AS size FROM w
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM w WHERE len(ws) >= 2
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM w WHERE len(ws) >= 3),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, size, a, 1 AS k, ws[1] AS lp, array_to_string(ws[2:], ' ') AS rp FROM c
  UNION ALL
  SELECT lang, phrase, size, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE size = 3),
s AS (
  SELECT cuts.*, fl.f AS l, fr.f AS r, (1000000::HUGEINT * a * a) // (fl.f * fr.f) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM s),
wide AS (
  SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE size = 3),
best AS (SELECT lang, phrase, max(a) AS longer FROM wide GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN best ON best.lang = low.lang AND best.phrase = low.phrase AND low.size = 2
  WHERE pick = 1 AND 100 * coalesce(longer, 0) < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _OP11_SQL)
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Every language's best phrases of two and three words."""
    docs = table(spark, folder, "documents", "text", "lang")
    return collocations.collocations(docs, least=10, widest=50, most=2000)


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's tokens by two tokenizers, grouped where both end, with how common its links are."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


_OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * held >= 90 * (x.n + y.n - held)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY ALL
"""


@query("op12_ngram_jaccard_join", _OP12_SQL)
def op12_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of texts linked by a similarity of 90 percent or more, over three-word shingles."""
    return jaccard_join.components_of(table(spark, folder, "documents", "doc_id", "text"), size=3, percent=90)
