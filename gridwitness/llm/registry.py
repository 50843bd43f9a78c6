"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, decontam, langid, linededup, maxent, ngramjoin, packing, quality, urlfilter, warc
from .common import crc_mod, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod(F.col("doc_id"), 3)
    learned = langid.profiles(docs.where(part != 1).select("text", "lang"))
    held = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text")
    return langid.identify(held, learned).select("doc_id", "held_out", F.col("__li_lang").alias("lang_pred"), F.col("__li_score").alias("score"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", F.col("__ld_n_lines").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), F.col("__ld_sha256").alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * o >= 85 * (na + nb - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, hit) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.hit = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT id, min(hit) AS c FROM reach GROUP BY id) r ON r.id = s.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT p.*, min(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: list_sum(list_transform(range(5), lambda k: (instr('0123456789abcdef', h[i * 5 + k + 1]) - 1) * CAST(power(16, 4 - k) AS BIGINT)))) AS groups FROM g)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(groups, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST(v AS BIGINT) >> s) % 32 + 1]), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.measured(table(spark, sf_dir, "documents"))
    return quality.judged(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p + k) AS r FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS d, count(*) AS nl FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(d, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, nl
  FROM w LEFT JOIN dups ON dups.doc_id = w.doc_id LEFT JOIN reps ON reps.doc_id = w.doc_id),
stats AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
m AS (
  SELECT doc_id, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure,
         unnest([word_chars * 1000 // n_words, n_symbols * 100000 // n_words, greatest(n_dup_lines - 1, 0) * 100000 // nl, greatest(n_repeat_words - 40, 0) * 100000 // n_words]) AS v
  FROM stats WHERE NOT base_failed),
b AS (SELECT *, CASE WHEN v < 128 THEN v ELSE 64 * (length(bin(v)) - 7) + (v >> (length(bin(v)) - 7)) END AS bucket FROM m),
sketch AS (
  SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM b GROUP BY lang, source, measure, bucket
  UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM b GROUP BY lang, measure, bucket
  UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM b GROUP BY measure, bucket),
upto AS (
  SELECT level, lang, source, measure, CASE WHEN bucket < 128 THEN bucket ELSE (bucket - 64 * ((bucket - 64) // 64)) << ((bucket - 64) // 64) END AS edge,
         sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sketch),
q AS (
  SELECT level, lang, source, measure, max(total) AS total, min(edge) FILTER (WHERE 20 * upto >= total) AS q05, min(edge) FILTER (WHERE 2 * upto >= total) AS q50,
         min(edge) FILTER (WHERE 20 * upto >= 19 * total) AS q95 FROM upto GROUP BY level, lang, source, measure),
sides AS (SELECT *, q50 - 2 * (q50 - q05) - CASE measure WHEN 'word_length' THEN 1000 WHEN 'dup_lines' THEN 10000 ELSE 5000 END AS low, q50 + 2 * (q95 - q50) + CASE measure WHEN 'word_length' THEN 1000 WHEN 'dup_lines' THEN 10000 ELSE 5000 END AS high FROM q),
lim AS (
  SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= 100 THEN a.low WHEN l.total >= 100 THEN l.low ELSE o.low END AS low,
         CASE WHEN a.total >= 100 THEN a.high WHEN l.total >= 100 THEN l.high ELSE o.high END AS high
  FROM sides a LEFT JOIN sides l ON l.level = 1 AND l.measure = a.measure AND l.lang IS NOT DISTINCT FROM a.lang LEFT JOIN sides o ON o.level = 2 AND o.measure = a.measure WHERE a.level = 0),
bad AS (SELECT DISTINCT doc_id FROM m JOIN lim ON lim.measure = m.measure AND lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source
        WHERE v > high OR (m.measure = 'word_length' AND v < low))
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM stats s LEFT JOIN bad ON bad.doc_id = s.doc_id
"""

#: The rules of the contract, (host, path) -> verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    names = {"__uf_host": "host", "__uf_path": "path", "__uf_rule": "rule", "__uf_verdict": "verdict", "__uf_score": "score"}
    return urlfilter.judge(pages, URL_RULES).select("page_id", *(F.col(a).alias(b) for a, b in names.items()))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    convs = chat_tree.conversations(turns.unionByName(added))
    return chat_tree.read_back(chat_tree.prefix_trees(convs), convs)


#: Fixed value: what both turns of conversation -7 say.
ADDED_TEXT = r"\### Assistant: </turn> ok"

OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<turn>', '<' || chr(92) || 'turn>'), '</turn>', '<' || chr(92) || '/turn>') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn>' || role || chr(10) || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod(F.col("doc_id"), 7)
    own = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), F.coalesce(part != 2, F.lit(False)).alias("learn"), "text")
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return maxent.score(own).select("doc_id", "held_out", *(F.col(f"__lm_{n}").alias(n) for n in names))


QUERIES = {"op1_langid": op1_langid, "op2_warc": op2_warc, "op3_chat": op3_chat, "op5_quality": op5_quality, "op8_urlfilter": op8_urlfilter, "op4_decontam": op4_decontam, "op6_linededup": op6_linededup, "op7_packing": op7_packing, "op9_ngramjoin": op9_ngramjoin, "op10_maxent": op10_maxent}
ORACLES = {"op2_warc": OP2_SQL, "op3_chat": OP3_SQL, "op5_quality": OP5_SQL, "op6_linededup": OP6_SQL, "op9_ngramjoin": OP9_SQL}
