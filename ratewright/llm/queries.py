"""The queries of this package's operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, lines, negatives, neardup, packing, ppm, quality, sharding, substrings, token_files, topk, warc
from .common import read


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "least_sequences")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "span_report.n_sentences", "span_report.n_removed", "span_report.removed_words")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "line_report.n_lines", "line_report.n_boilerplate", "line_report.n_removed")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_conversation_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.structure(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_conversation_structure": op13_conversation_structure,
}

#: SHA-1 in base 32: five hex digits are four characters.
_BASE32 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(k // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

_LINES = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
f AS (SELECT *, trim(regexp_replace(lower(line), '[\x09-\x0D ]+', ' ', 'g'), ' ') AS form FROM l),
b AS (SELECT form FROM f WHERE form <> '' GROUP BY form HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10),
j AS (SELECT f.*, b.form IS NOT NULL AS bad FROM f LEFT JOIN b ON f.form = b.form),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad,
  coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT bad), '') AS rest FROM j GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN d.n_bad > 0 THEN d.rest ELSE t.text END AS text, CAST(coalesce(d.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(d.n_bad, 0) AS BIGINT) AS n_boilerplate, CAST(coalesce(d.n_bad, 0) AS BIGINT) AS n_removed
FROM documents t LEFT JOIN d USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WINNOWED = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN n ON len(w) >= n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM dw JOIN iw ON iw.gram = dw.gram AND iw.n = dw.n),
p AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM h) JOIN (SELECT unnest(range(13)) AS j) ON j < n GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

_QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, array_to_string(list_transform(lw, lambda x: translate(x, '{_UPPER}', '{_LOWER}')), ' ') AS form
  FROM (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(lw) > 0),
m AS (SELECT source, least(greatest(10, 0.1 * count(*)), 1000) AS most FROM d GROUP BY source),
f AS (SELECT c.source, c.form FROM (SELECT source, form, count(DISTINCT doc_id) AS n FROM l GROUP BY source, form) c JOIN m ON m.source IS NOT DISTINCT FROM c.source WHERE n > most),
r AS (SELECT l.doc_id, count(*) AS removed_lines, sum(len(lw)) AS removed_words FROM l JOIN f ON f.form = l.form AND f.source IS NOT DISTINCT FROM l.source GROUP BY l.doc_id),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2))),
v AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_lines, 0) AS removed_lines, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN r USING (doc_id)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND removed_words <= 0.5 * n_words AS kept FROM y
"""

#: Vectors of whole numbers; NaN and the infinities aren't finite.
_WHOLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
"""
_SCORE = "CAST(list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * c.v[i])) AS BIGINT)"

_NEGATIVES = rf"""{_WHOLE}
k AS (SELECT * FROM e WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, {_SCORE} AS score FROM k a JOIN k c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

_TOP_K = rf"""{_WHOLE}
s AS (SELECT a.vec_id AS query_id, c.vec_id, {_SCORE} AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": _WINNOWED, "op6_quality_rules": _QUALITY, "op7_line_dedup": _LINES, "op10_warc": _BASE32, "op11_hard_negatives": _NEGATIVES, "op12_exact_top_k": _TOP_K}
