"""Named queries of the training-data operators, over whole tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm.bpe import encode_digests
from flowgrid.llm.common import read_table
from flowgrid.llm.html_extract import extract_text
from flowgrid.llm.importance import importance_resample
from flowgrid.llm.kneser_ney import quality_classifier
from flowgrid.llm.language_id import language_id
from flowgrid.llm.lexical import ranked_search
from flowgrid.llm.line_dedup import line_dedup
from flowgrid.llm.near_dedup import near_duplicates
from flowgrid.llm.packing import pack_documents
from flowgrid.llm.quality_rules import STOP_WORDS, quality_rules
from flowgrid.llm.secrets import secret_scan
from flowgrid.llm.substring_dedup import repeated_passages
from flowgrid.llm.topk import exact_top_k, integer_vectors

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return quality_classifier(read_table(spark, sf_dir, "documents"), trusted)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_STOPS = ", ".join(f"'{w}'" for w in sorted({x for words in STOP_WORDS.values() for w in words.split() for x in (w, w.capitalize())}))
_LANGS = ", ".join(f"'{x}'" for x in STOP_WORDS)

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), often AS (
  SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN often USING (doc_id, g)) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS stops,
         len(list_filter(lines, lambda x: substr(trim(x, ' '), 1, 2) IN ('- ', '* ', '• ', '‣ ', '· '))) AS bullets,
         len(list_filter(lines, lambda x: rtrim(x, ' ').ends_with('...') OR rtrim(x, ' ').ends_with('…'))) AS dots
  FROM w LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         array_to_string(list_filter([
           CASE WHEN NOT (n_words >= 50 AND n_words <= 100000) THEN 'length' END,
           CASE WHEN NOT (word_chars / CAST(nullif(n_words, 0) AS DOUBLE) BETWEEN 2.5 AND 15.0) THEN 'mean_word_length' END,
           CASE WHEN NOT (n_symbols / CAST(nullif(n_words, 0) AS DOUBLE) <= 0.1) THEN 'symbols' END,
           CASE WHEN NOT (letters / CAST(nullif(word_chars, 0) AS DOUBLE) >= 0.7) THEN 'letters' END,
           CASE WHEN NOT (stops / CAST(nullif(n_words, 0) AS DOUBLE) >= 0.1) AND lang IN ({_LANGS}) THEN 'stop_words' END,
           CASE WHEN NOT (n_dup_lines / CAST(nullif(n_lines, 0) AS DOUBLE) <= 0.5) THEN 'repeated_lines' END,
           CASE WHEN NOT (bullets / CAST(nullif(n_lines, 0) AS DOUBLE) <= 0.9) THEN 'bullet_lines' END,
           CASE WHEN NOT (dots / CAST(nullif(n_lines, 0) AS DOUBLE) <= 0.3) THEN 'ellipsis_lines' END
         ], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM r
"""

# White space is spelt out, since regular expressions of the two engines differ in \\s.
OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents
), keyed AS (
  SELECT doc_id, line_text, line_no, translate(trim(line_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.*, coalesce(first_doc < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line_text, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), norms AS (
  SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM lengths, total
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP13_SQL = f"""
WITH table_of AS (
  -- The CRC of each byte by its polynomial, then of each n-gram byte by byte.
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crcs FROM (SELECT unnest(range(256)) AS b)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts
), words AS (
  SELECT side, id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split
), runs AS (
  SELECT side, id, w AS one, w || ' ' || lead(w) OVER o AS two, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS three FROM words WINDOW o AS (PARTITION BY side, id ORDER BY i)
), grams AS (
  SELECT side, id, gram, count(*) AS n FROM (SELECT side, id, unnest([one, two, three]) AS gram FROM runs) WHERE gram IS NOT NULL GROUP BY side, id, gram
), codes AS (
  SELECT gram, list_transform(range(1, 2 * octet_length(encode(gram)), 2), lambda k: CAST(('0x' || substr(hex(encode(gram)), k, 2)) AS BIGINT)) AS bytes FROM (SELECT DISTINCT gram FROM grams)
), hashed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM codes, table_of
), features AS (
  SELECT side, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM grams JOIN hashed USING (gram) GROUP BY side, id, bucket
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM features GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals, (SELECT sum(s) AS ss, sum(t) AS tt FROM totals)
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (id) WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_html_text": op2_html_text,
        "op3_quality_rules": op3_quality_rules,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_secrets": op5_secrets,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_top_k": op8_top_k,
        "op9_near_dedup": op9_near_dedup,
        "op10_bpe": op10_bpe,
        "op11_language_id": op11_language_id,
        "op12_treap_search": op12_treap_search,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": OP3_SQL,
        "op6_line_dedup": OP6_SQL,
        "op8_top_k": OP8_SQL,
        "op12_treap_search": OP12_SQL,
        "op13_importance": OP13_SQL,
    }
