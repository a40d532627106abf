"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterforge.llm import bpe, conversation_repair, divergence, exact_dedup, html_extract, langid, licenses, mixing, quality, secrets, simhash, substring_dedup, token_output
from rosterforge.llm.common import table, table_rows


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table_rows(table(spark, sf_dir, "documents")), path_col="source")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table_rows(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table_rows(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table_rows(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table_rows(table(spark, sf_dir, "documents"))).drop("copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("llr")


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table_rows(table(spark, sf_dir, "documents"))
    return token_output.read_digests(spark, token_output.write_ids(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html_extract": op2_html_extract,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_token_output": op11_token_output,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""

ORACLE_SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s
), l AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST)
), m AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - before_cap::DOUBLE) / ahead::DOUBLE AS water FROM l
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(w::DOUBLE * (arg_min(water, place) FILTER (WHERE cap::DOUBLE / w::DOUBLE > water) OVER ()), cap::DOUBLE)) AS target
  FROM m
), x AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, length(bin(d.size)) AS g,
    (('0x' || substr(md5(d.doc_id::VARCHAR || ':42'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT source, g, any_value(target) AS target, any_value(source_size) AS source_size, sum(size)::BIGINT AS held FROM x GROUP BY source, g
), z AS (
  SELECT a.source, a.g, (a.target - 2 * coalesce(sum(b.held) FILTER (WHERE b.g > a.g), 0)::DOUBLE)
    / nullif(sum(b.held * b.g) FILTER (WHERE b.g <= a.g), 0)::DOUBLE AS level
  FROM y a JOIN y b ON a.source IS NOT DISTINCT FROM b.source
  WHERE a.target < 2 * a.source_size GROUP BY a.source, a.g, a.target
), v AS (
  SELECT source, arg_max(level, g) AS level FROM z WHERE level * g < 2 GROUP BY source
), e AS (
  SELECT x.*, least(2::DOUBLE, coalesce(v.level * x.g, 2::DOUBLE)) AS rate FROM x LEFT JOIN v ON x.source IS NOT DISTINCT FROM v.source
), p AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part,
    greatest(target - (sum(floor(rate)::BIGINT * size) OVER (PARTITION BY source))::DOUBLE, 0) AS rest
  FROM e
), q AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part)) END AS odds FROM p
), k AS (
  SELECT *, odds / (1.0::DOUBLE + odds) AS rk FROM q
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, part > 0 ORDER BY rk, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before_size
  FROM k
)
SELECT doc_id, size, source_size, target,
  (whole + CASE WHEN part > 0 AND before_size + size::DOUBLE / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM c
"""

ORACLE_SQL["op10_license_scan"] = licenses.oracle_sql()

ORACLE_SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) s
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f
) WHERE part = 'pair' OR rank <= 50
"""
