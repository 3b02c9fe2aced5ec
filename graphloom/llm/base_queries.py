"""Queries of columns that SQL can express where an operator's whole result is beyond it.

Fixed patterns, counts and the held-out fifth have SQL here; what the models add is
tested against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import queries as Q


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns of op5 find."""
    return Q.op5_secret_scans(spark, sf_dir).drop("spans")


SECRETS_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), p AS (
  SELECT '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS assign
), m AS (
  SELECT r, 0 AS kind, 12 AS least, regexp_extract_all(text, assign, 0) AS found, regexp_extract_all(text, assign, 2) AS kept, string_split_regex(text, assign) AS gaps FROM t, p
  UNION ALL
  SELECT r, 1, 18, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL
  SELECT r, 2, 16, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), string_split_regex(text, '[0-9a-f]+') FROM t
), each AS (
  SELECT r, kind, least, unnest(found) AS f, unnest(kept) AS k, unnest(gaps[1:len(found)]) AS g, generate_subscripts(found, 1) AS i FROM m
), placed AS (
  SELECT r, kind, least, f, k, sum(length(g) + length(f)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM each
), spans AS (
  SELECT r, kind, (e - length(f))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE length(k) >= least
), said AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS all_spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(all_spans, '')) AS base_sha256
FROM t LEFT JOIN said USING (r)
"""


def quality_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return Q.op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


RULES_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM t
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), tri AS (
  SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1
), marked AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), m AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN marked USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""


def classifier_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents op7 never learns from, and that its predictions follow from its scores."""
    by_threshold = F.col("predicted") == (F.col("score") >= 0.3).cast("int")
    return Q.op7_quality_classifier(spark, sf_dir).select("doc_id", "held_out", by_threshold.alias("by_threshold"))


#: CRC-32, bit by bit: each character's code is mixed in, then eight shifts follow.
HELD_OUT_SQL = r"""
SELECT doc_id, coalesce(xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(doc_id::VARCHAR, '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END
  ), 4294967295) % 5 = 0, false) AS held_out, true AS by_threshold
FROM documents
"""

#: For op8 on pages that hold one article element of headings, paragraphs and inline marks alone, as all of the test tables do.
ARTICLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '') AS body FROM pages
), b AS (
  SELECT page_id, url, string_split_regex(body, '</?(?:p|h[1-6]|ul|ol|li|div)\b[^>]*>') AS parts FROM a
), c AS (
  SELECT page_id, url, [trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN parts] AS blocks FROM b
), d AS (
  SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q.queries() | {f.__name__: f for f in (secret_base_spans, quality_base_measures, classifier_held_out)}


def oracle_sql() -> dict[str, str]:
    return Q.oracle_sql() | {
        "secret_base_spans": SECRETS_SQL, "quality_base_measures": RULES_SQL, "classifier_held_out": HELD_OUT_SQL, "op8_html_extraction": ARTICLE_SQL,
    }
