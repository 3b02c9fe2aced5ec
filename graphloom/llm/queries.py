"""The registered queries of this folder and their SQL, one per operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Target weights by source; those not named weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), MIX_WEIGHTS, epochs=1.0, seed="mix-1")


OP1_SQL = r"""
WITH asked(name, weight) AS (VALUES ('src0', 4.0::DOUBLE), ('src1', 2.0), ('src2', 2.0), ('src3', 0.5)),
sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source
), found AS (
  SELECT source, size, coalesce(weight, 1.0::DOUBLE) AS weight FROM sizes LEFT JOIN asked ON source = name
), rates AS (
  SELECT source, CASE WHEN weight <= 0 THEN 0 WHEN size = 0 THEN 1
    ELSE (SELECT sum(size) FROM found) * (weight / (SELECT sum(weight) FROM found)) / size END AS rate
  FROM found
), terms AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS c
  FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source
), drawn AS (
  SELECT d.*, len([x FOR x IN c.c IF x <= ('0x' || substr(md5('mix-1|count|' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0]) AS n
  FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
), copies AS (
  SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INTEGER AS copy_no FROM drawn
)
SELECT *, ('0x' || substr(md5('mix-1|order|' || doc_id || '|' || copy_no), 1, 13))::BIGINT AS order_key FROM copies
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neardup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)]) END AS s
  FROM w
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN lowest ON s.doc_id = lowest.a
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.html_text import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_rules import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_rules import judge_urls, rule_table

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, URL_RULES))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
    ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY u.host, u.path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def sentencepiece_model(spark: SparkSession) -> bytes:
    """The public model file of the tokenizers folder; GRAPHLOOM_PIECES names another."""
    from graphloom.llm.pieces import read_model

    return read_model(spark, os.environ.get("GRAPHLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pieces import encode

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), sentencepiece_model(spark))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secret_scan import labelled_samples, report, train

    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_samples(spark)))


#: Documents reach the store in so many arrivals; a hash of the id deals every row into one.
ARRIVALS = 3


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.scratch import Scratch
    from graphloom.llm.shards import shard_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    store, version = shard_documents([docs.filter(arrival == i) for i in range(ARRIVALS)], Scratch(spark, "shards").base)
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_model import classify

    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = r"""
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)])) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""


def byte_tokenizer(spark: SparkSession) -> str:
    """The public byte-level BPE file of the tokenizers folder; GRAPHLOOM_BYTES names another."""
    from graphloom.llm.pieces import read_model

    return read_model(spark, os.environ.get("GRAPHLOOM_BYTES", "/opt/tokenizers/byte_bpe_50k.json")).decode()


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.alignment import align

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_tokenizer(spark), sentencepiece_model(spark))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontamination import contaminated

    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), places AS (
  SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS w FROM places
), spots AS (
  SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size
), hits AS (
  SELECT s.r, s.i, w.size, w.item_id FROM (SELECT r, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM spots) s JOIN windows w USING (w, size)
), covered AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.collocations import collocations

    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), sizes AS (
  SELECT lang, ws, unnest(range(1, least(len(ws), 5) + 1)) AS m FROM w WHERE len(ws) > 0
), places AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM sizes
), known AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM places GROUP BY ALL HAVING count(*) >= 100
), several AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM known WHERE m > 1
), inner_sizes AS (
  SELECT lang, ws, m, a, unnest(range(2, m)) AS s FROM several WHERE m > 2
), inner_places AS (
  SELECT lang, ws, a, s, unnest(range(1, m - s + 2)) AS i FROM inner_sizes
), longer AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM inner_places GROUP BY ALL
), own AS (
  SELECT c.* FROM several c LEFT JOIN longer b ON c.lang = b.lang AND c.phrase = b.phrase WHERE b.most IS NULL OR 100 * b.most < 100 * c.a
), cuts AS (
  SELECT lang, phrase, a, ws, m, unnest(range(1, m)) AS k FROM own
), halves AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS tail FROM cuts
), scored AS (
  SELECT h.lang, h.phrase, h.a, h.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * h.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM halves h JOIN known x ON h.lang = x.lang AND h.head = x.phrase JOIN known y ON h.lang = y.lang AND h.tail = y.phrase JOIN totals t ON h.lang = t.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM best
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_source_mixing, op2_minhash_near_dedup, op3_url_filters, op4_sentencepiece, op5_secret_scans, op6_sharding,
        op7_quality_classifier, op8_html_extraction, op9_quality_rules, op10_nearest_neighbours, op11_tokenizer_alignment, op12_benchmark_decontamination, op13_phrase_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op3_url_filters": OP3_SQL, "op6_sharding": OP6_SQL, "op10_nearest_neighbours": OP10_SQL, "op12_benchmark_decontamination": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
