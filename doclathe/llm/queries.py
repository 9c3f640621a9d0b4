"""Queries over the driver's tables: each operator on the whole of its table, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, html_main, mixing, ngram_join, quality, secrets, suffix_dedup, urls
from .common import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).drop("text_hash", "source")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_copied")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % ann.EVERY == 0))


def queries() -> dict:
    ops = (op1_ngram_jaccard, op2_bpe, op3_mixing, op4_html, op5_quality, op6_suffix_dedup, op7_classifier, op8_urls, op9_secrets, op10_neighbours)
    return {f.__name__: f for f in ops}


#: Words of op1 and op5.
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

_OP5 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1),
q AS (SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n, count(*) AS lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY r),
b AS MATERIALIZED (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(l.lines, 0) AS n_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN q ON d.r = q.r LEFT JOIN l ON d.r = l.r
), j AS MATERIALIZED (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed,
  10 * n_symbols > n_words AS f1, 2 * n_dup_lines > n_lines AS f2, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f3 FROM b),
u AS (SELECT r, source, unnest([0, 1, 2, 3]) AS rule, unnest([base_failed, f1, f2, f3]) AS bad FROM j),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS bad FROM u GROUP BY ALL),
f AS (SELECT rule, m, CASE WHEN coalesce(v, 0) <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m * (1 - m) / v - 1)) END AS s
  FROM (SELECT rule, avg(bad / n) AS m, var_pop(bad / n) AS v FROM h GROUP BY rule)),
t AS (SELECT source, rule, (h.bad + f.m * f.s) / (h.n + f.s) AS rate, f.m FROM h JOIN f USING (rule)),
x AS (SELECT u.r, bool_or(CASE WHEN u.rule = 0 THEN u.bad OR t.rate >= {quality.HOST_LIMIT} ELSE u.bad AND t.rate >= {quality.TRUSTED} * t.m END) AS gone
  FROM u JOIN t ON u.rule = t.rule AND u.source IS NOT DISTINCT FROM t.source GROUP BY u.r)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT gone AS kept FROM j JOIN x USING (r)
"""

_OP6 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
k AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, {2 * suffix_dedup.LENGTH}) AS g FROM (SELECT *, unnest(range(0, n - {suffix_dedup.LENGTH - 1})) AS i FROM d WHERE n >= {suffix_dedup.LENGTH})),
c AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM k) WHERE m < doc_id),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM c),
s AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS z FROM e),
v AS (SELECT r, z, min(i) AS a, max(i) + {suffix_dedup.LENGTH} AS b FROM s GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS q FROM v),
o AS (SELECT w.r, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(x, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM w JOIN d ON w.r = d.r GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN o ON d.r = o.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op5_quality": _OP5, "op6_suffix_dedup": _OP6}
