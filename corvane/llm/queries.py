"""The registered queries of the training-text operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import class_lm, filter_audit, hard_negatives, mixing, neighbours, pieces, quality_classifier, quality_rules, sharding, simhash, substring, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, "rule")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_report(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_simhash,
        op4_class_lm,
        op5_quality_classifier,
        op6_sharding,
        op7_mixing,
        op8_token_files,
        op9_neighbours,
        op10_substring,
        op11_token_counts,
        op12_filter_audit,
        op13_hard_negatives,
    )
}

#: Windows of words are compared as whole sequences; the operators that are not named here have no SQL form.
SQL: dict[str, str] = {
    "op10_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS s, words FROM w WHERE len(words) >= 20),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s+19], ' ') ORDER BY doc_id, s) AS k FROM win),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM ranked WHERE k > 1),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t
  FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, concat(
      CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN d.doc_id > f THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN said ON d.doc_id = said.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT o, CAST(k AS INT) AS k, substr(o, k, 1) AS f FROM orders, generate_series(1, 5) AS s(k)),
met AS (
  SELECT part, o, fails, n, good, toxic,
    coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda c: c <> ''), lambda c: strpos(o, c))), 6) AS gone
  FROM g, orders),
rows AS (
  SELECT part, m.o AS filter_order, k AS step, f AS filter,
    sum(CASE WHEN gone > k THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = k THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < k AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = k THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = k THEN toxic ELSE 0 END) AS toxic_lost
  FROM met m JOIN steps s ON m.o = s.o GROUP BY part, m.o, k, f)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM rows
""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3
""",
}
