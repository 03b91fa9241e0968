"""The queries opN_<name> that apply the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, language_id, mixing, near_dedup, nearest, quality, sharding, token_counts, toxicity, warc
from tidewright.llm._spark import table

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a
), least_seen AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
       coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least_seen l ON l.node = s.doc_id
"""


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shares=mixing.SHARES)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", limit=2048)


#: Exact; the query scans all cells and measures all candidates of tables of a few thousand vectors.
NEAREST_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, c.e), c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


WARC_SQL = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, n, list_aggregate(flatten(list_transform(range(8), lambda k: list_transform([32768, 1024, 32, 1],
    lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) // d) % 32 + 1 AS INTEGER), 1)))), 'string_agg', '') AS digest
  FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS original FROM coded
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_resolve(table(spark, sf_dir, "pages"), least_bytes=0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.learn(docs, labels, folds=5, held=0), folds=5, held=0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs, folds=3, held=1), folds=3, held=1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.learn(docs, labels, folds=3, held=1), folds=3, held=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
}
SQL = {"op1_near_dedup": NEAR_DEDUP_SQL, "op7_nearest": NEAREST_SQL, "op8_warc": WARC_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
