"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, line_rules, mixing, mtree, near_dup, negatives, packing, pieces, rans, runs, sharding, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return rans.token_file_digest(_table(spark, folder, "documents"))


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


@query("op1_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = langid.remainder(5) == 0
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


@query("op4_toxicity")
def toxic_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = langid.remainder(3) == 1
    model = toxicity.fit(docs.filter(~held), _table(spark, folder, "labels").filter(~held))
    return toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


@query("op6_line_rules", line_rules.judge_sql())
def line_rules_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_rules.judge(docs).drop("text", "clean_text")


@query("op7_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query("op3_mixture")
def mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, folder, "documents"))


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
-- Base 32: groups of ten hex digits are 40 bits, each eight digits of five.
d AS (SELECT page_id, payload_bytes, h, list_reduce(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)),
  lambda a, b: a || b) AS payload_digest FROM k),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM f""")
def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(_table(spark, folder, "pages")))


@query("op5_near_duplicates")
def near_duplicate_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "class_id", "n_words")


@query("op2_top_products", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_products(_table(spark, folder, "embeddings"))


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM r WHERE place <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(_table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label")), vec % 100 == 0)


@query("op12_sentence_pieces")
def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_table(spark, folder, "documents"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return runs.digest(runs.find_runs(runs.planted(docs)))
