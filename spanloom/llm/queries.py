"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, mixing, nbsvm, packing, pii, sharding, simhash, syncmers, topk, toxicity
from .common import materialize, read_table

TOKENIZER, END_ID = "word_bpe_49k.json", 2
MIXTURE = {"evenness": 0.5, "most_passes": 2.0}


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.against_next(read_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pass of the mixture over ``documents``: half of what the entropy of the sources lacks to the largest, or two passes over one."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", mixing.count_tokens("text").alias("n_tokens"))
    mixed = mixing.mix(materialize(docs, "mix"), **MIXTURE)
    return mixed.select("doc_id", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), F.col("block").cast("int").alias("block"), "weight", "at")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shard(read_table(spark, sf_dir, "documents"), 24)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), 10, F.col("vec_id") % 100 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return nbsvm.scores(docs, nbsvm.fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_syncmers, op2_html, op3_mixture, op4_packing, op5_simhash, op6_toxicity, op7_sharding, op8_topk, op9_pii, op10_quality)}

ORACLE_SQL = {
    "op8_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id
          WHERE q.vec_id % 100 = 0
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
