"""The opN_ queries: thin callers of this package's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, corpus_sql, near_sql, packing, pii
from lectern.llm.ann import nearest_neighbours
from lectern.llm.divergence import divergence
from lectern.llm.embedding_dedup import embedding_duplicates
from lectern.llm.hard_negatives import hard_negatives
from lectern.llm.html_extract import extract
from lectern.llm.mixing import mix
from lectern.llm.ngram_join import near_duplicates
from lectern.llm.quality import quality_scores
from lectern.llm.token_histogram import token_length_limits
from lectern.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(near_sql.NGRAM_JACCARD)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query(near_sql.EMBEDDING_LINKS)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


@query()
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(_table(spark, sf_dir, "documents"))


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


@query()
def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_length_limits(_table(spark, sf_dir, "documents"))


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


@query(corpus_sql.MIX)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


@query(corpus_sql.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", relabelled.alias("label")))


@query(corpus_sql.DIVERGENCE)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))
