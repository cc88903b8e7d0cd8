"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.clusters import clusters
from leadflow.llm.common import cut, lower_ascii, table
from leadflow.llm.graph_search import nearest_neighbours
from leadflow.llm.hard_negatives import hard_negatives
from leadflow.llm.mixing import schedule
from leadflow.llm.ngram_join import ngram_join
from leadflow.llm.packing import pack_counted
from leadflow.llm.pii import pii
from leadflow.llm.quality_mil import quality_mil
from leadflow.llm.quality_rules import quality_rules
from leadflow.llm.secrets import secrets
from leadflow.llm.topk import top_k
from leadflow.llm.toxicity import toxicity
from leadflow.llm.url_filter import url_filter
from leadflow.plans.lineage import drop_tables, noted


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.when(F.col("doc_id").isNull() & (F.length("text") > 0), F.xxhash64(lower_ascii(F.col("text"))))
    columns = F.col("source").cast("string").alias("source"), exact.alias("exact"), F.monotonically_increasing_id().alias("place")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    with noted() as made:
        members = cut(ngram_join(docs, carried=("source", "exact", "place")))
    drop_tables(made, keep=members)
    return pack_counted(members.select("doc_id", F.col("words").alias("n"), "source", F.coalesce("component_id", "exact").alias("cluster"), "place"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 50 = 0"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_mixing, op3_url_filter, op4_toxicity, op5_quality_rules, op6_pii, op7_top_k, op8_ngram_join, op9_quality_mil, op10_secrets, op11_hard_negatives, op12_exponion_clusters, op13_graph_search)
    return {f.__name__: f for f in own}
