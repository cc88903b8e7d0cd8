"""Toxicity and quality: held-out accuracy on the small tables, edge cases, and that held-out labels are never read."""

import os

import pytest
from pyspark.sql import functions as F

from leadflow.llm import quality_mil, toxicity
from leadflow.llm.common import may_contain, membership

SMALL = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def _held(scored, labels, column):
    return scored.join(labels, "doc_id").where("held_out").select("predicted", F.col(column).alias("y")).toPandas()


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    scored = toxicity.toxicity(docs, labels)
    got = _held(scored, labels, "toxic")
    hit = ((got.predicted == 1) & (got.y == 1)).sum()
    assert (got.predicted == got.y).mean() > 0.95 and hit / (got.y == 1).sum() > 0.8
    assert scored.count() == docs.count()


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    got = _held(quality_mil.quality_mil(docs, labels), labels, "quality")
    assert (got.predicted == got.y).mean() > 0.97


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    small = docs.where("doc_id < 1500")
    a, b = (toxicity.toxicity(small, x).orderBy("doc_id").toPandas()["score"].tolist() for x in (labels, flipped))
    assert a == b
    a, b = (quality_mil.quality_mil(small, x).orderBy("doc_id").toPandas()["score"].tolist() for x in (labels, flipped))
    assert a == b


def test_edge_cases(spark):
    rows = [(1, "fine text here", "s"), (1, "fine text here", "s"), (None, "x", None), (2, None, "s"), (3, "", "s"), (4, "w " * 100_000, "s")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "0.5 as score", "1 as predicted")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for got in (toxicity.toxicity(docs, labels).toPandas(), quality_mil.quality_mil(docs, labels).toPandas()):
        assert len(got) == 6 and got["score"].between(0, 1).all() and got["predicted"].isin([0, 1]).all()
    none = labels.limit(0)
    assert (toxicity.toxicity(docs, none).toPandas()["predicted"] == 0).all()
    assert quality_mil.quality_mil(docs, none).toPandas()["score"].eq(0.5).all()
    assert toxicity.toxicity(docs.limit(0), labels).collect() == [] and quality_mil.quality_mil(docs.limit(0), labels).collect() == []
    assert toxicity.drop_toxic(docs, none).columns == docs.columns and toxicity.drop_toxic(docs, none).count() == 6


def test_membership_never_misses(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    got = may_contain(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id", membership(ids, "doc_id")).where("_maybe").toPandas()["doc_id"]
    assert set(range(0, 5000, 7)) <= set(got) and len(got) < 800
