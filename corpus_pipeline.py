"""Training-data pipeline over documents: toxicity, near duplicates, PII, mixing, packing.

Every stage works on all rows its predecessor kept. Toxic documents go; of each group of near duplicates the one with
the smallest doc_id stays; personal data in text is replaced by its kind (n_chars follows); the rows are put in the
order of the target mixture; the last stage packs them into bins in the order in which they were stored and returns
their pieces. So the order that mixing leaves in the files is the order of the bins, and without that stage bins follow
the order of the stage before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from leadflow.llm.common import cut, table
from leadflow.llm.mixing import mix
from leadflow.llm.ngram_join import keep_one
from leadflow.llm.packing import best_fit_packing
from leadflow.llm.pii import mask_pii
from leadflow.llm.toxicity import drop_toxic
from leadflow.plans.lineage import drop_tables, noted


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, stored=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables in the shared folder that the last stage cut and its result may still read.
_made: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """stage, after the tables of the stage before it have gone: that one's result is written by then, or docs reads them still."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(_made, keep=docs)
        with noted() as made:
            out = stage(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run_stage


STAGES = [
    ("toxicity", _tidy(toxicity_stage)),
    ("near_duplicates", _tidy(near_duplicate_stage)),
    ("pii", _tidy(pii_stage)),
    ("mixing", _tidy(mixing_stage)),
    ("packing", _tidy(packing_stage)),
]

#: Learned scores and bin packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
