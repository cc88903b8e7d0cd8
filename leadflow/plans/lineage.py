"""Cutting lineage with tables in a folder that all machines share, and joins whose hot keys are dealt out."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: A key with more than one in SHARES of all rows is hot, so there are fewer than SHARES hot keys.
SHARES = 400


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints", "leadflow")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/leadflow-{spark.sparkContext.applicationId}"


#: Lists that note the tables being cut, the innermost last.
_noting: list[list[str]] = []


#: Shuffle files go when the query that wrote them has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: ends the lineage and survives lost executors.

    Nothing else can read what the write has shuffled, so those files are removed with it.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}.parquet"
    for made in _noting:
        made.append(path)
    with _shuffles_end_with_query(spark):
        df.select("*").write.parquet(path)  # a plan of its own, so no other action on df looks for those files
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete all that `cut` wrote in this application; results that still read it must have been written before."""
    _delete(spark, _folder(spark))


@contextmanager
def noted() -> Iterator[list[str]]:
    """The tables that are cut inside, as a list for `drop_tables`."""
    made: list[str] = []
    _noting.append(made)
    try:
        yield made
    finally:
        _noting.pop()


def drop_tables(made: list[str], keep: DataFrame) -> None:
    """Delete noted tables that keep does not read, and take them off the list."""
    if made:
        read = keep.inputFiles()
        for path in [p for p in made if not any(os.path.basename(p) in f for f in read)]:
            _delete(keep.sparkSession, path)
            made.remove(path)


#: Items that a sketch of frequent keys tracks: it misses no key that holds over 1 / SHARES of the rows.
TRACKED = 10_000


def hot_keys(left: DataFrame, on: str | list[str]) -> DataFrame:
    """The keys that hold more than one in SHARES of left's rows, SHARES of them at most, and how many parts each needs.

    A single key is counted by a frequent-items sketch of bounded size in each task: one pass, nothing shuffled but the
    sketches, and only hot keys reach the driver. Its counts may be off by a thousandth of the rows, which moves the
    border of what is hot, never a result. Keys of several columns are counted exactly.
    """
    on = [on] if isinstance(on, str) else on
    if len(on) == 1 and isinstance(left.schema[on[0]].dataType, (LongType, IntegerType, StringType)):
        found = left.agg(F.expr(f"approx_top_k(`{on[0]}`, {SHARES}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
        hot = [(x["item"], -(-x["count"] * SHARES // found["n"])) for x in found["top"] or [] if x["count"] > max(found["n"], 1000) / SHARES]
        return left.sparkSession.createDataFrame(hot, StructType([left.schema[on[0]], StructField("_parts", IntegerType())]))
    seen = Observation()
    counts = cut(left.groupBy(*on).agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("total")))
    total = seen.get["total"] or 0
    return counts.where(F.col("_n") > max(total, 1000) / SHARES).select(*on, F.ceil(F.col("_n") * SHARES / F.lit(max(total, 1))).cast("int").alias("_parts"))


def skew_join(left: DataFrame, right: DataFrame, on: str | list[str], by: str | Column, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has few rows a key, when some keys may hold a large share of left.

    Hot keys are dealt over as many parts as they need, by the hash of `by`, and their rows of right are repeated once a
    part: fewer than 2 * SHARES copies. The list of hot keys is bounded, so it may be broadcast. how: inner or left.
    hot: hot_keys of left or of what left was filtered from, where they are at hand.
    """
    on = [on] if isinstance(on, str) else on
    hot = F.broadcast(hot_keys(left, on) if hot is None else hot)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")
    dealt = left.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")
