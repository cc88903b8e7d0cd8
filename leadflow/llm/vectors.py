"""Vectors as rows: which ones take part, copies as one row with their ids, and queries streamed past blocks of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import in_arrow


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))


def padded(vector: str, width: int) -> Column:
    """The vector with zeros behind it up to `width` components: components that one of two vectors lacks count as zero."""
    return F.concat(F.col(vector), F.slice(F.array_repeat(F.lit(0), width), F.lit(1), F.greatest(F.lit(0), F.lit(width) - F.size(vector)))).alias(vector)


def copies(df: DataFrame, by: Sequence[str], most: int, parts: int = 8) -> DataFrame:
    """One row for each different value of `by`, with `ids`: its `most` smallest vec_id, ascending.

    Lists of the first few rows need no more ids of one vector than that. Every task keeps `most` ids of a value before
    the shuffle, and a value that holds a third of all rows is dealt over `parts` tasks first.
    """
    df = df.select(*by, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("_part"))
    for keys in ([*by, "_part"], list(by)):
        df = df.withColumn("_n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("_n") <= most).drop("_n")
    return df.groupBy(*by).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def block_count(rows: int, parallel: int, least: int, most: int) -> int:
    """Blocks of `least` to `most` rows: as many as there are cores while blocks stay that large."""
    return max(1, min(-(-rows // least), max(parallel, -(-rows // most))))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def id_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of ids as (all ids, where each list starts and the last one ends)."""
    ids = column.flatten().to_numpy(zero_copy_only=False)
    return ids, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


class Block(Protocol):
    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch: ...


def by_block(df: DataFrame, blocks: int, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """run(all rows of a block) for each block (column `block`, 0 to blocks - 1), each in a task of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if sum(b.num_rows for b in rows):
            yield from run(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])

    return df.repartitionById(blocks, F.col("block")).mapInArrow(each, schema)


def past_blocks(index: DataFrame, queries: DataFrame, blocks: int, build: Callable[[pa.RecordBatch], Block], schema: T.StructType | str, at_once: int = 64) -> DataFrame:
    """Every query against every block of an index, one task a block.

    index and queries have the same columns, the index `block` besides. A task takes its block first, whole (blocks are
    bounded), and then the queries in slices of `at_once`, so it never holds all queries. A query set goes once to each
    block; rows of the index move once.
    """
    width = queries.columns
    own = index.select("block", F.lit(False).alias("_query"), *width)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("_query"), *width)
    both = own.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        block: Block | None = None
        for b in batches:
            first = int(np.argmax(q)) if (q := b.column(1).to_numpy(zero_copy_only=False)).any() else b.num_rows
            if first:
                rows.append(b.slice(0, first))
            if first < b.num_rows and rows:
                block = block or build(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
                for i in range(first, b.num_rows, at_once):
                    yield block.search(b.slice(i, min(at_once, b.num_rows - i)))

    return in_arrow(both, run, schema)
