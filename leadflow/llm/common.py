"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.plans.lineage import cut, shared_dir

__all__ = ["cut", "filter_text", "from_text", "held_out", "in_arrow", "lower_ascii", "may_contain", "membership", "pieces", "shared_dir", "table", "unique_labels", "unused"]

#: ASCII white space that separates words; everything else belongs to a word.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unique_labels(labels: DataFrame, column: str) -> DataFrame:
    """One label a document: repeated rows count once (largest label), rows without id or label are left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("_y"))


#: Slots of the membership bitmap; its broadcast side never exceeds SLOTS / 64 rows of two longs (4 MB).
SLOTS = 1 << 24


def membership(ids: DataFrame, id_col: str) -> DataFrame:
    """Bitmap of a set of ids as at most SLOTS / 64 rows (_word, _bits); a superset test, so an exact join must follow."""
    slot = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SLOTS))
    return (
        ids.select(slot.alias("_s"))
        .groupBy(F.shiftright("_s", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_bits"))
    )


def may_contain(df: DataFrame, id_col: str, bitmap: DataFrame, name: str = "_maybe") -> DataFrame:
    """df with a boolean: false means that the id certainly is not in the set. df's own columns may have any names."""
    slot = F.pmod(F.xxhash64(F.col(f"own.{id_col}").cast("long")), F.lit(SLOTS))
    out = df.select(F.struct("*").alias("own")).select("own", F.shiftright(slot, 6).alias("_word"), (slot.bitwiseAND(F.lit(63))).cast("int").alias("_shift"))
    out = out.join(F.broadcast(bitmap), "_word", "left")
    return out.select("own.*", (F.coalesce(F.expr("shiftright(_bits, _shift) & 1"), F.lit(0)) == 1).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Arrow types of what functions of texts return.
_ARROW = {
    "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
    "array<struct<s:int,e:int,kind:string,hash:string>>": pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("hash", pa.string())])),
}


#: Rows of an Arrow batch: long texts make batches of the default size (10,000 rows) hundreds of MB.
BATCH_ROWS = 1000


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_ROWS rows at most; the session keeps that setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of few rows, so that what Python makes of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def from_text(df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], dict[str, Sequence]]], fields: dict[str, str]) -> DataFrame:
    """df without its column `text`, with columns that a function of the texts returns; rows are neither added nor lost.

    make() runs once a task and gives the function; fields has the new columns' types, keys of _ARROW. Other columns
    pass as Arrow arrays, so ids keep all their bits and nulls stay null.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches):
            got = f(b.column(b.schema.get_field_index(text)).to_pylist())
            new = [pa.array(got[k], _ARROW[v], from_pandas=False) for k, v in fields.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *new], [*kept, *fields])

    return in_arrow(df, run, schema)


def filter_text(df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], Sequence[bool]]]) -> DataFrame:
    """The rows of df whose text the function keeps, with all their columns."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches):
            yield b.filter(pa.array(f(b.column(at).to_pylist()), pa.bool_()))

    return in_arrow(df, run, df.schema)
