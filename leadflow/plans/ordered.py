"""Work in an order, dealt over ranges of it: places in a group and folds that carry a small state from range to range."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.plans.lineage import cut


def ranged(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """rows as a written table with `_at`: larger for later rows, equal to its predecessor's plus one inside a range.

    Ranges come from a sample of the order's values, so a group that holds a third of all rows lies in many of them. One
    shuffle; no window.
    """
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


_RANGE = "cast(shiftright(_at, 33) as int)"


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """rows with their place (from 1) in their group. A group is numbered by many tasks: ranges are, then their counts add up.

    Ties of the order get places in no defined order, so give one without ties. Nulls of the group are a group.
    """
    at = ranged(rows, [*group, *order]).withColumn("_range", F.expr(_RANGE))
    parts = at.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_first") + 1).drop("_first", "_n")
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_range"]))
    return at.alias("a").join(shift.alias("b"), same).select(*(F.col(f"a.`{c}`") for c in rows.columns), (F.col("a._at") + F.col("b._shift")).alias(name))


#: A fold over ordered rows of keys: (key, columns of consecutive rows of it, state before) -> (results of the rows, state after).
Step = Callable[[object, dict[str, list], list], tuple[list, list]]


def _runs(keys: list) -> Iterator[tuple[object, int, int]]:
    """(key, start, end) of stretches of equal keys."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def carried(rows: DataFrame, key: str, order: Sequence[str], step: Step, result: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """rows in the order of (key, order) with a column that a fold with a small state gives, when one key may hold most rows.

    step folds consecutive rows of one key; its state is a short list of whole numbers, [] before a key's first row. Each
    range of rows is a task. All ranges start at once from no state; then those that lie within one key start again from
    what their predecessor ended with, for as long as that changes anything. A range is right once all before it are,
    so this ends; it ends at once where states forget their past within a range. Only (first key, last key, state) of
    each range reach the driver.
    """
    at = ranged(rows, [key, *order]).withColumn("_range", F.expr(_RANGE))
    ranges = (at.agg(F.max("_range")).first()[0] or 0) + 1
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch], start: dict[int, list], tell: Callable) -> Iterator:
        now, state, first, where = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            if where is None:
                where, now, first = cols["_range"][0], cols[key][0], cols[key][0]
                state = start.get(where, [])
            got = []
            for k, i, j in _runs(cols[key]):
                state = state if k == now else []
                new, state = step(k, {c: v[i:j] for c, v in cols.items()}, state)
                got += new
                now = k
            yield from tell(b, got)
        if where is not None:
            yield from tell(None, (where, first, now, state))

    def ends(start: dict[int, list], some: list[int] | None) -> dict[int, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tell(b, got):
                if b is None:
                    w, f, k, s = got
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([f == k]), pa.array([f], key_type), pa.array([k], key_type), pa.array([s], pa.list_(pa.int64()))], ["_range", "whole", "first", "last", "state"])

            yield from each(batches, start, tell)

        part = at if some is None else at.where(F.col("_range").isin(*some))
        part = part.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_at")
        kd = rows.schema[key].dataType.simpleString()
        return {r["_range"]: r for r in part.mapInArrow(run, f"_range int, whole boolean, first {kd}, last {kd}, state array<long>").collect()}

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(rows.schema[key].dataType)
    known = ends({}, None)
    start: dict[int, list] = {}
    while True:
        wanted, before = {}, None
        for i in sorted(known):
            r = known[i]
            if before is not None and before["last"] == r["first"] and before["state"]:
                wanted[i] = list(before["state"])
            before = r
        changed = [i for i in wanted if wanted[i] != start.get(i, [])] + [i for i in start if i not in wanted]
        again = [i for i in changed if known[i]["whole"]]  # else the last key begins in this range, whatever came before
        start = wanted
        if not again:
            break
        known |= ends(start, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(b, got):
            if b is not None:
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(got, arrow)], [*names, result])

        yield from each(batches, start, tell)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{result}` {kind}"])
    return at.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_at").mapInArrow(run, schema)
