"""Mixing sources to target weights: Pfair scheduling of blocks.

Each source's documents form blocks. Block k of a source with weight w is released at floor(k / w) and due at
ceil((k + 1) / w); at every slot, the released block with the earliest deadline is placed, so a source's placed
blocks never differ from w times the slots by one block or more.

Weights are whole parts of `whole`, kept exactly: a source with p of the q parts that are left in a phase has the weight
p / q, and the schedule repeats every q slots (less their common divisor). The driver schedules one such period, a
table bounded by the parameters, and every block's slot follows from its number by arithmetic on the executors. When a
source runs out, the rest continue with the same proportions in a new phase; there are at most as many phases as
sources, and every document is placed exactly once.

Numbers within a source come from counts of fixed-size hash ranges, not from one sort of the source, so a source that
holds a third of all rows is spread over as many tasks as its rows need. Only ids and sources are numbered; `mix` orders
whole rows by what it finds.

Defined cases: sources without a weight, and null sources, share the class REST with the parts that are left (without
any, REST follows all others); a weight without documents is given to the others; rows with a null id come first in
their range; repeated rows are placed each; the order of equal rows is open; very long texts are rows like others.
Extra columns, whatever their names, are kept by `mix` and ignored by `schedule`.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import cut, unused

REST = "(rest)"


def _default_weights() -> dict[str, int]:
    return {"src0": 200} | {f"src{i}": 40 for i in range(1, 20)}


@dataclass(frozen=True)
class MixParams:
    """weights: parts of `whole` by source; block_rows: documents a block; range_rows: aim for rows in a hash range."""

    weights: dict[str, int] = field(default_factory=_default_weights)
    whole: int = 1000
    block_rows: int = 8
    range_rows: int = 2000
    seed: int = 5


def reduced(parts: dict[str, int]) -> dict[str, int]:
    """The same proportions in the smallest whole numbers; if all are 0, equal ones."""
    parts = {k: w for k, w in parts.items() if w > 0} or dict.fromkeys(parts, 1)
    common = math.gcd(*parts.values())
    return {k: w // common for k, w in parts.items()}


def pfair_period(parts: dict[str, int]) -> list[str]:
    """The source of each slot of one period, of as many slots as parts: earliest deadline first among released blocks.

    Equal deadlines: first the block whose window overlaps its successor's, then the heavier source, then by name.
    """
    slots = sum(parts.values())
    waiting, ready, out = [(0, k, 0) for k in sorted(parts)], [], []  # (release, source, block)
    heapq.heapify(waiting)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, k, n = heapq.heappop(waiting)
            w = parts[k]
            due, overlaps = -(-(n + 1) * slots // w), ((n + 1) * slots) % w > 0
            heapq.heappush(ready, (due, not overlaps, -w, k, n))
        *_, k, n = heapq.heappop(ready)  # parts sum to slots, so something is always released
        out.append(k)
        if n + 1 < parts[k]:
            heapq.heappush(waiting, ((n + 1) * slots // parts[k], k, n + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Phases as dicts: period, first (blocks of each source already placed), take (blocks of each placed in it), parts, offset (slots before it)."""
    left, done, offset, out = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        parts = reduced({k: weights[k] for k in left})
        period, slots = pfair_period(parts), sum(parts.values())
        # the phase ends with the slot in which a source places its last block
        whole = min(left[k] // w for k, w in parts.items())
        counts, cut_at = {k: whole * w for k, w in parts.items()}, whole * slots
        if not any(left[k] == n for k, n in counts.items()):
            for k in period:
                counts[k] += 1
                cut_at += 1
                if counts[k] == left[k]:
                    break
        out.append({"parts": parts, "period": period, "first": {k: done[k] for k in parts}, "take": dict(counts), "offset": offset})
        for k, n in counts.items():
            done[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
        offset += cut_at
    return out


def _class(source: Column, weights: dict[str, int]) -> Column:
    return F.when(source.isin(*weights), source).otherwise(F.lit(REST)) if weights else F.lit(REST)


def _weights(p: MixParams) -> dict[str, int]:
    return p.weights | {REST: max(0, p.whole - sum(p.weights.values()))}


def _placed(docs: DataFrame, p: MixParams, *kept: Column) -> DataFrame:
    """_class, _block, _phase, _slot and _key of each row of docs, with the columns `kept`."""
    rows = docs.select(*kept, F.col("doc_id").alias("_id"), _class(F.col("source"), p.weights).alias("_class"), F.xxhash64(F.col("doc_id"), F.lit(p.seed)).alias("_key"))
    ranges = max(1, -(-docs.select("source").count() // p.range_rows))
    # ranges of the signed 64-bit hash, ascending: rounding moves a border but never the order
    share = F.col("_key").cast("double") / F.lit(2.0**64) + 0.5
    rows = rows.withColumn("_range", F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int"))
    sizes = cut(rows.groupBy("_class", "_range").agg(F.count("*").alias("_n")))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_class").orderBy("_range")) - F.col("_n")).drop("_n")
    blocks = {r["_class"]: -(-r["n"] // p.block_rows) for r in sizes.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}  # one row a weight
    spans, table = [], []
    for i, ph in enumerate(phases(blocks, _weights(p))):
        seen: dict[str, int] = {}
        for t, k in enumerate(ph["period"]):
            table.append((i, k, seen.get(k, 0), t))
            seen[k] = seen.get(k, 0) + 1
        spans += [(k, i, ph["first"][k], ph["first"][k] + n, ph["parts"][k], len(ph["period"]), ph["offset"]) for k, n in ph["take"].items() if n]
    # at most (weights + 1) phases of `whole` slots, whatever the number of rows: both tables may be broadcast
    spark = docs.sparkSession
    slots = spark.createDataFrame(table, "_phase int, _class string, _turn long, _at long")
    reach = spark.createDataFrame(spans, "_class string, _phase int, _from long, _to long, _parts long, _slots long, _offset long")
    within = Window.partitionBy("_class", "_range").orderBy("_key", "_id")
    numbered = rows.withColumn("_i", F.row_number().over(within)).join(before, ["_class", "_range"])
    numbered = numbered.withColumn("_block", F.floor((F.col("_before") + F.col("_i") - 1) / p.block_rows).cast("long"))
    placed = numbered.join(F.broadcast(reach), "_class").where("_block >= _from and _block < _to")
    turn = F.col("_block") - F.col("_from")
    placed = placed.withColumn("_turn", turn % F.col("_parts")).withColumn("_cycle", F.floor(turn / F.col("_parts")))
    placed = placed.join(F.broadcast(slots), ["_phase", "_class", "_turn"])
    return placed.withColumn("_slot", (F.col("_offset") + F.col("_cycle") * F.col("_slots") + F.col("_at")).cast("long"))


def schedule(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source_class, block, phase and slot for each row of docs; slots order the blocks of the mixture."""
    placed = _placed(docs, p)
    return placed.select(F.col("_id").alias("doc_id"), F.col("_class").alias("source_class"), F.col("_block").alias("block"), F.col("_phase").alias("phase"), F.col("_slot").alias("slot"))


def with_slot(docs: DataFrame, p: MixParams = MixParams(), name: str = "slot") -> DataFrame:
    """docs with the slot of each row as an extra column; a slot holds one block, and every slot from 0 on is taken.

    The column is called name, lengthened while docs has such a column.
    """
    return _placed(docs, p, F.struct("*").alias("_own")).select("_own.*", F.col("_slot").alias(unused(docs, name)))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs in their own columns and in the order of the mixture: sorted by slot, over ranges of slots."""
    placed = _placed(docs, p, F.struct("*").alias("_own"))
    return placed.orderBy("_slot", "_key", "_id").select("_own.*")
