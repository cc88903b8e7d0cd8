"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014). Survey: C2, C6."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadflow.plans.lineage import cut, skew_join


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """(src, dst) edges from each key's smallest node to its others: as many as members, never a clique."""
    pairs = members.select(key, node).where(F.col(key).isNotNull() & F.col(node).isNotNull()).distinct()
    centre = pairs.groupBy(key).agg(F.min(node).alias("src"))
    return pairs.join(centre, key).where(F.col("src") < F.col(node)).select("src", F.col(node).alias("dst")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (a, b) as a written table, with their number and a digest taken while writing."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return out, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another one; component is the smallest node reachable.

    Self loops, repeated edges, either direction and edges with a null end are allowed; the latter are ignored. The
    centre of a giant star is dealt over many tasks.
    """
    a, b = F.least(F.col(src), F.col(dst)), F.greatest(F.col(src), F.col(dst))
    now, state = _written(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(a.alias("a"), b.alias("b")).where("a < b").distinct())
    before = None
    while state != before and state[0]:
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(both, low, "u", "v").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = skew_join(large, lowest, "b", "a").where("a <> m").select("m", F.col("a").alias("b"))
        now, state = _written(moved.union(lowest.select("m", "b")).distinct().toDF("a", "b"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
