"""Operator 12: clusters of vectors by k-means with Exponion search.

Every vector carries its centroid, an upper bound of its distance to it and a lower bound of its distance to all others.
After centroids have moved, bounds widen by what they moved. A vector whose upper bound stays below the lower one keeps
its centroid unseen. For the rest the upper bound is made exact; if that does not settle it, only centroids within
2 * distance + (distance from its centroid to the next one) of its centroid can be nearest or second: they are a prefix
of that centroid's sorted list of the others. The radius is inclusive and a little widened, so ties stay inside and go
to the smaller number. All distances that decide are exact whole numbers.

Each round reads and writes the table of vectors once; sums by centroid are one aggregate of `k` rows, so what reaches
the driver is k centroids, whatever the number of rows. Null, non-finite and differently long vectors take no part; a
repeated row is a vector of its own; fewer vectors than k give as many centroids; an empty table gives no rows. Rows
without an id are clustered but start no centroid while others can. Components times `scale` must fit 28 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import cut, in_arrow
from leadflow.llm.vectors import finite, matrix

#: Rounding of square roots and sums of bounds stays far below this share.
SLACK = 1e-9


@dataclass(frozen=True)
class ClusterParams:
    k: int = 16
    rounds: int = 3
    width: int = 64
    scale: int = 64
    seed: int = 1


class Centroids:
    """Centroids with the sorted lists of the others around each one, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        gap = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(2).astype(float))
        np.fill_diagonal(gap, -1.0)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gap, self.order, axis=1)
        self.next = self.gaps[:, 0] if len(at) > 1 else np.full(len(at), np.inf)
        self.moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(1).astype(float)) * (1 + SLACK)

    def squared(self, x: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return ((x - self.at[j]) ** 2).sum(1)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New centroid, upper and lower bounds of each vector, and how many distances that took."""
        own, upper, lower = own.copy(), upper + self.moved[own], lower - self.moved.max(initial=0.0)
        open_ = np.flatnonzero(~(upper < lower))
        best = self.squared(x[open_], own[open_])
        seen = len(open_)
        upper[open_] = np.sqrt(best) * (1 + SLACK)
        still = ~(upper[open_] < lower[open_])
        open_, best = open_[still], best[still]
        home, second = own[open_], np.full(len(open_), np.inf)
        radius = (2 * upper[open_] + self.next[home]) * (1 + SLACK)
        name = home.copy()
        for c in np.unique(home):
            rows = np.flatnonzero(home == c)
            inside = np.searchsorted(self.gaps[c], radius[rows], side="right")
            for p in range(int(inside.max(initial=0))):
                near = rows[inside > p]
                j, d = self.order[c, p], self.squared(x[open_[near]], self.order[c, p])
                seen += len(near)
                wins = (d < best[near]) | ((d == best[near]) & (j < name[near]))
                second[near] = np.where(wins, best[near], np.minimum(second[near], d))
                name[near], best[near] = np.where(wins, j, name[near]), np.where(wins, d, best[near])
        own[open_], upper[open_], lower[open_] = name, np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return own, upper, lower, seen


def _round(state: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """state (vec_id, v, cluster, upper, lower) with each vector at its nearest centroid; the last time with `distance`."""
    names = ["vec_id", *(["cluster", "distance"] if last else ["v", "cluster", "upper", "lower"])]
    schema = "vec_id long, cluster int, distance long" if last else "vec_id long, v array<int>, cluster int, upper double, lower double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), np.int64)
                own, upper, lower, _ = centroids.assign(x, *(b.column(i).to_numpy() for i in (2, 3, 4)))
                cluster = pa.array(own.astype(np.int32))
                new = [cluster, pa.array(centroids.squared(x, own))] if last else [b.column(1), cluster, pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays([b.column(0), *new], names)

    return in_arrow(state, run, schema)


def clusters(vectors: DataFrame, params: ClusterParams = ClusterParams()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each vector (vec_id, embedding)."""
    p = params
    spark = vectors.sparkSession
    kept = vectors.where((F.size("embedding") == p.width) & finite("embedding"))
    kept = kept.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale).cast("int")).alias("v"))
    state = cut(kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(-1.0).alias("lower")))
    name = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r.v for r in state.select("v", name.alias("_h")).orderBy(F.asc_nulls_last("_h"), "v").limit(p.k).collect()]
    at = np.array(first, dtype=np.int64).reshape(len(first), p.width)
    now = Centroids(at)
    for _ in range(p.rounds if first else 0):
        state = cut(_round(state, now, last=False))
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("v")[i].cast("long")) for i in range(p.width))).alias("s"))
        at = at.copy()
        for r in sums.collect():
            at[r.cluster] = [x // r.n for x in r.s]
        now = Centroids(at, now.at)
    out = cut(_round(state, now, last=True))
    each = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(at.tolist())]
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(each, "cluster").crossJoin(F.broadcast(total))
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
