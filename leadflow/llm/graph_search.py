"""Operator 13: approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Different vectors, each with the smallest ids that carry it, are dealt over shards of bounded size. In a shard every
vector gets one more component that brings it to the length of the shard's longest, so the largest inner product is the
smallest distance. The graph grows in batches: a greedy beam search from a fixed start proposes neighbours of each new
vector among those already there, robust pruning keeps the nearest and drops each later one that a kept one is closer to
by the factor `alpha`, edges are also laid back, and lists that overflow are pruned again. Batches at most double the
graph. Graphs are written once, as neighbour lists beside the vectors.

A query walks every shard with a beam of `beam` vectors; what the beam ends with is scored again in double precision on
the original vectors, and the best `k` of each shard meet by query. Copies of one vector are one node, so they neither
break a graph nor crowd a beam, and all of the ids that can be in a list are reported.

Rows without an id, null, zero, empty or non-finite vectors take no part. Shorter vectors count as if zeros followed.
Repeated rows count once; an id with several vectors is searched with each, and the best score of a pair counts. Empty
tables, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import cut
from leadflow.llm.vectors import block_count, by_block, copies, finite, id_lists, matrix, padded, past_blocks


@dataclass(frozen=True)
class GraphParams:
    k: int = 20
    #: Neighbours that pruning leaves a vector, and that it may have before it is pruned again.
    degree: int = 32
    room: int = 64
    #: Vectors of a beam (while building, while searching) and the factor of robust pruning.
    build_beam: int = 32
    beam: int = 96
    alpha: float = 1.2
    shard_rows: int = 8192
    queries_every: int = 20
    #: Vectors a beam opens at once, and vectors that are added at once at most.
    width: int = 4
    batch: int = 512


def extended(x: np.ndarray) -> np.ndarray:
    """Vectors as 32-bit floats, scaled by the longest one's length, with a component that gives all of them length 1."""
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    most = size.max(initial=0.0) or 1.0
    rest = np.sqrt(np.maximum(0.0, 1.0 - (size / most) ** 2))
    return np.concatenate([x / most, rest[:, None]], axis=1).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row of q) the `beam` most similar vectors found from `start`: (places, similarities), best first.

    edges: neighbour lists, -1 where a list is shorter. Every step opens the `width` best vectors of each beam that have
    not been opened; a query ends when its whole beam is open. Empty places of a beam are -1.
    """
    n = len(q)
    ids, sim, opened = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for no neighbour
    seen[:, -1] = True
    ids[:, 0], sim[:, 0] = start, q @ x[start]
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        free = ~opened[live] & (ids[live] >= 0)
        some = free.any(1)
        live, free = live[some], free[some]
        if not len(live):
            break
        nth = np.cumsum(free, axis=1)
        pick = free & (nth <= width)
        opened[live] |= pick
        who, at = np.nonzero(pick)
        block = np.full((len(live), width, edges.shape[1]), -1, np.int32)
        block[who, nth[who, at] - 1] = edges[ids[live[who], at]]
        block = np.sort(block.reshape(len(live), -1), axis=1)
        new = ~seen[live[:, None], block]
        new[:, 1:] &= block[:, 1:] != block[:, :-1]
        who, at = np.nonzero(new)
        found = block[who, at]
        seen[live[who], found] = True
        got = np.full(block.shape, -np.inf, np.float32)
        got[who, at] = np.einsum("ij,ij->i", x[found], q[live[who]])
        all_ids, all_sim = np.concatenate([ids[live], np.where(new, block, -1)], axis=1), np.concatenate([sim[live], got], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(block.shape, bool)], axis=1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        ids[live], sim[live], opened[live] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_sim, all_open))
    return ids, sim


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, p: GraphParams) -> np.ndarray:
    """Neighbour lists of the vectors at `own` from candidates (rows of ids, -1 for none; in any order)."""
    empty = ids < 0
    sim = np.where(empty, -np.inf, np.einsum("ij,icj->ic", x[own], x[ids]))
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)
    alive = (ids >= 0) & (ids != own[:, None])
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]  # of one length and one similarity: a repeated candidate stands beside itself
    c = x[ids]
    apart = 2 - 2 * np.matmul(c, c.transpose(0, 2, 1))  # squared distances between candidates
    far = 2 - 2 * sim
    out, n = np.full((len(own), p.room), -1, np.int32), np.zeros(len(own), np.int64)
    for t in range(ids.shape[1]):
        take = np.flatnonzero(alive[:, t] & (n < p.degree))
        if not len(take):
            continue
        out[take, n[take]] = ids[take, t]
        n[take] += 1
        alive[take] &= (p.alpha * p.alpha * apart[take, t] > far[take]) | (np.arange(ids.shape[1]) <= t)
    return out


def build_graph(x: np.ndarray, p: GraphParams) -> tuple[np.ndarray, int]:
    """Neighbour lists (rows of places, -1 for none) over extended vectors, and the start of searches."""
    n = len(x)
    edges = np.full((n, p.room), -1, np.int32)
    start = int(np.argmax(x @ x.mean(0)))
    order = np.random.default_rng(13).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + min(p.batch, max(1, done))]
        near, _ = beam_search(x, edges, start, x[new], p.build_beam, p.width)
        edges[new] = robust_prune(x, new, near, p)
        done += len(new)
        source, target = np.repeat(new, p.room), edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        # edges back, the nearest first where a vector gets many at once
        rank = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))
        source, target = source[rank], target[rank]
        nth = np.arange(len(target)) - np.searchsorted(target, target)
        near = nth < p.room
        to, row = np.unique(target[near], return_inverse=True)
        back = np.full((len(to), int(nth[near].max()) + 1), -1, np.int32)
        back[row, nth[near]] = source[near]
        both = np.concatenate([edges[to], back], axis=1)
        full = (both >= 0).sum(1) > p.room
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        edges[to[~full]] = both[~full, : p.room]
        if full.any():
            edges[to[full]] = robust_prune(x, to[full], both[full][:, : 2 * p.room], p)
    return edges, start


class Shard:
    """A shard's vectors and graph in a task's memory."""

    def __init__(self, rows: pa.RecordBatch, params: GraphParams):
        rows = pa.Table.from_batches([rows]).sort_by("place").combine_chunks().to_batches()[0]
        col = lambda name: rows.column(rows.schema.get_field_index(name))
        self.p, self.exact = params, matrix(col("v"), np.float64)
        self.x, self.edges, self.start = extended(self.exact), matrix(col("edges"), np.int32), int(col("start")[0].as_py())
        self.ids, self.starts = id_lists(col("ids"))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of what the beams end with; scores on the original vectors."""
        size = np.sqrt((q**2).sum(1, keepdims=True))
        unit = np.concatenate([q / np.where(size > 0, size, 1), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        ids, _ = beam_search(self.x, self.edges, self.start, unit, max(self.p.beam, self.p.k + 1), self.p.width)
        who, at = np.nonzero(ids >= 0)
        place = ids[who, at]
        return who, place, (self.exact[place] * q[who]).sum(1)

    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        col = lambda name: queries.column(queries.schema.get_field_index(name))
        own = id_lists(col("ids"))[0]
        who, place, score = self.nearest(matrix(col("v"), np.float64))
        n = np.diff(self.starts)[place]
        flat = np.repeat(self.starts[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        who, other, score = np.repeat(who, n), self.ids[flat], np.repeat(score, n)
        keep = np.flatnonzero(other != own[who])
        keep = keep[np.lexsort((other[keep], -score[keep], who[keep]))]
        w = who[keep]
        keep = keep[np.arange(len(w)) - np.searchsorted(w, w) < self.p.k]
        return pa.RecordBatch.from_arrays([pa.array(own[who[keep]]), pa.array(other[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])


def graph_index(vectors: DataFrame, params: GraphParams = GraphParams()) -> tuple[DataFrame, int, int]:
    """The index as a written table (block, place, v, ids, edges, start), its number of shards and the vectors' length."""
    p = params
    ok = F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    different = cut(copies(rows, ["v"], p.k + 1))
    facts = different.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width, shards = max(1, facts.width or 0), block_count(facts.n, 1, 1, p.shard_rows)
    dealt = different.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("block"), padded("v", width), "ids")

    def build(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        edges, start = build_graph(extended(matrix(b.column(1), np.float64)), p)
        place, first = pa.array(np.arange(len(edges), dtype=np.int32)), pa.array(np.full(len(edges), start, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, edges.size + 1, p.room, dtype=np.int32)), pa.array(edges.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), place, b.column(1), b.column(2), lists, first], ["block", "place", "v", "ids", "edges", "start"])

    return cut(by_block(dealt, shards, build, "block int, place int, v array<double>, ids array<long>, edges array<int>, start int")), shards, width


def nearest_neighbours(vectors: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row whose vec_id is divisible by `queries_every`."""
    p = params
    index, shards, width = graph_index(vectors, p)
    ok = finite("embedding") & F.exists("embedding", lambda x: x != 0) & (F.col("vec_id") % p.queries_every == 0)
    queries = vectors.where(ok).select(F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.array(F.col("vec_id").cast("long")).alias("ids")).distinct()
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("place", "int"), ("edges", "array<int>"), ("start", "int"))]
    found = past_blocks(index, queries.select(padded("v", width), "ids", *nothing), shards, lambda b: Shard(b, p), "query_id long, vec_id long, score double", at_once=256)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
