"""Operators on vectors against brute force: hard negatives, Exponion clusters, graph search."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from leadflow.llm import clusters as km
from leadflow.llm import graph_search as graph
from leadflow.llm import hard_negatives as hard

ROWS = "vec_id long, embedding array<float>, label int"


def _usable(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def _vectors(n, width=16, seed=1):
    """Vectors with ties, a third of them copies of one, ids that repeat whole, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1).astype(np.float32).tolist()
    rows = [(i, x[0] if i % 3 == 1 else x[i], int(rng.integers(4))) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [1.0] * (width - 1) + [None], 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] * width, 1), (50 * n, x[1], None), (None, x[2], 1)]
    return rows + rows[:5] + odd


def _plain_negatives(rows):
    kept = sorted({(i, tuple(math.floor(256 * x) for x in v), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in _usable(rows) if i is not None and y is not None})
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, v, y in kept:
        if i % 50 == 0:
            scores = sorted((-dot(v, w), j, z) for j, w, z in kept if j != i)
            for s, j, _ in [r for r in scores if r[2] == y][:5]:
                window = [r for r in scores if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
                out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("width", [16, 64])
def test_hard_negatives_match_brute_force(spark, width):
    rows = _vectors(400, width)
    df = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "1 as block", "2 as v", "3 as ids", "4 as _part", "5 as scores")
    got = hard.hard_negatives(df, hard.NegativeParams(least_rows=60, sample=100, rows_at_once=32)).collect()
    want = _plain_negatives(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_hard_negatives_of_short_few_and_no_vectors(spark):
    rows = [(0, [1.0, 1.0], 0), (50, [1.0], 1), (51, [], 1), (52, [1.0, -0.25], 2), (53, [0.5], 2)]
    got = sorted(map(tuple, hard.hard_negatives(spark.createDataFrame(rows, ROWS)).collect()))
    assert got == _plain_negatives(rows) and got
    assert hard.hard_negatives(spark.createDataFrame([], ROWS)).collect() == []
    assert hard.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], ROWS)).collect() == []


def test_intervals_hold_the_scores_and_prune():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    p = hard.NegativeParams()
    books = hard.Codebooks(x[: p.sample], p.subspaces)
    codes, residual = books.encode(x)
    label = rng.integers(0, 10, len(x))
    arrays = [pa.array(label), pa.array(list(x)), pa.array([[i] for i in range(len(x))]), pa.array([c.tobytes() for c in codes]), pa.array(residual)]
    block = hard.Positives(pa.RecordBatch.from_arrays(arrays, ["label", "v", "ids", "code", "residual"]), books, p)
    a = x[:40]
    for i, lower, upper in block.intervals(a, 0, len(x)):
        true = a @ block.x[i : i + lower.shape[1]].T
        assert (lower <= true).all() and (true <= upper).all()
    block.bounded = 0
    block.search(pa.RecordBatch.from_arrays([pa.array([[i] for i in range(40)]), pa.array(label[:40]), pa.array(list(a))], ["ids", "label", "v"]))
    assert block.bounded < 0.2 * 40 * len(x) and block.scored < 0.2 * block.bounded  # other labels get no bounds, most of the rest no score


def _plain_clusters(rows, p):
    x = [(i, tuple(math.floor(p.scale * c) for c in v)) for i, v, _ in _usable(rows) if len(v) == p.width]
    named = sorted((i is None, hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest(), v) for i, v in x)
    at = [v for _, _, v in named[: p.k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(p.rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in x]
        if turn < p.rounds:
            for j in range(len(at)):
                if mine := [v for (_, v), (_, o) in zip(x, own, strict=True) if o == j]:
                    at[j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    inertia = {j: sum(d for d, o in own if o == j) for j in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), digest[o]) for (i, _), (d, o) in zip(x, own, strict=True)), key=str)


@pytest.mark.parametrize(("scale", "k"), [(1, 7), (64, 16)])
def test_clusters_match_plain_kmeans(spark, scale, k):
    p = km.ClusterParams(k=k, width=16, scale=scale)  # at scale 1 ties are many
    rows = _vectors(300) + [(9000, [1.0] * 15, 1), (9001, [], 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(3).selectExpr("*", "1 as v", "2 as cluster", "3 as upper")
    assert sorted(map(tuple, km.clusters(df, p).collect()), key=str) == _plain_clusters(rows, p)


def test_clusters_of_few_and_no_vectors(spark):
    p = km.ClusterParams(width=2)
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], None)], [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [5.0, 5.0], 2)]):
        assert sorted(map(tuple, km.clusters(spark.createDataFrame(rows, ROWS), p).collect()), key=str) == _plain_clusters(rows, p)


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (16, 8))
    x = (centres[rng.integers(0, 16, 20_000)] + rng.integers(-20, 20, (20_000, 8))).astype(np.int64)
    at, seen = centres.astype(np.int64) + 5, []
    state, now = (np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.full(len(x), -1.0)), km.Centroids(at)
    for _ in range(3):
        *state, n = now.assign(x, *state)
        seen.append(n)
        assert (state[0] == np.argmin(((x[:, None] - now.at[None]) ** 2).sum(2), axis=1)).all()
        new = np.stack([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else now.at[j] for j in range(16)])
        now = km.Centroids(new, now.at)
    assert max(seen[1:]) < 2 * len(x) < 16 * len(x)


def _true_neighbours(rows, k, every):
    best = {}
    usable = [(i, [np.float64(c) for c in v]) for i, v, _ in _usable(rows) if i is not None and any(v)]
    width = max(len(v) for _, v in usable)
    ids = np.array([i for i, _ in usable])
    x = np.array([v + [0.0] * (width - len(v)) for _, v in usable])
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            for j, s in zip(ids, (x * v).sum(1), strict=True):
                if j != i:
                    best[i, j] = max(s, best.get((i, j), -np.inf))
    out = {}
    for (i, j), s in best.items():
        out.setdefault(int(i), []).append((-s, int(j)))
    return {i: [(j, -s) for s, j in sorted(v)[:k]] for i, v in out.items()}


def test_graph_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))  # lengths differ: the inner product is no distance
    rows = [(i, (x[7] if i % 3 == 1 else x[i]).astype(np.float32).tolist(), 0) for i in range(3000)] + [(5000, [0.0] * 24, 0), (5020, None, 0), (None, x[0].tolist(), 0), (5040, [], 0), (5060, [1.0, float("nan")], 0)]
    df = spark.createDataFrame(rows + rows[:40], ROWS).repartition(4).selectExpr("*", "1 as v", "2 as ids", "3 as block")
    p = graph.GraphParams(shard_rows=600)
    got = {}
    for r in graph.nearest_neighbours(df, p).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = _true_neighbours(rows, p.k, p.queries_every)
    assert got.keys() == want.keys() and all(len(v) == p.k for v in got.values())
    exact = {(q, j): s for q, v in want.items() for j, s in v}
    assert all(abs(s - exact[q, j]) < 1e-9 for q, v in got.items() for j, s in v if (q, j) in exact)
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / p.k for q in want])
    assert recall >= 0.95
    hot = 1240  # a query that is one of the copies: the others with the smallest ids come first
    assert hot % 3 == 1 and [j for j, _ in got[hot]][:5] == [j for j, _ in want[hot]][:5]


def test_graph_search_of_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (20, [2.0], 0), (3, [1.0, 1.0, 1.0], 0), (3, [5.0], 0), (4, [-1.0], 0)]
    got = {}
    for r in graph.nearest_neighbours(spark.createDataFrame(rows, ROWS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == _true_neighbours(rows, 20, 20)
    assert graph.nearest_neighbours(spark.createDataFrame([], ROWS)).collect() == []
    assert graph.nearest_neighbours(spark.createDataFrame([(20, [1.0], 0)], ROWS)).collect() == []


def test_beams_open_few_vectors_of_a_shard():
    rng = np.random.default_rng(2)
    x = graph.extended(rng.normal(size=(4000, 8)))
    p = graph.GraphParams(beam=24)
    edges, start = graph.build_graph(x, p)
    assert (edges >= 0).sum(1).max() <= p.room and (edges >= 0).any(1).all()
    ids, sim = graph.beam_search(x, edges, start, x[:200], p.beam, p.width)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, true, strict=True)]) > 0.97
    assert (np.diff(sim, axis=1) <= 0).all()
