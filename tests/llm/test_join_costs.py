"""Searches and joins read little, and give what plain versions give."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leadflow.llm import topk
from leadflow.llm.common import cut
from leadflow.llm.ngram_join import ngram_join
from leadflow.llm.packing import best_fit_packing
from leadflow.llm.queries import op1_best_fit_packing
from leadflow.llm.shingles import shingle_sets, shingles_of, word_hashes
from leadflow.llm.topk import BATCH, SearchParams, Shard, top_k


def _shard(n, k, rng):
    """A shard of n documents with some very frequent words, and (document, word, count) of its postings."""
    words = [np.unique(np.append(rng.zipf(1.4, int(rng.integers(5, 120))) % 3000, rng.choice(12, 8, replace=False))) for _ in range(n)]
    size = np.array([len(w) for w in words])
    of, h = np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(words).astype(np.int64)
    tf = rng.integers(1, 6, len(h)).astype(np.int32)
    by = np.lexsort((of, h))
    runs, counts = np.unique(h, return_counts=True)
    return words, Shard(np.arange(n) * 3, size, runs, counts, of[by], tf[by], float(size.mean()), SearchParams(k=k)), of, h, tf, size


def test_common_words_are_met_for_many_queries_at_once_and_scores_stay_exact():
    rng = np.random.default_rng(11)
    n, k, p = 1500, 6, SearchParams()
    words, shard, of, h, tf, size = _shard(n, k, rng)
    impact = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size[of] / size.mean()))
    weight = rng.random(h.max() + 1) * 3
    asked = [(np.searchsorted(shard.words, words[q]), weight[words[q]]) for q in range(0, n, 20)]
    base, postings = shard.common(asked), 0
    assert len(asked) > BATCH
    for (t, w), row in zip(asked, base, strict=True):
        own = np.isin(h, shard.words[t])
        full = np.round(np.bincount(of[own], impact[own] * weight[h[own]], n), 6)
        postings += own.sum()
        want = np.lexsort((np.arange(n), -full))[:k]
        for got in (shard.search(t, w, row), shard.search(t, w)):
            assert got[0].tolist() == (want * 3).tolist() and np.allclose(got[1], full[want], atol=2e-6)
    assert 0 < shard.scored < 0.5 * 2 * postings  # postings read, of those of the queries' words; each query ran twice


def test_equal_documents_come_in_the_order_of_their_ids():
    n = 400
    shard = Shard(np.arange(n)[::-1].copy(), np.full(n, 3), np.array([5, 9]), np.array([n, 2]), np.append(np.arange(n), [7, 300]).astype(np.int32), np.ones(n + 2, np.int32), 3.0, SearchParams(k=5))
    ids, scores = shard.search(np.array([0, 1]), np.array([0.25, 2.0]))
    assert ids.tolist() == [n - 1 - 300, n - 1 - 7, 0, 1, 2] and scores[0] == scores[1] > scores[2] == scores[4]


def test_sets_of_a_chunk_are_those_of_each_text():
    texts = ["a b  c\td\ne f", "", None, "x", "one two three", " ", "a b c d e " * 50, "p q r s t", "é x y ü z w", *(f"w{i} " * (i % 9) + "end" for i in range(40))]
    rank = np.random.default_rng(1).permutation(1 << 10)
    for given in (None, rank):
        got = [(s[a:b], n) for s, cuts, words in shingle_sets(texts, 5, given) for a, b, n in zip(cuts[:-1], cuts[1:], words, strict=True)]
        assert len(got) == len(texts)
        for (s, n), w in zip(got, word_hashes(texts), strict=True):
            plain = shingles_of(w, 5)
            assert n == len(w) and (np.diff(s.astype(object)) > 0).all()
            high = plain >> np.uint64(54)
            assert set(s.tolist()) == set((plain if given is None else (rank[high.astype(np.int64)].astype(np.uint64) << np.uint64(54)) | (plain & np.uint64((1 << 54) - 1))).tolist())


def test_the_join_carries_columns_and_counts_words(spark, tmp_path):
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(20 + i % 40)), f"s{i % 4}") for i in range(90)] + [(None, "same text", "a"), (None, "Same text", None), (None, "", "b"), (7, None, "c")]
    pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = ngram_join(docs, carried=("source",)).toPandas()
    assert sorted(got["words"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert sorted(got["source"].fillna("-")) == sorted(s or "-" for *_, s in rows)
    # op1 packs as if words were counted and clusters joined afterwards
    key = ["doc_id", "piece", "n_words", "shard", "bin", "offset"]
    plain = best_fit_packing(docs, members=ngram_join(docs).select("doc_id", "component_id"))
    left, right = (sorted(map(tuple, x.select(*(F.coalesce(F.col(c), F.lit(-1)) for c in key)).collect())) for x in (op1_best_fit_packing(spark, str(tmp_path)), plain))
    assert left == right


def test_a_floor_leaves_out_what_cannot_reach_it_and_keeps_ties():
    rng = np.random.default_rng(5)
    words, shard, *_ = _shard(1500, 6, rng)
    weight = rng.random(3001) * 3
    for q in range(0, 1500, 75):
        t, w = np.searchsorted(shard.words, words[q]), weight[words[q]]
        ids, scores = shard.search(t, w)
        for floor in (scores[2], scores[-1], scores[0] + 1):
            got = shard.search(t, w, floor=floor)
            assert got[0].tolist() == ids[scores >= floor].tolist() and (got[1] >= floor).all()


def test_a_task_of_the_search_holds_a_shard_and_a_part_of_the_queries(spark):
    """Nothing is copied or sorted for pairs of queries and shards, shards are even, and documents without a word of a query are counted only."""
    rows = [(i, " ".join(f"w{(i * j) % 89}" for j in range(30)) if i % 3 else "" if i % 2 else f"none{i}") for i in range(1, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = SearchParams(k=3, segment_postings=400, shard_postings=1500)
    asked = docs.where("doc_id % 50 = 0 and doc_id % 3 > 0")
    segments = cut(topk._segments(docs, spark.sparkContext.broadcast(topk._vocabulary(asked)), p))
    got = segments.agg(F.sum("docs"), F.sum(F.size("id")), F.sum("n"), F.sum(F.aggregate("size", F.lit(0), lambda a, x: a + x))).first()
    assert got[0] == len(rows) and got[1] < len(rows) * 0.7 and got[2] == got[3]
    shards = -(-got[2] // p.shard_postings)
    index = topk._dealt(segments, shards)
    held = [r["count"] for r in index.groupBy("shard").count().collect()]
    assert shards > 5 and len(held) == shards and max(held) - min(held) <= 1
    queries = asked.selectExpr("doc_id as query_id", "array(1L) as h", "array(1D) as w", "0D as floor")
    plan = topk._meet(index, shards, queries, 4, 20.0, p)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Sort" not in plan
    assert topk._meet(index, shards, queries, 4, 20.0, p).count() == 0
    # rounds of one, two and more shards give what one shard gives
    one = [tuple(r) for r in top_k(docs, asked, SearchParams(k=3)).orderBy("query_id", "rank").collect()]
    assert one == [tuple(r) for r in top_k(docs, asked, p).orderBy("query_id", "rank").collect()] and len(one) > 20


def test_postings_come_back_from_their_planes():
    for kind, x in ((np.int16, [0, 1, 300, 29_999]), (np.uint16, [1, 255, 65_535]), (np.int32, [1, 70_000, 2**31 - 1]), (np.int16, [])):
        planes = topk._planes(np.array(x, kind))
        assert len(planes) == len(x) * np.dtype(kind).itemsize and topk._joined(planes, kind).tolist() == x
