"""N-gram join, exact search: against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import plain
import pytest

from leadflow.llm import ngram_join as join
from leadflow.llm.shingles import shingles_of, word_hashes
from leadflow.llm.topk import PROMISING, SearchParams, Shard, top_k

DOCS = "doc_id long, text string, source string"


def _words(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("0123456789") for _ in range(n)]


def _corpus():
    rng = random.Random(4)
    texts = {}
    for i in range(120):
        texts[i] = " ".join(_words(rng, rng.choice([1, 3, 4, 5, 6, 20, 80])))
    base = _words(rng, 150)
    for i in range(200, 290):  # near copies, some of them linked only through others
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: rng.randrange(110, 150)]
        texts[i] = " ".join(w)
    passage = _words(rng, 60)
    for i in range(300, 360):  # a long passage shared by many different texts
        texts[i] = " ".join(_words(rng, rng.choice([2, 10, 60])) + passage)
    for i in range(400, 430):
        texts[i] = texts[rng.randrange(200, 290)].upper()
    texts[500], texts[501], texts[502] = None, "", " \t\n"
    return texts


@pytest.mark.parametrize("small", [2, 16])
def test_components_match_brute_force(spark, small):
    texts = _corpus()
    df = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], DOCS).repartition(5)
    got = {r.doc_id: r for r in join.ngram_join(df, small=small).collect()}
    want = plain.components(texts)
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(plain.shingles(t)) for k, t in texts.items()}


def test_join_edge_cases(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, "A B C D E F", None), (3, None, "y"), (4, "x" * 200_000, "y")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as token", "3 as prefix")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in join.ngram_join(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 4, 4), (True, 0, None)]
    df = df.selectExpr("*", "7 as _maybe", "8 as _word", "9 as _bits", "6 as _shift", "5 as own", "4 as `a.b`")
    kept = join.keep_one(df)
    assert {tuple(r)[6:] for r in kept.collect()} == {(7, 8, 9, 6, 5, 4)}
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert join.ngram_join(df.limit(0)).collect() == []
    assert join.keep_one(df.limit(0)).collect() == []


def test_components_match_brute_force_at_another_threshold(spark):
    texts = _corpus()
    got = {r.doc_id: r.component_id for r in join.ngram_join(spark.createDataFrame([(k, t, "s") for k, t in texts.items()], DOCS), percent=50, small=3).collect()}
    assert got == plain.components(texts, 50)


def test_one_document_with_two_texts_joins_their_links(spark):
    rows = [(5, "a b c d e f g", "x"), (5, "h i j k l m n", "x"), (6, "a b c d e f g", "x"), (7, "h i j k l m n", "x")]
    got = {(r.doc_id, r.component_id) for r in join.ngram_join(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(5, 5), (6, 5), (7, 5)}


def test_shingle_hashes_agree_with_words():
    texts = ["a b  c\td\ne f", "A B C D E F", "", None, "é x y", "one two", "a b c d e f " * 3, "z" * 3_000_000 + " q"]
    got = [shingles_of(w, 5) for w in word_hashes(texts)]
    assert [len(g) for g in got] == [len(plain.shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[1])
    assert len(next(iter(word_hashes([texts[4]])))) == 2


def _bm25(texts, query_ids, k, k1=1.2, b=0.75):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    out = {}
    for q in query_ids:
        scores = []
        for i, x in words.items():
            c = Counter(x)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(x) / mean)) for w in set(words[q]) if w in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_search_matches_brute_force(spark):
    texts = _corpus()
    df = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], DOCS).repartition(3)
    asked = [i for i in texts if i % 50 == 0]
    got = {}
    for r in top_k(df, df.where("doc_id % 50 = 0"), SearchParams(k=7, segment_postings=600, shard_postings=2000)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    want = _bm25(texts, asked, 7)
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_search_edge_cases(spark):
    rows = [(50, "a b", "s"), (51, "a b", "s"), (None, "a b", "s"), (100, None, "s"), (52, "c", "s")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as h", "2 as score")
    got = [(r.query_id, r["rank"], r.doc_id) for r in top_k(df, df.where("doc_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 50), (50, 2, 51)]
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_cursors_skip_entries_and_blocks_that_cannot_reach_the_threshold():
    """Documents of two vocabularies: a query of one leaves most blocks of the other unread, and nothing is lost."""
    rng = np.random.default_rng(2)
    n = 64 * 40
    kind = rng.integers(0, 2, n)
    kind.sort()  # as segments order them
    words = [np.unique(np.append(kind[i], rng.zipf(1.3, 30) % 200 * 2 + kind[i] + 10)) for i in range(n)]
    words = [np.append(w, [5, 7][i % 640 > 0 :]) for i, w in enumerate(words)]  # 7 everywhere, 5 in four blocks
    size = np.array([len(w) for w in words])
    of, h = np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(words).astype(np.int64)
    tf = rng.integers(1, 5, len(h)).astype(np.int32)
    p = SearchParams(k=5)
    by = np.lexsort((of, h))
    runs, counts = np.unique(h, return_counts=True)
    shard = Shard(np.arange(n), size, runs, counts, of[by], tf[by], float(size.mean()), p)
    impact = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size[of] / size.mean()))
    for q in range(20):
        asked = np.unique(np.append(words[q], [7]))
        weight = rng.random(len(asked)) + 0.1
        t = np.searchsorted(shard.words, asked)
        ids, scores = shard.search(t, weight)
        w = dict(zip(asked.tolist(), weight.tolist(), strict=True))
        full = np.round(np.bincount(of, impact * np.array([w.get(x, 0.0) for x in h.tolist()]), n), 6)
        want = np.lexsort((np.arange(n), -full))[:5]
        assert ids.tolist() == want.tolist() and np.allclose(scores, full[want])
    assert 0 < shard.read < 0.7 * 20 * shard.n_blocks
    # a rare word that decides and two frequent ones: their cursors jump from one of its blocks to the next
    shard.bounded = shard.listed = shard.read = 0
    shard.k = 3
    ids, scores = shard.search(np.searchsorted(shard.words, [5, 7, 12]), np.array([5.0, 0.1, 0.1]))
    full = np.bincount(of, impact * np.select([h == 5, h == 7, h == 12], [5.0, 0.1, 0.1], 0.0), n)
    assert ids.tolist() == np.lexsort((np.arange(n), -np.round(full, 6)))[:3].tolist()
    assert shard.bounded < 0.6 * shard.listed and shard.read <= 4 + PROMISING < shard.n_blocks  # entries stood at, blocks read
