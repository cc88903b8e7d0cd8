"""The URL language models against a plain version of their definition."""

import math
import zlib
from collections import Counter

import pytest

from leadflow.llm import url_filter

P = url_filter.UrlParams(order=3, least=2)


def _plain(urls, said):
    """Score of each URL; said: its rule's verdict or None."""
    pairs, contexts = {v: Counter() for v in ("allow", "block")}, {v: Counter() for v in ("allow", "block")}

    def at(url):
        text = "\0" * P.order + "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
        return [text[i - P.order : i + 1] for i in range(P.order, len(text))]

    for u, v in zip(urls, said, strict=True):
        if v and zlib.crc32((u or "").encode()) % 5:
            for g in at(u):
                for k in range(P.order + 1):
                    pairs[v][g[P.order - k :]] += 1
                    contexts[v][k, g[P.order - k : P.order]] += 1

    def prob(v, g):
        q = 1 / P.alphabet
        for k in range(P.order + 1):
            c = k, g[P.order - k : P.order]
            if contexts["allow"][c] + contexts["block"][c] >= P.least:
                q = (pairs[v][g[P.order - k :]] + P.prior * q) / (contexts[v][c] + P.prior)
        return q

    return [sum(math.log(prob("allow", g) / prob("block", g)) for g in at(u)) / max(1, len(u or "")) for u in urls]


def test_scores_match_the_definition(spark):
    urls = [f"https://Site{i % 9}.com/articles/{i * 7}/é" for i in range(60)] + [f"http://n{i}.net/es/casino-{i * 3}" for i in range(50)]
    urls += ["https://x.org/articles/12/story", "http://y.org/casino-9", None, "", "😀 odd", "http://z.org/" + "long/" * 3000, "http://n1.net/es/casino-3"]
    df = spark.createDataFrame([(i if i % 7 else None, u, 1) for i, u in enumerate(urls)], "page_id long, url string, gram int").selectExpr("*", "url as row", "1 as times", "2 as kept_out").repartition(3)
    got = url_filter.url_filter(df, p=P).join(df.select("url", "page_id"), "page_id").collect()
    said = ["allow" if ".com/" in (u or "") else "block" if ".net/es/" in (u or "") else None for u in urls]
    want = dict(zip(urls, _plain(urls, said), strict=True))
    assert len(got) > 90
    for r in got:
        assert r.score == pytest.approx(want[r.url], abs=1e-8)
    assert url_filter.url_filter(df, p=P).count() == len(urls)


def test_distributions_sum_to_one(spark):
    """After a known context, the probabilities of all characters of the alphabet seen there and unseen sum to one."""
    letters = "abcd"
    counts = spark.createDataFrame([(x + y, (ord(x) * ord(y)) % 5, (ord(x) + ord(y)) % 3) for x in letters for y in letters], "gram string, a long, r long")
    p = url_filter.UrlParams(order=1, alphabet=4)
    ratios = {r.gram: r.ratio for r in url_filter.log_ratios(counts, p).collect()}
    assert len(ratios) == 16
    rows = {r.gram: r for r in counts.collect()}
    total = {c: sum(getattr(r, c) for r in rows.values()) for c in "ar"}
    for x in letters:
        dist = {}
        for c in "ar":
            here = sum(getattr(rows[x + y], c) for y in letters)
            low = {y: (sum(getattr(rows[z + y], c) for z in letters) + p.prior / 4) / (total[c] + p.prior) for y in letters}
            dist[c] = {y: (getattr(rows[x + y], c) + p.prior * low[y]) / (here + p.prior) for y in letters}
            assert sum(dist[c].values()) == pytest.approx(1)
        for y in letters:
            assert ratios[x + y] == pytest.approx(math.log(dist["a"][y] / dist["r"][y]))
