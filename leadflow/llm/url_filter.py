"""URL filter: allow and block rules first, a character language-model ratio for the rest.

Two smoothed Markov models of variable order, one of URLs that a rule accepts and one of those that a rule rejects,
give each URL a log-likelihood difference a character; a threshold calibrated on a fold kept from training turns it
into a verdict.

Counts are exact and grow with the corpus: every character of every URL with the `order` characters before it is one
row, and grams of a lower order are sums over those of the highest. A character's probability after k characters is
its count there smoothed by its probability after k - 1; a context seen fewer than `least` times in training adds
nothing to the shorter one. Models are tables of (gram, log ratio) that URLs meet in a join; only the few hundred
grams that make up most of all URLs are broadcast, a bounded list.

Defined cases: a URL that is null or lacks "://" has an empty host and path, fits no rule and is scored as the text
it is (null: empty); an empty URL has the score 0; with one kind of example only, the verdict is allow unless a
rule blocks. Repeated rows and null ids are judged each, and count each in training. Ties at the threshold are
allowed; among thresholds that err equally often, the middle one counts. Very long URLs are read whole. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadflow.llm.common import cut, lower_ascii
from leadflow.plans.lineage import SHARES

#: (rule, verdict): a host, "/", and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@dataclass(frozen=True)
class UrlParams:
    """order: characters of context; least: training rows that a context needs; prior: weight of the shorter context."""

    order: int = 5
    least: int = 2
    prior: float = 4.0
    alphabet: int = 256
    bins: int = 400
    widest: float = 4.0


PARAMS = UrlParams()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does; equally long rules: the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # later ones win
        of, _, begins = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{begins}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(url: Column, order: int) -> Column:
    """For each character of the URL (A-Z lower-cased), it and the `order` characters before it; zeros stand before the first."""
    text = F.concat(F.lit("\0" * order), lower_ascii(F.coalesce(url, F.lit(""))))
    letters = F.split(text, "")
    shifted = F.arrays_zip(*(F.slice(letters, k + 1, F.greatest(F.size(letters) - order, F.lit(0))).alias(f"c{k}") for k in range(order + 1)))
    return F.when(F.length(url) > 0, F.transform(shifted, lambda x: F.concat(*(x[f"c{k}"] for k in range(order + 1))))).otherwise(F.array().cast("array<string>"))


def log_ratios(counts: DataFrame, p: UrlParams = PARAMS) -> DataFrame:
    """(gram, ratio): log of the accepted model's probability over the rejected one's, for each gram of counts.

    counts: gram, a, r; a and r: how often training has it in accepted and rejected URLs.
    """
    before, model = None, None
    for k in range(p.order + 1):
        short = F.substr("gram", F.lit(p.order - k + 1))  # the last k + 1 characters
        pairs = counts.groupBy(short.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        contexts = pairs.groupBy(F.substr("g", F.lit(1), F.lit(k)).alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        model = pairs.withColumn("c", F.substr("g", F.lit(1), F.lit(k)))
        if k == 0:
            model = model.join(F.broadcast(contexts), "c")  # the empty context: one row
            pa, pr = F.lit(1.0 / p.alphabet), F.lit(1.0 / p.alphabet)
        else:
            model = model.join(contexts, "c").withColumn("s", F.substr("g", F.lit(2))).join(before, "s")
            pa, pr = F.col("pa"), F.col("pr")
        known = (F.col("ca") + F.col("cr")) >= p.least
        smooth = lambda n, all_, q: F.when(known, (F.col(n) + p.prior * q) / (F.col(all_) + p.prior)).otherwise(q)  # noqa: B023, E731
        model = model.select("g", smooth("a", "ca", pa).alias("pa"), smooth("r", "cr", pr).alias("pr"))
        before = model.withColumnRenamed("g", "s")
    return model.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, p: UrlParams = PARAMS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-likelihood difference a character) for each row of pages."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    kept_out = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5 == 0
    judged = cut(judged.withColumns({"rule": rule, "said": said, "kept_out": kept_out, "n": F.coalesce(F.length("url"), F.lit(0)), "row": F.monotonically_increasing_id()}))
    each = judged.select("row", F.when(~F.col("kept_out"), F.col("said")).alias("teaches"), F.explode(grams(F.col("url"), p.order)).alias("gram"))
    seen = Observation()
    taught = [F.count_if(F.col("teaches") == v).alias(c) for v, c in (("allow", "a"), ("block", "r"))]
    counts = cut(each.groupBy("gram").agg(*taught, F.count("*").alias("times")).observe(seen, F.sum("times").alias("total")))
    ratios = cut(log_ratios(counts, p).join(counts.select("gram", "times"), "gram"))
    # grams with more than one in SHARES of all characters: fewer than SHARES, so they may be broadcast
    hot = F.col("times") > (seen.get["total"] or 0) / SHARES
    common = each.join(F.broadcast(ratios.where(hot).select("gram", F.col("ratio").alias("known"))), "gram", "left")
    here = common.groupBy("row").agg(F.sum("known").alias("d"))
    rest = common.where("known is null").select("row", "gram").join(ratios.where(~hot).select("gram", "ratio"), "gram").groupBy("row").agg(F.sum("ratio").alias("d"))
    sums = here.union(rest).groupBy("row").agg(F.sum("d").alias("d"))
    scored = judged.join(sums, "row", "left").withColumn("score", F.coalesce(F.round(F.col("d") / F.greatest("n", F.lit(1)), 9), F.lit(0.0)))
    scored = cut(scored.drop("row", "d", "n", "url"))
    width = 2 * p.widest / p.bins
    bin_of = F.floor((F.least(F.greatest("score", F.lit(-p.widest)), F.lit(p.widest - width)) + p.widest) / width).cast("int")
    hist = np.zeros((2, p.bins))
    for r in scored.where("kept_out and said is not null").groupBy((F.col("said") == "allow").cast("int").alias("cls"), bin_of.alias("bin")).count().collect():
        hist[r["cls"], r["bin"]] = r["count"]  # at most 2 * bins rows
    by_model = F.when(F.col("score") >= calibrated(hist, p), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "score")


def calibrated(hist: np.ndarray, p: UrlParams = PARAMS) -> float:
    """The bin edge with the smallest sum of both error rates, the middle one among equals; -inf without both kinds."""
    n = hist.sum(1)
    if not n.all():
        return float("-inf")
    lost = np.append(0, np.cumsum(hist[1])) / n[1]  # accepted ones below the edge
    through = 1 - np.append(0, np.cumsum(hist[0])) / n[0]
    error = lost + through
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] * 2 * p.widest / p.bins - p.widest)
