"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over word and word-prefix presence.

Confirmed toxic documents are the positives; documents drawn from the whole learning fold are the unlabelled rows,
whatever their labels say. The risk estimator corrects the unlabelled risk by the class prior and never lets the negative
part fall below zero (Kiryo et al. 2017). Fitting reads a bounded sample; scoring reads every whole text.

The class prior is a parameter. Where it is not given, it is the share of toxic rows among labelled ones if clean rows
are labelled too; with positives only, it is estimated: a classifier of half the positives against the unlabelled rows
gives the density ratio at the other half, and where documents are surely toxic the prior is its inverse (Elkan and
Noto 2008).

Defined cases: a null or empty text has no features and gets the score of the bias; without any confirmed toxic
row every score is 0; rows with a null id are scored and never learned from; repeated rows are scored each; equal
texts count once in the sample; equally telling features go by name; very long texts are read whole; extra columns,
whatever their names, are ignored by the scorer and kept by drop_toxic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import cut, filter_text, from_text, held_out, in_arrow, pieces, unique_labels

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    """max_positive and max_unlabelled bound the sample that the fit reads; max_features bounds the broadcast model.

    prior: share of toxic documents, None: from the labels (see above).
    """

    prior: float | None = None
    max_positive: int = 4000
    max_unlabelled: int = 10000
    max_features: int = 1000
    min_df: int = 4
    least_z: float = 5.0
    epochs: int = 60
    batch: int = 1000
    rate: float = 0.03
    l2: float = 1e-5
    threshold: float = 0.3
    seed: int = 7


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def document_features(text: str | None) -> set[str]:
    return {f for w in set(TOKEN.findall((text or "").lower())) for f in word_features(w)}


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        y, f = [], []
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = ["", *document_features(text)]  # the empty feature counts documents
            f += found
            y += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(f, pa.string())], ["_p", "_f"])


class Lookup:
    """Ids of the model's features in a text; what a word gives is kept, up to a fixed number of words."""

    def __init__(self, index: dict[str, int], most: int = 200_000):
        self.index, self.most, self.known = index, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        if len(known) > self.most:
            known.clear()
        for w in set(TOKEN.findall((text or "").lower())):
            got = known.get(w)
            if got is None:
                got = known[w] = [i for f in word_features(w) if (i := self.index.get(f)) is not None]
            if got:
                out.update(got)
        return np.fromiter(out, np.int64, len(out))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], dim: int, prior: float, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss."""
    rng, w, b = np.random.default_rng(p.seed), np.zeros(dim), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 0

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    steps = max(1, (len(unlabelled) + p.batch - 1) // p.batch)
    for _ in range(p.epochs):
        pos, unl = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(steps):
            ps, us = [positive[i] for i in pos[k::steps]] or [positive[pos[0]]], [unlabelled[i] for i in unl[k::steps]]
            (pi, pr), (ui, ur) = flat(ps), flat(us)
            zp, zu = np.bincount(pr, w[pi], len(ps)) + b, np.bincount(ur, w[ui], len(us)) + b
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_neg, gu_neg, gp_pos = sig(zp) / len(ps), sig(zu) / len(us), (sig(zp) - 1) / len(ps)
            if negative >= 0:
                gp, gu = prior * (gp_pos - gp_neg), gu_neg
            else:  # step back from the part that overfits
                gp, gu = prior * gp_neg, -gu_neg
            g = np.append(np.bincount(pi, gp[pr], dim) + np.bincount(ui, gu[ur], dim) + p.l2 * w, gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def estimated_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], dim: int, p: ToxicityParams) -> float:
    """Share of positives among the unlabelled, from positives and unlabelled rows alone; 0.5 where nothing can be said."""
    if len(positive) < 4 or not dim:
        return 0.5
    fit, probe = positive[0::2], positive[1::2]
    n, m = len(fit), len(unlabelled)
    rows = [*fit, *unlabelled]
    ids, of = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(n + m), [len(r) for r in rows])
    y, weight = np.repeat([1.0, 0.0], [n, m]), np.repeat([0.5 / n, 0.5 / m], [n, m])
    w, b = np.zeros(dim), 0.0
    for _ in range(200):  # both halves weigh the same, so the odds are the density ratio
        g = weight * (1 / (1 + np.exp(-np.clip(np.bincount(of, w[ids], n + m) + b, -30, 30))) - y)
        w, b = w - 2 * (np.bincount(ids, g[of], dim) + 1e-4 * w), b - 2 * g.sum()
    ratio = np.array([np.exp(np.clip(w[r].sum() + b, -30, 30)) for r in probe])
    return float(np.clip(1 / np.median(ratio), 0.005, 0.5))


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> tuple[dict[str, int], np.ndarray, float]:
    """The model (feature -> index, weights, bias) from the learning fold of docs."""
    fold = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = unique_labels(labels, "toxic").where(~held_out(F.col("doc_id")))
    n, n_pos = known.agg(F.count("*"), F.count_if(F.col("_y") == 1)).first()
    if not n_pos:
        return {}, np.zeros(0), -30.0
    prior = params.prior if params.prior is not None else min(max(n_pos / n, 0.005), 0.5) if n > n_pos else None
    order = F.xxhash64(F.col("doc_id"), F.lit(params.seed)), F.col("doc_id")
    pos_ids = known.where("_y = 1").orderBy(*order).limit(params.max_positive).select("doc_id", F.lit(1).alias("_p"))
    unl_ids = fold.select("doc_id").distinct().orderBy(*order).limit(params.max_unlabelled).select("doc_id", F.lit(0).alias("_p"))
    # both limits bound the id list, so it may be broadcast to the scan instead of shuffling the texts
    # equal texts count once, so that copies of one document do not vote for its rare words
    sample = cut(fold.join(F.broadcast(pos_ids.union(unl_ids)), "doc_id").select("text", "_p").dropDuplicates())
    df = cut(in_arrow(sample, _features_of, "_p int, _f string").groupBy("_f").agg(F.sum("_p").alias("p"), F.count("*").alias("n")))
    every = df.where("_f = ''").first()
    if every is None:
        return {}, np.zeros(0), -30.0
    counts = df.where((F.col("n") >= params.min_df) & (F.col("_f") != ""))
    share_p, share_u = F.col("p") / F.lit(float(max(every["p"], 1))), (F.col("n") - F.col("p")) / F.lit(float(max(every["n"] - every["p"], 1)))
    n_p, n_u = float(max(every["p"], 1)), float(max(every["n"] - every["p"], 1))
    pooled = F.col("n") / F.lit(n_p + n_u)
    z = F.abs(share_p - share_u) / F.sqrt(pooled * (1 / n_p + 1 / n_u))
    counts = counts.where(z >= params.least_z)
    vocabulary = counts.orderBy(z.desc(), "_f").limit(params.max_features).select("_f")
    index = {r[0]: i for i, r in enumerate(vocabulary.collect())}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode() -> Callable[[list[str | None]], dict]:
        look = Lookup(shared.value)
        return lambda texts: {"ids": [look(x) for x in texts]}

    got = from_text(sample, "text", encode, {"ids": "array<long>"}).toPandas()
    rows = [np.asarray(x, np.int64) for x in got["ids"]]
    positive = [r for r, p in zip(rows, got["_p"], strict=True) if p]
    unlabelled = [r for r, p in zip(rows, got["_p"], strict=True) if not p]
    if not positive:
        return {}, np.zeros(0), -30.0
    if prior is None:
        prior = estimated_prior(positive, unlabelled, len(index), params)
    if not unlabelled or not index:
        return {}, np.zeros(0), float(np.log(prior / (1 - prior)))
    return index, *fit_nnpu(positive, unlabelled, len(index), prior, params)


def _scores(model: tuple[dict[str, int], np.ndarray, float]) -> Callable[[list[str | None]], np.ndarray]:
    index, w, b = model
    look = Lookup(index)
    return lambda texts: 1 / (1 + np.exp(-np.clip([w[look(t)].sum() + b for t in texts], -30, 30)))


def score_toxicity(docs: DataFrame, model: tuple[dict[str, int], np.ndarray, float], params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """docs' doc_id with held_out, score and predicted, a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score() -> Callable[[list[str | None]], dict]:
        f = _scores(shared.value)
        return lambda texts: {"score": f(texts)}

    scored = from_text(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), "text", score, {"score": "double"})
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, params), params)


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """docs without the rows that the model rejects, in their own columns; the text is scored in the scan, nothing is shuffled."""
    shared, most = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, params)), params.threshold

    def keep() -> Callable[[list[str | None]], np.ndarray]:
        f = _scores(shared.value)
        return lambda texts: f(texts) < most

    return filter_text(docs, "text", keep)
