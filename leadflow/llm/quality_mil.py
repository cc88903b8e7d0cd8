"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded (surface measures through a learned tanh
layer), gated attention learned from document labels weighs the passages, and the weighted representation is
scored (Ilse et al. 2018). Fitting reads a sample of labelled rows of the learning fold, bounded in rows and in
passages; scoring reads every passage of every text.

Defined cases: a null or empty text is one empty passage; without labelled rows of both kinds in the sample the score
is the share of good labels (0.5 without any); repeated rows and null ids are scored each; equal places in the sample
go to the smaller id; very long texts are scored whole, and one beyond max_passages is only left out of the sample;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import cut, from_text, held_out, unique_labels

WORDS = re.compile(r"[^ \t-\r]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
PASSAGE = 64
N_FEATURES = 16


@dataclass(frozen=True)
class QualityParams:
    """max_rows and max_passages (64 bytes each) bound the sample of labelled rows that the fit reads."""

    max_rows: int = 8000
    max_passages: int = 400_000
    hidden: int = 16
    attention: int = 8
    epochs: int = 40
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.7
    seed: int = 11


def passage_features(words: list[str]) -> list[float]:
    n, joined = max(1, len(words)), "".join(words)
    chars = max(1, len(joined))
    counts = Counter(words)
    letters = sum(map(str.isalpha, joined)) if not joined.isalpha() else len(joined)
    upper = 0 if joined.islower() else sum(map(str.isupper, joined))
    ends = sum(w[-1] in ".!?" for w in words)
    return [
        len(joined) / n / 8, upper / chars, len(SYMBOLS.findall(joined)) / n, joined.count("!") / n, joined.count("|") / n,
        sum(map(str.isdigit, joined)) / chars if letters < chars else 0.0, letters / chars, len(counts) / n,
        max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        ends / n, sum(w[-1] in ",;:" for w in words) / n, sum(len(w) <= 3 for w in words) / n,
        sum(len(w) > 15 for w in words) / n, (not joined.isascii()) * 1.0, min(n, PASSAGE) / PASSAGE if words else 0.0,
    ]


def document_passages(text: str | None) -> np.ndarray:
    words = WORDS.findall(text or "")
    return np.array([passage_features(words[i : i + PASSAGE]) for i in range(0, max(1, len(words)), PASSAGE)], np.float32)


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Scores of n bags; x holds the passages of all bags, bag the bag of each passage, in order."""
    h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sig(h @ m["U"])
    e = (t * g) @ m["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    a = np.exp(e - top[bag])
    a /= np.bincount(bag, a, n)[bag]
    z = np.stack([np.bincount(bag, a * h[:, k], n) for k in range(h.shape[1])], 1)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sig(z @ m["c"] + m["d"])}


def fit_mil(bags: list[np.ndarray], y: np.ndarray, p: QualityParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    every = np.concatenate(bags)
    m = {"W": rng.normal(0, 0.3, (N_FEATURES, p.hidden)), "b": np.zeros(p.hidden), "V": rng.normal(0, 0.3, (p.hidden, p.attention)), "U": rng.normal(0, 0.3, (p.hidden, p.attention)), "w": rng.normal(0, 0.3, p.attention), "c": np.zeros(p.hidden), "d": np.zeros(1)}
    fixed = {"mean": every.mean(0), "std": every.std(0) + 1e-3}
    m["d"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second, t = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}, 0
    for epoch in range(p.epochs):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), p.batch):
            chosen = order[s : s + p.batch]
            x, n = np.concatenate([bags[i] for i in chosen]), len(chosen)
            bag = np.repeat(np.arange(n), [len(bags[i]) for i in chosen])
            f = forward(m | fixed, x, bag, n)
            x = (x - fixed["mean"]) / fixed["std"]
            dp = (f["p"] - y[chosen]) / n
            dz = dp[:, None] * m["c"]
            da = (dz[bag] * f["h"]).sum(1)
            de = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
            dtg = de[:, None] * m["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dp, "d": np.array([dp.sum()])}
            t += 1
            for k, g in grad.items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - p.rate * (0.5 if epoch > p.epochs // 2 else 1) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m | fixed


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> dict[str, np.ndarray] | float:
    """The model, or a constant score where the labels are of one kind only."""
    known = unique_labels(labels, "quality").where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id").limit(params.max_rows)

    def encode() -> Callable[[list[str | None]], dict]:
        return lambda texts: {"x": [document_passages(t).ravel() for t in texts]}

    # max_rows bounds the id list, so it may be broadcast to the scan
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    place = F.xxhash64("doc_id", F.lit(params.seed)).alias("place")
    encoded = cut(from_text(sample.select("_y", "doc_id", place, "text"), "text", encode, {"x": "array<float>"}))
    sizes = encoded.select("place", "doc_id", (F.size("x") / N_FEATURES).cast("long").alias("n")).toPandas().sort_values(["place", "doc_id", "n"])
    fits = sizes[sizes["n"].cumsum() <= params.max_passages]
    last = (int(fits["place"].iloc[-1]), int(fits["doc_id"].iloc[-1])) if len(fits) else None
    chosen_rows = encoded.where(F.struct("place", "doc_id") <= F.struct(*(F.lit(v).cast("long") for v in last))) if last else encoded.limit(0)
    got = chosen_rows.where(F.size("x") <= params.max_passages * N_FEATURES).select("_y", "x").toPandas()
    y = got["_y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit_mil([np.asarray(x, np.float32).reshape(-1, N_FEATURES) for x in got["x"]], y, params)


def quality_mil(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted, then n_passages and top_weight, the largest attention weight."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, params))

    def score() -> Callable[[list[str | None]], dict]:
        m = shared.value

        def run(texts: list[str | None]) -> dict:
            bags = [document_passages(t) for t in texts]
            n = [len(x) for x in bags]
            if isinstance(m, float) or not bags:
                return {"n_passages": n, "score": [m if isinstance(m, float) else 0.5] * len(n), "top_weight": [1.0] * len(n)}
            bag = np.repeat(np.arange(len(bags)), n)
            f = forward(m, np.concatenate(bags), bag, len(bags))
            top = np.zeros(len(bags))
            np.maximum.at(top, bag, f["a"])
            return {"n_passages": n, "score": f["p"], "top_weight": top}

        return run

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = from_text(rows, "text", score, {"n_passages": "long", "score": "double", "top_weight": "double"})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"), "n_passages", "top_weight")
