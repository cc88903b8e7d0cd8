"""The rule cascade's order and evaluations, and the estimated class prior."""

import numpy as np
import pandas as pd

from leadflow.llm import quality_rules, toxicity

CLEAN = " ".join(f"word{i}" for i in range(40))
TEXTS = [CLEAN, " ".join(["x#$%"] * 3 + [f"a{i}&&" for i in range(30)]), CLEAN.upper(), "too few", None, " ".join(f"{i}" for i in range(50)), CLEAN + " é" * 3]


def test_order_is_conditional_on_earlier_rules():
    """b rejects the same rows as a and more slowly, so after a it gains nothing and c, which rejects few others, comes first."""
    hit = pd.DataFrame({"a": [True] * 6 + [False] * 4, "b": [True] * 6 + [False] * 4, "c": [False] * 8 + [True] * 2})
    took = pd.DataFrame({"a": [1.0] * 10, "b": [1.1] * 10, "c": [2.0] * 10})
    assert quality_rules.cascade_order(took, hit) == ["a", "c", "b"]
    assert quality_rules.cascade_order(took.iloc[:0], hit.iloc[:0]) == ["a", "b", "c"]


def test_the_first_rejection_ends_the_cascade_and_parts_are_made_lazily():
    order = list(quality_rules.RULES)
    for text in TEXTS:
        d = quality_rules.Document(text)
        said, n = quality_rules.first_rejection(d, order)
        every = [k for k in order if quality_rules.RULES[k](quality_rules.Document(text))]
        assert said == (every[0] if every else None) and n == (order.index(said) + 1 if said else len(order))
    d = quality_rules.Document(TEXTS[1])
    assert quality_rules.first_rejection(d, ["symbols", "bullets", "one_word"]) == ("symbols", 1)
    assert "lines" not in vars(d) and "word_chars" not in vars(d)


def test_explained_rows_and_the_filter_agree(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, CLEAN), (0, CLEAN)], "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    rows = quality_rules.quality_rules(df, explain=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.n_evaluated == 0 if r.base_failed else 1 <= r.n_evaluated <= len(quality_rules.RULES)
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns and good.count() == sum(r.kept for r in rows)
    assert sum(r.n_evaluated for r in rows) < len(quality_rules.RULES) * sum(not r.base_failed for r in rows)


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)

    def row(toxic):
        return np.unique(np.append(rng.integers(0, 30, 6), 30 + rng.integers(0, 5, 3) if toxic else 35 + rng.integers(0, 5, 3)))

    for share in (0.05, 0.2):
        got = toxicity.estimated_prior([row(True) for _ in range(400)], [row(rng.random() < share) for _ in range(4000)], 40, toxicity.ToxicityParams())
        assert share / 2 < got < 2 * share
    assert toxicity.estimated_prior([], [], 0, toxicity.ToxicityParams()) == 0.5
