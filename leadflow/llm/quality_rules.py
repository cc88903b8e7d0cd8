"""Quality rules: a short-circuit cascade whose order comes from cost and selectivity measured on a sample.

A rule rejects some share of the documents and costs the time of what it alone makes of a text. A bounded sample of
documents that pass the base test gives both, rule by rule: the next rule is the one that rejects most per second
among the sampled documents that no earlier rule rejects. Rules then run in that order, each text is taken apart only
as far as the rules reached ask for it, and the first that rejects ends the cascade. The order changes cost only, never
the verdict. `quality_rules` reports the base counts of every document, as its contract asks, so they are not the
cascade's cost; `keep_good` filters by the rules alone.

Defined cases: a null text has no words (and so fails the base test); an empty table gives no rows; repeated rows and
null ids are judged each; rules that gain the same per second run in order of name; extra columns are ignored by
`quality_rules` and kept by `keep_good`.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import BATCH_ROWS, filter_text, from_text

WORDS = re.compile(r"[^ \t-\r]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A word with a Latin-1 capital and no lower-case letter.
CAPITALS = re.compile("[^a-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ][^a-zß-öø-ÿ]*")
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
WINDOW = 5


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    spans = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(spans)) == len(spans):
        return 0
    seen: dict[tuple, int] = {}
    for s in spans:
        seen[s] = seen.get(s, 0) + 1
    total, reach = 0, 0  # reach: end of what is counted
    for i, s in enumerate(spans):
        if seen[s] > 1:
            total += i + WINDOW - max(i, reach)
            reach = i + WINDOW
    return total


class Document:
    """A text and what rules ask of it; each part is made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORDS.findall(self.text)

    @cached_property
    def n(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORDS.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines that hold a word and equal an earlier line."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n < 10 or 100 * self.n_repeat_words > 20 * self.n


def _capitals(d: Document) -> bool:
    """Most words are written in capitals."""
    return 10 * sum(CAPITALS.fullmatch(w) is not None for w in d.words) > 6 * d.n


def _no_letters(d: Document) -> bool:
    """Half of the words hold no letter of a Latin alphabet."""
    return 2 * sum(LETTER.search(w) is None for w in d.words) > d.n


def _one_word(d: Document) -> bool:
    """One word, in any case, makes up more than three tenths of a text."""
    return d.n > 0 and 10 * max(Counter(w.lower() for w in d.words).values()) > 3 * d.n


def _bullets(d: Document) -> bool:
    """Nearly all lines begin like items of a list."""
    return 10 * sum(x.lstrip(" \t\v\f\r")[:1] in "-*•" for x in d.lines) > 9 * len(d.lines)


#: A rule's name and the test that rejects; each is a pure function of the text.
RULES: dict[str, Callable[[Document], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > 3 * max(1, d.n),
    "mean_word": lambda d: d.word_chars < 2 * d.n or d.word_chars > 14 * d.n,
    "dup_lines": lambda d: 2 * d.n_dup_lines > d.text.count("\n") + 1,
    "capitals": _capitals,
    "vocabulary": lambda d: 20 * len(set(d.words)) < d.n,
    "no_letters": _no_letters,
    "one_word": _one_word,
    "bullets": _bullets,
}


@dataclass(frozen=True)
class RuleParams:
    """sample_rows bounds the sample from which the order of the rules is estimated."""

    sample_rows: int = 2000
    seed: int = 3


def first_rejection(d: Document, order: list[str]) -> tuple[str | None, int]:
    """The first rule in order that rejects (None: none does), and how many rules were evaluated."""
    for i, name in enumerate(order, 1):
        if RULES[name](d):
            return name, i
    return None, len(order)


def cascade_order(took: pd.DataFrame, hit: pd.DataFrame) -> list[str]:
    """Rules by rejections per second among documents that earlier rules leave; a row a sampled document, a column a rule."""
    order, alive = [], pd.Series(True, index=hit.index)
    while len(order) < len(hit.columns):
        left = [c for c in hit.columns if c not in order]
        gain = {c: (hit.loc[alive, c].sum() + 0.5) / (took.loc[alive, c].sum() + 1e-6) for c in left}
        best = min(left, key=lambda c: (-gain[c], c))
        order.append(best)
        alive &= ~hit[best]
    return order


def rule_order(docs: DataFrame, params: RuleParams = RuleParams(), report: bool = True) -> list[str]:
    """Names of the rules in the order of the cascade. report: base counts are made anyway, so they cost no rule anything."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                if Document(text).base_failed:
                    continue  # the cascade never sees it
                row = []
                for rejects in RULES.values():
                    d = Document(text)
                    _ = d.words, report and (d.word_chars, d.n_symbols, d.n_dup_lines)
                    began = time.perf_counter()
                    hit = bool(rejects(d))
                    row += [time.perf_counter() - began, hit]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[x + c for c in RULES for x in ("t_", "h_")])

    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id").limit(params.sample_rows).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")  # sample_rows bounds the list
    fields = ", ".join(f"t_{c} double, h_{c} boolean" for c in RULES)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, BATCH_ROWS)
    got = sample.mapInPandas(probe, fields).toPandas()
    took, hit = (pd.DataFrame({c: got[x + c].astype(kind) for c in RULES}) for x, kind in (("t_", float), ("h_", bool)))
    return cascade_order(took, hit)


def quality_rules(docs: DataFrame, params: RuleParams = RuleParams(), explain: bool = False) -> DataFrame:
    """doc_id, base counts, base_failed and kept for each row of docs; kept is the same whatever order the sample suggests.

    explain adds rejected_by (the rule that ended the cascade) and n_evaluated (rules run), which follow the order.
    """
    order = rule_order(docs, params)
    fields = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean"}
    fields |= {"rejected_by": "string", "n_evaluated": "long"} if explain else {}

    def judge() -> Callable[[list[str | None]], dict]:
        def run(texts: list[str | None]) -> dict:
            out = []
            for text in texts:
                d = Document(text)
                said, n = (None, 0) if d.base_failed else first_rejection(d, order)
                out.append((d.n, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, not d.base_failed and said is None, said, n))
            return {k: [x[i] for x in out] for i, k in enumerate(fields)}

        return run

    return from_text(docs.select("doc_id", "text"), "text", judge, fields)


def keep_good(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of docs that pass the base test and every rule, with all their columns; nothing is made that no rule asks for."""
    order = rule_order(docs, params, report=False)

    def keep() -> Callable[[list[str | None]], list[bool]]:
        def run(texts: list[str | None]) -> list[bool]:
            each = map(Document, texts)
            return [not d.base_failed and first_rejection(d, order)[0] is None for d in each]

        return run

    return filter_text(docs, "text", keep)
