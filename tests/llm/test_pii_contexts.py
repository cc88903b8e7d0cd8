"""PII: contexts, growth and masking by span against plain versions."""

import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from leadflow.llm import pii

DOCS = "doc_id long, text string"


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)


def _plain_scan(text):
    """Seeds and unseen words of a text, by definition."""
    spans = plain.pii_spans(text)
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t-\r]+", text)]
    shape = lambda w: re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w))
    ctx = lambda i: f"{shape(words[i - 2][2])} {shape(words[i - 1][2])}" if i >= 2 else ""
    seeds = {(ctx(i), text[s:e], k) for k, s, e in spans for i, (a, b, _) in enumerate(words) if a <= s < b and i >= 2}
    unseen = set()
    for i, (a, b, w) in enumerate(words):
        v = re.sub("[.,;:!?]+$", "", w)
        if i >= 2 and (len(re.sub("[^0-9]", "", v)) >= 5 or "@" in v) and not any(s < b and a < e for _, s, e in spans):
            unseen.add((ctx(i), v, a, a + len(v)))
    return seeds, unseen


def _texts():
    rng = random.Random(3)
    bits = ["a@b.com", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "5551234567", "id", "Room", "12", "x@y", "é😀", "99999,", "call:", "call:", "me", "1.2.3.4@x.com"]
    return [rng.choice(["", " "]) + rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "one 12345", "9.9.9.9 " * 3000]


def test_contexts_match_the_definition(spark):
    texts = _texts()
    rows = pii.scan(_docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        seeds, unseen = _plain_scan(texts[r.own.doc_id])
        assert {(x.ctx, x.v, pii.KINDS[x.k]) for x in r.seeds} == seeds
        assert {tuple(x) for x in r.unseen} == unseen


def test_adjacent_identifiers_share_a_pattern(spark):
    texts = [f"room {i} account numbers: +1 555 123 45{i:02d}, +1 555 987 65{i:02d}; ok" for i in range(12)] + ["room 5 account numbers: 5551234567, 5559876543. ok"]
    got = {r.doc_id: r for r in pii.pii(_docs(spark, texts)).collect()}
    assert got[12].spans == "phone:24:34" and got[12].n_discovered == 1  # the second follows other words than the seeds' second


def test_discovered_instances_become_seeds(spark):
    """Values found after one pattern teach a second one, in which no base value ever stands."""
    texts = [f"please ring phone number: +1 555 123 45{i:02d} today" for i in range(12)]
    texts += [f"old phone number: 77123450{i:02d} and then extension code 77123450{i:02d} too" for i in range(8)]
    texts += ["only extension code 8812345678 here", "the year of 8812345679"]
    got = {r.doc_id: r for r in pii.pii(_docs(spark, texts)).collect()}
    last = len(texts) - 2
    at = texts[last].index("8812")
    assert got[12].n_discovered == 2 and got[last].spans == f"phone:{at}:{at + 10}" and got[last + 1].n_discovered == 0
    first = {r.doc_id: r for r in pii.pii(_docs(spark, texts), pii.PiiParams(generations=1)).collect()}
    assert first[last].n_discovered == 0 and first[12].n_discovered == 1


def test_growth_goes_on_until_nothing_is_found(spark):
    """Nine patterns, each taught by what the one before has found."""
    number = lambda g, i: f"77{g}1234{i:02d}"
    names = [f"word{chr(97 + g)}" for g in range(9)]
    texts = [f"please ring phone number: +1 555 123 45{i:02d} today" for i in range(20)]
    texts += [f"then phone number: {number(0, i)} or so" for i in range(8)]
    for g, name in enumerate(names):
        texts += [f"under code {name} {number(g, i)} once" for i in range(8)] + [f"under code {name} {number(g + 1, i)} once" for i in range(8)]
    got = {r.doc_id: r.n_discovered for r in pii.pii(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(20, len(texts))] == [1] * (len(texts) - 20)
    six = {r.doc_id: r.n_discovered for r in pii.pii(_docs(spark, texts), pii.PiiParams(generations=6)).collect()}
    assert six[28] == 1 and six[len(texts) - 1] == 0


def _plain_mask(text, spans):
    """Runs of overlapping spans, found one by one."""
    order = sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))
    out, at, i = "", 0, 0
    while i < len(order):
        k, s, e = order[i]
        i += 1
        while i < len(order) and order[i][1] < e:
            e, i = max(e, order[i][2]), i + 1
        out, at = out + text[at:s] + f"[{k.upper()}]", e
    return out + text[at:]


def test_masks_match_the_definition(spark):
    texts = _texts()
    df = _docs(spark, texts).selectExpr("*", "length(text) as n_chars", "1 as _maybe", "2 as own", "3 as more", "4 as _found", "5 as _word", "6 as row", "7 as `a.b`")
    found = {r.doc_id: r.spans for r in pii.pii(df).collect()}
    got = pii.mask_pii(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    for r in got.collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in found[r.doc_id].split(",") if x)]
        assert r.text == _plain_mask(texts[r.doc_id], spans), texts[r.doc_id]
        assert (r.n_chars, r._maybe, r.own, r.more, r._found, r["a.b"]) == (len(r.text), 1, 2, 3, 4, 7)


@pytest.mark.parametrize("doc_id", [None, 12])
def test_only_whole_words_are_masked(spark, doc_id):
    texts = [f"please call phone number: +1 (555) 123-45{i:02d} now" for i in range(12)]
    last = "phone number: 5551234567 95551234567x 5551234567@corp.com phone number: 5551234567"
    df = spark.createDataFrame([*enumerate(texts), (doc_id, last), (doc_id, last)], DOCS)
    got = [r.text for r in pii.mask_pii(df).where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).collect()]
    assert got == ["phone number: [PHONE] 95551234567x [EMAIL] phone number: [PHONE]"] * 2


def test_no_python_on_the_path(spark, tmp_path):
    plan = pii.pii(_docs(spark, ["a@b.com"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
