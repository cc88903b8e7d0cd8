"""Secret scans: base patterns, and corpus-wide ownership frequency of every candidate.

Each candidate value is hashed; a count of distinct repositories and owners over the whole corpus separates values
copied widely (examples, fixtures) from values that stay with one owner and so look live. Generic high-entropy
tokens outside the base patterns become spans of kind "owned" when only one owner has them.

In documents the owner is `source`; a repository is one source's files in one language.

Only (hash, repository, owner) triples and span lists are shuffled, never texts. A value that a third of all rows
carry is reduced to one row for each task before it is counted, and dealt over many tasks where its spans meet the
counts. Defined cases: null and empty texts have no spans; null owners count as one owner of their own; repeated rows
and null ids are scanned each (repeated rows of one owner still are one owner); spans that begin together are ordered
by kind as listed, "owned" last; work is linear in very long texts but for sorting; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import cut, from_text
from leadflow.plans.lineage import skew_join

#: Kinds in the order of the report, each with its pattern, the group that holds the value, and the least length of it.
KINDS = (
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class SecretParams:
    """Owners up to which a value counts as owner-specific, and the bits a character that a generic token needs."""

    most_owners: int = 1
    least_entropy: float = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed; leftmost and non-overlapping within a kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        # a run of 24 hex digits is maximal wherever it begins, so shorter runs need not be visited
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), kind, m[group]))
    return [(s, e, kind, v) for s, _, e, kind, v in sorted(out)]


def generic_spans(text: str, taken: list[tuple[int, int, str, str]], p: SecretParams) -> list[tuple[int, int, str, str]]:
    """High-entropy tokens that overlap no span of taken (ordered by start)."""
    starts, reach, out = [x[0] for x in taken], [], []
    for _, e, _, _ in taken:
        reach.append(max(e, reach[-1]) if reach else e)
    for m in GENERIC.finditer(text):
        v, before = m[0], bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and round(entropy(v), 9) >= p.least_entropy:
            out.append((m.start(), m.end(), "owned", v))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secrets(docs: DataFrame, p: SecretParams = SecretParams(), owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each row of docs: base counts and hash, all spans, and how many values are live or widely copied."""

    found = "array<struct<s:int,e:int,kind:string,hash:string>>"
    fields = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "found": found}

    def scan() -> Callable[[list[str | None]], dict]:
        def run(texts: list[str | None]) -> dict:
            rows = []
            for text in texts:
                base = base_spans(text or "")
                n = Counter(x[2] for x in base)
                spans = [{"s": s, "e": e, "kind": kind, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for s, e, kind, v in base + generic_spans(text or "", base, p)]
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(written([x[:3] for x in base]).encode()).hexdigest(), spans))
            return {k: [r[i] for r in rows] for i, k in enumerate(fields)}

        return run

    named = docs.select("doc_id", "text", F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("_owner"), F.concat_ws("\1", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository)).alias("_repo"))
    scanned = cut(from_text(named, "text", scan, fields))
    plain, carriers = scanned.where("size(found) = 0"), scanned.where("size(found) > 0")
    each = carriers.select(F.explode("found.hash").alias("hash"), "_owner", "_repo").distinct()
    owners = each.groupBy("hash").agg(F.countDistinct("_owner").alias("owners"), F.countDistinct("_repo").alias("repositories"))
    # one row for each span, judged by its value's owners, then back to one row for each carrier
    keyed = carriers.withColumn("_row", F.expr("uuid()"))
    keyed = cut(keyed)
    spans = keyed.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    spans = skew_join(spans, owners, "hash", "_row")
    live = F.col("owners") <= p.most_owners
    kept = spans.where((F.col("kind") != "owned") | live).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("s", F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3).alias("k"), "e", "kind"))).alias("all"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_widely_copied"), F.max("repositories").alias("most_repositories"),
    )
    line = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    with_spans = keyed.join(kept, "_row", "left").select(
        *columns, F.coalesce(line, F.lit("")).alias("spans"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_widely_copied", "most_repositories"))
    )
    zero = F.lit(0).cast("long")
    return plain.select(*columns, F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_widely_copied"), zero.alias("most_repositories")).unionByName(with_spans)
