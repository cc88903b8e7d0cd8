"""PII: base patterns, and contextual extraction bootstrapped from what they find. DataFrame functions only.

Positions come without Python: splitting a text at a pattern gives the gaps between its matches, and the lengths of
gaps and matches add up to where each match begins (code points).

Bootstrapping (pattern-instance graph): values that a base pattern finds are seeds; the two words in front of the word
where a value begins, A-Z lower-cased and runs of digits written as one 0, are its lexical pattern; other words that
look like identifiers (five digits or an "@") after the same two words are the pattern's instances. The context is
taken from the words of the whole text, by the same rule for seeds and for instances. Scores go back and forth: a
pattern's confidence in a kind is the mean confidence of its distinct instances, an unseen instance's is the mean over
its patterns. Patterns with enough distinct seeds and confidence become extractors; the unseen words after them are
spans of that kind, and count as seeds of every other pattern that they follow, so that the next generation may
become sure of more patterns, until none is found. Each generation adds a pattern at least, and patterns are finite, so it ends; scores
only grow and stay below 1, so their rounds end too.

Regular expressions are possessive, a match begins only at the start of a run or where the last match ended, and what
lies where is looked up by binary search, so time is linear in the text but for logarithms. Defined cases: null and
empty texts have no spans, and a null text stays null; repeated rows are judged each, but count once as instances; a
null doc_id is judged as any other; words with fewer than two words in front have no pattern; spans that overlap are
masked as one, as the kind of the one that begins first, then of the kind listed first; equally confident kinds go to
the kind listed first; extra columns, whatever their names, are ignored by `pii` and kept by `mask_pii`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadflow.llm.common import cut, lower_ascii, may_contain, membership
from leadflow.plans.lineage import hot_keys, skew_join

#: Kinds in the order of the report.
KINDS = ("email", "ip", "card", "phone")
#: What each kind matches, greedy runs written possessively; the same matches as the plain form.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds; texts without it skip the pattern.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
#: Words with a digit or "@"; WORDS separates words, and what it leaves has the same words in the same order.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
GAP = r"\s+"
STEP = 64


@dataclass(frozen=True)
class PiiParams:
    """A pattern needs least_seeds distinct seeds; rounds of scores go on until none moves by more than tolerance.

    generations: ends the growth early, for those who want that; None: it ends when a generation finds nothing.
    """

    tolerance: float = 0.01
    generations: int | None = None
    least_seeds: int = 5
    least_confidence: float = 0.8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """For an array of lengths, the sum before each element; work grows with STEP times the length, not its square."""

    def each(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda c: _sum(F.slice(a, c * STEP + 1, F.lit(STEP))))
        before = let(blocks, lambda bl: F.transform(F.sequence(F.lit(0), F.size(bl) - 1), lambda c: _sum(F.slice(bl, F.lit(1), c))))
        block = lambda i: F.floor(i / STEP).cast("int")
        return let(before, lambda bf: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(bf, block(i)) + _sum(F.slice(a, block(i) * STEP + 1, i % STEP))))

    return F.when(F.size(lengths) > 0, let(lengths, each)).otherwise(F.array().cast("array<long>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn's check of a string of digits."""
    doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        bare = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(v, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(v)).between(16, 19), luhn(digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(v)).between(8, 15)
    return F.lit(True)


def matches(rows: DataFrame, text: str, name: str, pattern: str, needs: str) -> DataFrame:
    """rows with column `name`: an array of (s, e, v) for each match; texts without a character of the class `needs` have none."""
    t = F.col(text)
    may = t.rlike(needs)
    out = rows.withColumn("_m", F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_g", F.when(F.size("_m") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    # lengths of gap and match, and what lies before both
    sizes = F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    begin = lambda z: running_sums(F.transform(z, lambda x: x["g"] + x["m"]))
    span = lambda x, b: F.struct((b + x["g"]).alias("s"), (b + x["g"] + x["m"]).alias("e"), x["v"].alias("v"))
    return out.withColumn(name, let(sizes, lambda z: F.zip_with(z, begin(z), span))).drop("_m", "_g")


def at_most(a: Column, x: Column) -> Column:
    """How many elements of the ascending array a are x or less, by binary search."""
    steps = F.sequence(F.ceil(F.log2(F.size(a) + 1)).cast("int"), F.lit(0), F.lit(-1))
    reach = lambda lo, k: lo + F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(steps, F.lit(0), lambda lo, k: F.when((reach(lo, k) <= F.size(a)) & (F.get(a, reach(lo, k) - 1) <= x), reach(lo, k)).otherwise(lo))


def _shape(word: Column) -> Column:
    return F.regexp_replace(lower_ascii(word), "[0-9]++", "0")


def _context(words: Column, i: Column) -> Column:
    """The two words before word i; empty with fewer."""
    return F.when(i >= 2, F.concat_ws(" ", _shape(F.get(words, i - 2)), _shape(F.get(words, i - 1)))).otherwise("")


def _valid_only(kind: str) -> Column:
    return F.filter(kind, lambda x: valid(kind, x["v"]))


def _base_of(i: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _seeds_of(i: int, kind: str, contexts: Column, starts: Column) -> Column:
    """A seed's context is that of the word in which it begins; starts: of the words that contexts belong to."""
    return F.transform(kind, lambda x: F.struct(F.get(contexts, at_most(starts, x["s"]) - 1).alias("ctx"), x["v"].alias("v"), F.lit(i).alias("k")))


def _with_ends(body: Callable[[Column, Column], Column], spans: Column) -> Column:
    """body of the ascending starts and ends of spans."""
    return let(F.array_sort(F.transform(spans, lambda x: x["s"])), lambda starts: let(F.array_sort(F.transform(spans, lambda x: x["e"])), lambda ends: body(starts, ends)))


def _count_of(i: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, keep: bool = False) -> DataFrame:
    """own (doc_id; keep: all columns of docs), base spans (k, s, e), seeds (ctx, v, k) and unseen identifier-like words (ctx, v, s, e)."""
    rows = docs.select(F.struct("*" if keep else "doc_id").alias("own"), F.coalesce("text", F.lit("")).alias("_t"))
    for kind in KINDS:
        rows = matches(rows, "_t", kind, PATTERNS[kind], NEEDS[kind])
        rows = rows.withColumn(kind, _valid_only(kind))
    base = F.concat(*(_base_of(i, k) for i, k in enumerate(KINDS)))
    rows = matches(rows.withColumn("base", base), "_t", "_tokens", TOKEN, "[0-9@]")
    # all words of texts that hold such a word; the j-th word with a digit or "@" is the j-th token
    words = F.when(F.size("_tokens") > 0, F.filter(F.split("_t", GAP, -1), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    places = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
    contexts = let(words, lambda w: F.transform(places(w), lambda i: _context(w, i)))
    rows = rows.withColumn("_contexts", contexts)
    seeds = let(F.col("_contexts"), lambda c: let(F.transform("_tokens", lambda x: x["s"]), lambda t: F.concat(*(_seeds_of(i, k, c, t) for i, k in enumerate(KINDS)))))
    named = F.zip_with("_tokens", "_contexts", lambda x, c: F.struct(c.alias("ctx"), F.regexp_replace(x["v"], "[.,;:!?]+$", "").alias("v"), x["s"].alias("s"), x["e"].alias("e")))
    looks = F.filter(named, lambda x: (x["ctx"] != "") & ((F.length(digits(x["v"])) >= 5) | x["v"].contains("@")))
    # a word is free if as many base spans end before it as begin before its end
    free = lambda x, starts, ends: at_most(starts, x["e"] - 1) == at_most(ends, x["s"])
    unseen = _with_ends(lambda starts, ends: F.filter(looks, lambda x: free(x, starts, ends)), F.col("base"))
    placed = F.transform(unseen, lambda x: F.struct(x["ctx"].alias("ctx"), x["v"].alias("v"), x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e")))
    return rows.select("own", "base", F.filter(seeds, lambda x: x["ctx"] != "").alias("seeds"), placed.alias("unseen"))


def bootstrap(scanned: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """(ctx, k): the patterns that became extractors, with the kind of which they are surest."""
    seeds = scanned.select(F.explode("seeds").alias("x")).select("x.*").distinct()
    unseen = scanned.select(F.explode("unseen").alias("x")).select("x.ctx", "x.v").distinct()
    seeds, unseen = cut(seeds), cut(unseen)
    hot = hot_keys(unseen, "ctx")
    sure = None
    for _ in count() if p.generations is None else range(p.generations):
        new = _sure_patterns(seeds, unseen, hot, p)
        new = cut(new if sure is None else new.join(sure, "ctx", "left_anti"))
        if new.isEmpty():
            break
        sure = new if sure is None else sure.union(new)
        # what new patterns discover is seen from now on: a seed wherever else it occurs
        found = skew_join(unseen, new, "ctx", "v", hot=hot).groupBy("v").agg(F.min("k").alias("k"))
        met = cut(unseen.join(found, "v", "left"))
        seeds, unseen = cut(seeds.union(met.where("k is not null").select("ctx", "v", "k")).distinct()), met.where("k is null").select("ctx", "v")
    return sure if sure is not None else seeds.select("ctx", "k").limit(0)


def _sure_patterns(seeds: DataFrame, unseen: DataFrame, hot: DataFrame, p: PiiParams) -> DataFrame:
    """One generation: (ctx, k) of patterns with enough seeds and confidence after rounds of scores over the graph."""
    patterns = seeds.groupBy("ctx", "k").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= p.least_seeds)
    known = cut(seeds.groupBy("ctx").agg(F.countDistinct("v").alias("n_known")).join(patterns, "ctx"))
    # only the edges of patterns with enough seeds can matter
    edges = cut(skew_join(unseen, known.select("ctx").distinct(), "ctx", "v", hot=hot))
    n_unseen = edges.groupBy("ctx").agg(F.count("*").alias("n_unseen"))
    conf = known.join(n_unseen, "ctx", "left").withColumn("all", F.col("n_known") + F.coalesce("n_unseen", F.lit(0)))
    conf = conf.select("ctx", "k", "n_seeds", "all", (F.col("n_seeds") / F.col("all")).alias("conf"))
    moved = 1.0
    while moved > p.tolerance:
        said = skew_join(edges, conf.select("ctx", "k", "conf"), "ctx", "v", hot=hot)
        instance = said.groupBy("v", "k").agg(F.avg("conf").alias("c"))
        gained = said.drop("conf").join(instance, ["v", "k"]).groupBy("ctx", "k").agg(F.sum("c").alias("gain"))
        again = ((F.col("n_seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("all")).alias("conf")
        seen = Observation()
        next_ = conf.join(gained, ["ctx", "k"], "left").select("ctx", "k", "n_seeds", "all", F.col("conf").alias("old"), again)
        conf = cut(next_.observe(seen, F.max(F.abs(F.col("conf") - F.col("old"))).alias("moved")).drop("old"))
        moved = seen.get["moved"] or 0.0
    return conf.where(F.col("conf") >= p.least_confidence).groupBy("ctx").agg(F.max_by("k", F.struct("conf", -F.col("k"))).alias("k"))


def _line(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"], x["e"])), ",")


def with_spans(docs: DataFrame, p: PiiParams = PiiParams(), keep: bool = False) -> DataFrame:
    """own, base and more (discovered spans) of each row of docs."""
    scanned = cut(scan(docs, keep).withColumn("row", F.monotonically_increasing_id()))
    sure = bootstrap(scanned, p)
    each = skew_join(scanned.select("row", F.explode("unseen").alias("x")).select("row", "x.ctx", "x.s", "x.e"), sure, "ctx", "row")
    more = cut(each.groupBy("row").agg(F.collect_list(F.struct("k", "s", "e")).alias("more")))
    tested = may_contain(scanned.drop("seeds", "unseen"), "row", membership(more, "row"))
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
    plain = tested.where("not _maybe").select("own", "base", none.alias("more"))
    return plain.union(tested.where("_maybe").join(more, "row", "left").select("own", "base", F.coalesce("more", none).alias("more")))


def pii(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """A row for each row of docs: base counts, base_sha256, spans (base and discovered) and n_discovered."""
    counts = [_count_of(i, k) for i, k in enumerate(KINDS)]
    line = _line(F.col("base"))
    spans = F.when(F.size("more") == 0, line).otherwise(_line(F.concat("base", "more")))
    return with_spans(docs, p).select("own.doc_id", *counts, F.sha2(line, 256).alias("base_sha256"), spans.alias("spans"), F.size("more").cast("long").alias("n_discovered"))


def masked(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans (k, s, e; at least one) replaced by the [KIND] of its first."""
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"))))
    # a run begins where all spans that began before have ended, and ends where all that have begun before end
    begins = lambda starts, ends: F.filter(ordered, lambda x: at_most(starts, x["s"] - 1) == at_most(ends, x["s"]))
    # of spans that begin together, the kind listed first
    first = lambda b: F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (F.get(b, i - 1)["s"] != x["s"]), x)), lambda x: x.isNotNull())
    last = lambda starts, ends: F.array_distinct(F.filter(ends, lambda e: at_most(starts, e - 1) == at_most(ends, e)))
    before = lambda to, i: F.coalesce(F.when(i > 0, F.get(to, i - 1)), F.lit(0))
    put = lambda x, i, to: F.concat(F.substr(text, (before(to, i) + 1).cast("int"), (x["s"] - before(to, i)).cast("int")), F.get(kind, x["k"]))
    joined = lambda runs, to: F.concat(F.array_join(F.transform(runs, lambda x, i: put(x, i, to)), ""), F.substr(text, (F.element_at(to, -1) + 1).cast("int")))
    return _with_ends(lambda starts, ends: let(begins(starts, ends), lambda b: let(last(starts, ends), lambda to: joined(first(b), to))), spans)


def mask_pii(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """docs in their own columns, base and discovered spans of text replaced by their kind; n_chars follows the text."""
    found = with_spans(docs, p, keep=True).select("own", F.concat("base", "more").alias("spans"))
    out = found.select("own", F.when(F.size("spans") > 0, masked(F.col("own.text"), F.col("spans"))).otherwise(F.col("own.text")).alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"own.`{c}`") for c in docs.columns))
