"""N-gram Jaccard join: documents whose sets of word shingles are at least 0.8 alike, and their components.

1. A count sketch of fixed size over all shingles gives the global order: rare slots first, then by hash. Any total order
   is valid for prefix filtering; the sketch decides only how short the candidate lists are.
2. Equal sets collapse to classes (128-bit signatures); each class is represented by its smallest doc_id.
3. Each class gives its prefix (the n - ceil(0.8 n) + 1 rarest shingles) to an inverted index; shingles that only one
   class has are dropped from it.
4. Candidates share a prefix shingle and pass the length filter, the positional filter (shared shingles before and
   after the match cannot reach the needed overlap) and the suffix filter (a bound of the sets' Hamming distance from
   counts in parts of the shingle space). Each candidate pair is verified once, on the full sets.
5. Posting lists of up to SMALL classes form their pairs. A longer list (near copies in thousands) never does: its
   members meet its pivot, the class in which the shingle stands earliest, so the least edited one. What a member
   differs in from the pivot is its delta; two members link exactly if their deltas' symmetric difference is small, so
   members are prefix-filtered a second time, in delta space, additions before omissions. There, copies of one
   text with edits of their own share nothing and form no pair. Members that hardly resemble the pivot (below STRANGER)
   can only link to members below MIDDLE (triangle inequality of the Jaccard distance) and meet those by posting list.
6. Pairs whose ends already share a component are not formed. So each pair of classes either is verified, is linked
   by the triangle inequality, is excluded by a bound, or cannot change a component.

Texts are hashed three times: for the sketch, for prefixes, and once more where a class has a candidate; those sets and
their counts by part are written once, and all filters and checks read that table. A shingle that thousands of classes
share, and a pivot that thousands meet, are hot keys: they are dealt over as many tasks as they need.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are their own component; rows that
share a doc_id are one document (their links are joined); a null doc_id is never linked and has a null component;
ties in rarity are broken by hash; very long texts are hashed whole; extra columns, whatever their names, are ignored by
ngram_join and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import cut, in_arrow, may_contain, membership, pieces, unused
from leadflow.llm.shingles import mix, shingle_sets
from leadflow.operators.components import connected_components
from leadflow.plans.lineage import SHARES, hot_keys, skew_join

SIZE = 5
#: The threshold in percent.
PERCENT = 80
#: Slots of the count sketch (2 MB of counts, broadcast).
SKETCH_BITS = 18
#: Longest posting list whose members meet pair by pair.
SMALL = 16
#: Similarity to a pivot under which a member is a stranger. A stranger's distance to the pivot is over 1 - STRANGER, so
#: by the triangle inequality it links only to members whose similarity is below STRANGER + 1 - percent / 100.
STRANGER = 0.4


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def sketch(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Counts of all documents' distinct shingles by hash slot."""
    n_slots, width = 1 << SKETCH_BITS, 1 << (SKETCH_BITS - 8)

    def rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_slots, np.int64)
        for b in pieces(batches):
            for s, _, _ in shingle_sets(_bytes(b.column(0)), size):
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield rows({i: total[i * width : (i + 1) * width] for i in range(n_slots // width) if total[i * width : (i + 1) * width].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(x, np.int64)
        yield rows(totals)

    kind = "part int, counts binary"
    counted = in_arrow(docs.select("text"), count, kind)
    got = in_arrow(counted.repartition("part"), add, kind).toArrow()
    out = np.zeros(n_slots, np.int64)
    for i, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[i * width : (i + 1) * width] = np.frombuffer(x, np.int64)
    return out


def _sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of stretches of x, modulo 2**64."""
    return np.diff(np.append(np.zeros(1, np.uint64), np.cumsum(x))[cuts])


def prefixes(docs: DataFrame, counts: np.ndarray, size: int = SIZE, percent: int = PERCENT, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n, signature (s1, s2), prefix in rare-first order and words, for each row of docs, with its carried columns."""
    rank = np.empty(len(counts), np.int64)  # a shingle's first bits become its slot's place by count, so that shingles ascend from the rare ones
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    own = docs.select(F.col("doc_id").cast("long"), "text", *carried)
    kind = T.StructType([*T.StructType.fromDDL("doc_id long, n int, s1 long, s2 long, prefix array<long>, words long").fields, *(own.schema[c] for c in carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, s1, s2, prefix, kept, words = [], [], [], [], [], []
            for s, cuts, k in shingle_sets(_bytes(b.column(1)), size, shared.value):
                m = np.diff(cuts)
                n.append(m)
                words.append(k)
                s1.append(_sums(mix(s + np.uint64(1)), cuts))
                s2.append(_sums(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cuts))
                kept.append(np.where(m > 0, m - (percent * m + 99) // 100 + 1, 0))
                prefix.append(s[np.arange(len(s)) - np.repeat(cuts[:-1], m) < np.repeat(kept[-1], m)])
            n, words, kept, s1, s2, prefix = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, words, kept, s1, s2, prefix))
            made = [pa.array(n.astype(np.int32)), pa.array(s1.astype(np.int64)), pa.array(s2.astype(np.int64)), _cut_lists(prefix.astype(np.int64), kept), pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *(b.column(2 + i) for i in range(len(carried)))], kind.names)

    return in_arrow(own, run, kind)


def _cut_lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def hashed_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, the whole set s and its counts by part c, for each row of docs.

    c counts a set's shingles in as many equal parts of the hash space as it has shingles, rounded up to a power of two.
    The difference of two sets' counts is a lower bound of their Hamming distance; counts stop at 127, which keeps it one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets, n, counts, parts = [], [], [], []
            for s, cuts, _ in shingle_sets(_bytes(b.column(1)), size):
                m = np.diff(cuts)
                bits = np.array([max(1, (int(x) - 1).bit_length()) for x in m])
                first = np.append(0, np.cumsum(1 << bits))
                part = (mix(s) >> np.repeat((64 - bits).astype(np.uint64), m)).astype(np.int64) + np.repeat(first[:-1], m)
                sets.append(s)
                n.append(m)
                parts.append(1 << bits)
                counts.append(np.minimum(np.bincount(part, minlength=first[-1]), 127).astype(np.int8))
            sets, n, counts, parts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sets, n, counts, parts))
            yield pa.RecordBatch.from_arrays([b.column(0), _cut_lists(sets.astype(np.int64), n), _cut_lists(counts.astype(np.int8), parts)], ["doc_id", "s", "c"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, s array<long>, c array<byte>")


def _passes(na: Column, nb: Column, ia: Column, ib: Column, percent: int) -> Column:
    """Length and positional filters for a prefix shingle at places ia and ib of sets of na and nb shingles."""
    most, least = F.greatest(na, nb), F.least(na, nb)
    need = _needed(na + nb, percent)
    reach = F.least(ia, ib) + 1 + F.least(na - ia - 1, nb - ib - 1)
    return (100 * least >= percent * most) & (reach >= need)


def _needed(s: Column, percent: int) -> Column:
    """Shared shingles that sets of s shingles together need to link."""
    return F.ceil(percent * s / F.lit(100.0 + percent) - 1e-9)


def _ends(docs: DataFrame, pairs: DataFrame, size: int, repeated: bool) -> DataFrame:
    """hashed_sets of the ends of pairs as a written table; only texts that a bitmap of the ends marks are hashed."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    wanted = may_contain(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", membership(ids, "doc_id")).where("_maybe")
    sets = cut(hashed_sets(wanted, size))
    return cut(sets.dropDuplicates(["doc_id", "s"])) if repeated else sets


def _with_ends(ends: DataFrame, pairs: DataFrame, c: str, a: str, b: str, hot: DataFrame | None = None) -> DataFrame:
    """pairs with column c of both ends as columns a and b; hot: hot keys among the first ends. Only what a side needs is shuffled."""

    def side(end: str, name: str) -> DataFrame:
        own = ends.select(F.col("doc_id").alias(end), F.col(c).alias(name))
        return may_contain(own, end, membership(pairs.select(end), end)).where("_maybe").drop("_maybe")

    met = pairs.join(side("b", b), "b")
    return met.join(side("a", a), "a") if hot is None else skew_join(met, side("a", a), "a", "b", hot=hot)


def _far(x: np.ndarray, y: np.ndarray) -> int:
    """The difference of two sets' counts by part, summed up to as many parts as the one with fewer has."""
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.abs(np.minimum(x, 127) - np.minimum(y, 127)).sum())


def _bounded(ends: DataFrame, pairs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """pairs with `most`: an upper bound of the shingles that their ends share (suffix filter)."""
    met = _with_ends(ends, pairs, "c", "pa", "pb", hot)
    rest = [c for c in met.columns if c not in ("pa", "pb")]
    kind = T.StructType([*(met.schema[c] for c in rest), T.StructField("far", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(len(rest) + i) for i in (0, 1)]
            (x, y), (i, j) = ([c.flatten().to_numpy().astype(np.int32) for c in sides], [np.append(0, np.cumsum(c.value_lengths().to_numpy())) for c in sides])
            far = [_far(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(rest))), pa.array(far, pa.int64())], kind.names)

    return in_arrow(met.select(*rest, "pa", "pb"), run, kind).withColumn("most", F.floor((F.col("na") + F.col("nb") - F.col("far")) / 2)).drop("far")


def _one_way(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb) with a < b."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"))
    return pairs.select(F.when(F.col("a") < F.col("b"), F.struct("a", "b", "na", "nb")).otherwise(turned).alias("x")).select("x.*").distinct()


def _labelled(df: DataFrame, labels: DataFrame, *ids: str) -> DataFrame:
    """df with the component c_<id> of each id column."""
    for k in ids:
        df = df.join(labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))
    return df


def _family_pairs(stars: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, na, nb) between members of one pivot, and links that need no check.

    stars: p, x, n, linked, delta (the shingles that only one of x and p has). With e = size of delta and h the largest
    Hamming distance that any pair with x may have, x is close if e <= h, else far. A linking pair's deltas share
    (e + e' - h) / 2 elements at least, so
      far with far:   both hold a common element among the first halves of their deltas, in any common order;
      close with far: the close one among its first half, the far one among its first h + 1;
      close with close, not both linked to p: an element at all, or e + e' fits h, which is a link by itself.
    """
    # pivots whose members are all in one component have nothing left to find
    named = _labelled(stars, labels, "x", "p")
    split = named.where("c_x <> c_p").select("p").distinct()
    fam = cut(named.join(split, "p", "left_semi").withColumnRenamed("c_x", "c").drop("c_p").withColumn("e", F.size("delta")))
    largest = fam.groupBy("p").agg(F.max("n").alias("most"))
    fam = fam.join(largest, "p").withColumn("h", F.floor((F.col("n") + F.least("most", F.floor(F.col("n") * 100 / percent))) * ((100 - percent) / (100.0 + percent)) + 1e-9).cast("int"))
    fam = fam.withColumn("close", F.col("e") <= F.col("h")).withColumn("half", F.col("e") - F.floor((F.col("e") + 2) / 2) + 1)
    # differences in a fixed order, the pivot's own shingles last: those of an edit of one's own come first
    fam = cut(fam)
    loose = fam.where("close and not linked").select("p", F.lit(True).alias("full")).distinct()
    fam = fam.join(loose, "p", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    used = F.when(F.col("close"), F.when(F.col("full"), F.col("e")).otherwise(F.col("half"))).otherwise(F.greatest("half", F.least(F.col("e"), F.col("h") + 1)))
    ranked = cut(fam.select("p", "x", "n", "h", "close", "linked", "half", "c", F.posexplode(F.slice("delta", F.lit(1), used.cast("int"))).alias("i", "t")))
    probe = ranked.select("p", "t", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("i").alias("iy"), F.col("close").alias("closey"), F.col("half").alias("halfy"), F.col("h").alias("hy"), F.col("linked").alias("linkedy"))
    far = probe.where("not closey and iy < hy + 1")
    met = ranked.where("i < half").join(far, ["p", "t"]).where("x <> y and c <> cy and (close or iy < halfy)")
    rest = ranked.where("close and not linked").join(probe.where("closey"), ["p", "t"]).where("x <> y and c <> cy")
    pairs = met.select("x", "y", "n", "ny").union(rest.select("x", "y", "n", "ny")).toDF("a", "b", "na", "nb")
    least = fam.where("close").groupBy("p", "n").agg(F.min(F.struct("e", "x")).alias("m")).select("p", F.col("n").alias("ny"), F.col("m.e").alias("ey"), F.col("m.x").alias("y"))
    both = F.col("n") + F.col("ny")
    sure = fam.where("close and not linked").join(least, "p").where((F.col("x") != F.col("y")) & (F.col("e") + F.col("ey") <= both - 2 * _needed(both, percent)))
    return pairs, sure.select(F.col("x").alias("a"), F.col("y").alias("b"))


def ngram_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, small: int = SMALL, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs; with carried columns, these and the row's words too."""
    rows = cut(prefixes(docs, sketch(docs, size), size, percent, carried))
    filled = rows.where("n > 0 and doc_id is not null")
    classes = cut(filled.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")))
    postings = classes.select("rep", "n", F.posexplode("prefix").alias("i", "token"))
    common = cut(postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    total = common.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    often = common.where(F.col("k") > max(total, 1000) / SHARES).select("token", F.ceil(F.col("k") * SHARES / F.lit(max(total, 1))).cast("int").alias("_parts"))
    index = cut(skew_join(postings, common, "token", "rep", hot=often).select("token", "rep", "n", "i", "k"))
    # rows of one doc_id with different texts are one document
    several = filled.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y")).where("x <> y").select("doc_id")
    same_id = filled.join(several, "doc_id", "left_semi").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    short = index.where(F.col("k") <= small)
    left = short.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"))
    right = short.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    fits = _passes(F.col("na"), F.col("nb"), F.col("ia"), F.col("ib"), percent)
    direct = left.join(right, "token").where((F.col("a") < F.col("b")) & fits).select("a", "b", "na", "nb").distinct()
    long = index.where(F.col("k") > small)
    pivot = long.groupBy("token").agg(F.min(F.struct("i", F.xxhash64("rep").alias("o"), F.col("rep").alias("p"), F.col("n").alias("np"))).alias("x")).select("token", "x.p", "x.np")
    listed = cut(skew_join(long, pivot, "token", "rep", hot=often))
    star = listed.where("rep <> p").select(F.col("p").alias("a"), F.col("rep").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb")).distinct()
    asked = cut(direct.withColumn("star", F.lit(False)).union(star.withColumn("star", F.lit(True))))
    repeated = not filled.groupBy("doc_id").count().where("count > 1").isEmpty()
    ends, hot = _ends(docs, asked, size, repeated), hot_keys(asked, "a")
    first = cut(_bounded(ends, asked, hot))
    both = F.col("na") + F.col("nb")
    strange = F.col("star") & (F.col("most") < STRANGER * (both - F.col("most")))
    close = first.where(~strange & (F.col("star") | (F.col("most") >= _needed(both, percent)))).drop("most")
    shared = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - F.col("k")
    met = _with_ends(ends, close, "s", "sa", "sb", hot).withColumn("k", shared).withColumn("like", F.col("k") / either)
    delta = F.when(F.col("star") & (F.col("like") >= STRANGER), F.concat(F.array_sort(F.array_except("sb", "sa")), F.array_sort(F.array_except("sa", "sb"))))
    seen = cut(met.select("a", "b", "na", "nb", "star", "like", (100 * F.col("k") >= percent * either).alias("linked"), delta.alias("delta")))
    links = cut(same_id.union(seen.where("linked").select("a", "b")))
    labels = connected_components(links, "a", "b")
    known = first.where(strange).select(F.col("a").alias("p"), F.col("b").alias("rep"), F.lit(0.0).alias("like"))

    stars = seen.where("star").select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("nb").alias("n"), "linked", "like", "delta")
    family, sure = _family_pairs(stars.where("delta is not null").drop("like"), labels, percent)
    ranked = listed.where("rep <> p").join(stars.where(F.col("like") < STRANGER + 1 - percent / 100).select("p", F.col("x").alias("rep"), "like").union(known), ["p", "rep"])
    loose = cut(_labelled(ranked, labels, "rep"))
    other = loose.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("c_rep").alias("cb"), F.col("like").alias("likeb"))
    odd = loose.where(F.col("like") < STRANGER).select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("c_rep").alias("ca"))
    stranger = odd.join(other, "token").where((F.col("ca") != F.col("cb")) & ((F.col("likeb") >= STRANGER) | (F.col("a") < F.col("b"))) & fits)
    more = cut(_one_way(family.union(stranger.select("a", "b", "na", "nb"))))
    second = cut(_bounded(ends, more).where(F.col("most") >= _needed(F.col("na") + F.col("nb"), percent)).drop("most"))
    last = _with_ends(ends, second, "s", "sa", "sb").withColumn("k", shared).where(100 * F.col("k") >= percent * either).select("a", "b")
    labels = connected_components(links.union(sure).union(last), "a", "b")

    component = classes.select("s1", "s2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("c"))
    more = ["words", *carried] if carried else []
    named = rows.select("doc_id", "n", "s1", "s2", *more).join(component, ["s1", "s2", "n"], "left")
    out = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("c", "doc_id")).alias("component_id")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), out, *more)


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; rows of one doc_id count as copies.

    Texts of rows that surely stay are not shuffled; only rows that a bitmap marks meet the exact lists.
    """
    marks = cut(ngram_join(docs, size, percent).select("doc_id", "component_id"))
    gone = marks.where("doc_id <> component_id").select("doc_id").distinct()
    again = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select("doc_id")
    columns, mark = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "_maybe")
    tested = may_contain(docs, "doc_id", membership(gone.union(again), "doc_id"), mark)
    sure = tested.where(F.col("doc_id").isNull() | ~F.col(mark)).select(*columns)
    unsure = tested.where(F.col("doc_id").isNotNull() & F.col(mark)).select(*columns).join(gone, "doc_id", "left_anti")
    repeated = unsure.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    single = unsure.join(again, "doc_id", "left_anti")
    return sure.union(single.select(*columns)).union(repeated.select(*columns))
