"""Operator 11: hard negatives of anchors, by product quantisation with stored residual norms.

Index: every different (label, vector) is one row with the smallest ids that carry it, its code (one of 256 centroids in
each of 32 subspaces) and the norm of what the code leaves over. An anchor makes a table of inner products with all
centroids once; the sum of a row's entries, plus or minus |anchor| * residual norm, holds the true score by the
Cauchy-Schwarz inequality, so a row whose interval misses a window is out for certain. What is left is scored exactly in
whole numbers. Codebooks come from a bounded sample (`sample` rows); they decide how much is pruned, never what is found.

Two passes of the anchors over the index: positives first (the k best of the anchor's label), then, with the windows
that their scores give, negatives. Blocks of the index are bounded, anchors stream past them; results of all blocks meet
by anchor, a few rows each.

Rows without id, label, vector or with a null or non-finite component take no part. Rows that repeat an id count once,
with the smallest label and vector. Shorter vectors count as if zeros followed. Ties go to the smaller id. An empty
table, or one without anchors, gives no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import cut, in_arrow
from leadflow.llm.vectors import block_count, copies, finite, id_lists, matrix, padded, past_blocks


@dataclass(frozen=True)
class NegativeParams:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score is from low to high percent of the positive's.
    low: int = 50
    high: int = 95
    anchors_every: int = 50
    subspaces: int = 32
    #: Rows that codebooks are fitted to.
    sample: int = 4096
    #: Rows of a block of the index.
    least_rows: int = 4096
    most_rows: int = 1 << 17
    #: Rows that are scored at once.
    rows_at_once: int = 2048


class Codebooks:
    """One set of centroids for each subspace, fitted by Lloyd's rounds."""

    def __init__(self, sample: np.ndarray, subspaces: int, codes: int = 256, rounds: int = 4):
        width = sample.shape[1]
        self.parts = [s for s in np.array_split(np.arange(width), min(subspaces, max(width, 1))) if len(s)]
        self.centres = []
        rng = np.random.default_rng(11)
        for s in self.parts:
            x = sample[:, s].astype(np.float64)
            different = np.unique(x, axis=0)
            c = rng.permutation(different)[:codes]
            for _ in range(rounds if len(different) > codes else 0):
                near = self._nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                total = np.stack([np.bincount(near, x[:, i], len(c)) for i in range(x.shape[1])], axis=1)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            self.centres.append(c)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and residual norms rounded up by more than tables of 32-bit floats can err."""
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        left, size = np.zeros(len(x)), np.zeros(len(x))
        for j, (s, c) in enumerate(zip(self.parts, self.centres, strict=True)):
            codes[:, j] = self._nearest(x[:, s], c)
            own = c[codes[:, j]]
            left += ((x[:, s] - own) ** 2).sum(1)
            size += (own * own).sum(1)
        return codes, np.sqrt(left) * (1 + 1e-6) + np.sqrt(size) * 1e-5

    def tables(self, anchors: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the inner products of its centroids (rows) with the anchors (columns)."""
        return [(c @ anchors[:, s].T).astype(np.float32) for s, c in zip(self.parts, self.centres, strict=True)]


def first_of(anchor: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` best rows of each anchor: higher scores first, then smaller ties."""
    order = np.lexsort((tie, -score, anchor))
    a = anchor[order]
    start = np.searchsorted(a, a, side="left")
    return order[np.arange(len(a)) - start < most]


class Index:
    """A block of the index in a task's memory; counts the rows it scores exactly, for tests and reports."""

    def __init__(self, rows: pa.RecordBatch, books: Codebooks, params: NegativeParams):
        col = lambda name: rows.column(rows.schema.get_field_index(name))
        self.books, self.p = books, params
        rows = rows.take(pa.array(np.argsort(col("label").to_numpy(), kind="stable")))
        self.x = matrix(col("v"), np.int64)
        self.label = col("label").to_numpy()
        self.codes = np.frombuffer(b"".join(col("code").to_pylist()), np.uint8).reshape(len(self.x), -1)
        self.residual = col("residual").to_numpy().astype(np.float32)
        self.ids, self.starts = id_lists(col("ids"))
        self.first = self.ids[self.starts[:-1]]
        self.scored = self.bounded = 0

    def intervals(self, a: np.ndarray, start: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some of the rows from start to end at once: the first one's place, lower and upper bounds of their scores (anchors by rows)."""
        tables, norm = self.books.tables(a), np.sqrt((a.astype(float) ** 2).sum(1)).astype(np.float32) * np.float32(1 + 1e-6)
        for i in range(start, end, self.p.rows_at_once):
            codes = self.codes[i : min(end, i + self.p.rows_at_once)]
            about = np.zeros((len(codes), len(a)), np.float32)
            for j, t in enumerate(tables):
                about += t[codes[:, j]]
            about = np.ascontiguousarray(about.T)
            err = norm[:, None] * self.residual[None, i : i + len(codes)] + 1
            self.bounded += about.size
            yield i, about - err, about + err

    def exact(self, a: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        self.scored += len(row)
        out = np.empty(len(row), np.int64)
        for i in range(0, len(row), 65536):
            out[i : i + 65536] = np.einsum("ij,ij->i", self.x[row[i : i + 65536]], a[anchor[i : i + 65536]])
        return out

    def best(self, a: np.ndarray, start: int, end: int, slots: int, most: int, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, row, score): the `most` best of the rows from start to end for each slot, an anchor or one of its windows.

        wanted(i, lower, upper, floor) gives, for the rows from i on, the slots, anchors and rows whose bounds leave them
        a place among the best of the slot; floor: the score that a slot's `most`-th row has reached so far.
        """
        slot, row, score = (np.empty(0, np.int64) for _ in range(3))
        floor = np.full(slots, -np.inf)
        for i, lower, upper in self.intervals(a, start, end):
            s, anchor, r = wanted(i, lower, upper, floor)
            got = self.exact(a, anchor, r + i)
            s, r, got = self.within(s, r + i, got)
            slot, row, score = np.concatenate([slot, s]), np.concatenate([row, r]), np.concatenate([score, got])
            keep = first_of(slot, score, self.first[row], most)
            slot, row, score = slot[keep], row[keep], score[keep]
            n = np.bincount(slot, minlength=slots)
            least = np.full(slots, np.inf)
            np.minimum.at(least, slot, score)
            floor = np.where(n >= most, least, -np.inf)
        return slot, row, score

    def within(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return slot, row, score


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Positives(Index):
    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        col = lambda name: queries.column(queries.schema.get_field_index(name))
        ids, label, a = id_lists(col("ids"))[0], col("label").to_numpy(), matrix(col("v"), np.int64)
        most = self.p.positives + 1  # the anchor itself is one of them

        def wanted(i, lower, upper, floor):
            anchor, row = np.nonzero(~(upper < np.maximum(floor, _kth(lower, most))[:, None]))
            return anchor, anchor, row

        found = []
        for y in np.unique(label):
            mine = np.flatnonzero(label == y)
            start, end = np.searchsorted(self.label, [y, y + 1])
            slot, row, score = self.best(a[mine], start, end, len(mine), most, wanted)
            found.append((mine[slot], row, score))
        slot, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        n = np.diff(self.starts)[row]
        flat = np.repeat(self.starts[row] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        slot, other, score = np.repeat(slot, n), self.ids[flat], np.repeat(score, n)
        keep = np.flatnonzero(other != ids[slot])
        keep = keep[first_of(slot[keep], score[keep], other[keep], self.p.positives)]
        return pa.RecordBatch.from_arrays([pa.array(ids[slot[keep]]), pa.array(other[keep]), pa.array(score[keep])], ["anchor_id", "positive_id", "positive_score"])


class Negatives(Index):
    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        col = lambda name: queries.column(queries.schema.get_field_index(name))
        ids, label, a = id_lists(col("ids"))[0], col("label").to_numpy(), matrix(col("v"), np.int64)
        positive, cuts = id_lists(col("scores"))
        windows = np.diff(cuts)
        owner = np.repeat(np.arange(len(a)), windows)
        # 100 * score >= low * positive and 100 * score <= high * positive, in whole numbers
        self.low, self.high = -(-self.p.low * positive // 100), self.p.high * positive // 100
        most = self.p.negatives

        def wanted(i, lower, upper, floor):
            other = self.label[None, i : i + lower.shape[1]] != label[:, None]
            reached = np.maximum(floor, self.low)
            for w in np.flatnonzero(np.isinf(floor)):  # nothing found yet: rows that are in the window for certain
                lo, hi = lower[owner[w]], upper[owner[w]]
                sure = np.where(other[owner[w]] & (hi <= self.high[w]) & (lo >= self.low[w]), lo, -np.inf)
                reached[w] = max(reached[w], _kth(sure[None, :], most)[0])
            least, largest = np.full(len(a), np.inf), np.full(len(a), -np.inf)
            np.minimum.at(least, owner, reached)
            np.maximum.at(largest, owner, self.high)
            anchor, row = np.nonzero(other & ~(upper < least[:, None]) & ~(lower > largest[:, None]))
            lo, hi, out = lower[anchor, row], upper[anchor, row], []
            for depth in range(int(windows.max(initial=0))):
                some = np.flatnonzero(windows[anchor] > depth)
                w = cuts[anchor[some]] + depth
                ok = ~(lo[some] > self.high[w]) & ~(hi[some] < reached[w])
                out.append((w[ok], anchor[some[ok]], row[some[ok]]))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

        slot, row, score = self.best(a, 0, len(self.x), len(positive), most, wanted)
        n = np.diff(self.starts)[row]
        flat = np.repeat(self.starts[row] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        slot, other, score = np.repeat(slot, n), self.ids[flat], np.repeat(score, n)
        keep = first_of(slot, score, other, most)
        slot = slot[keep]
        return pa.RecordBatch.from_arrays([pa.array(ids[owner[slot]]), pa.array(positive[slot]), pa.array(other[keep]), pa.array(score[keep])], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    def within(self, slot, row, score):
        ok = (score >= self.low[slot]) & (score <= self.high[slot])
        return slot[ok], row[ok], score[ok]


def prepared(vectors: DataFrame, p: NegativeParams) -> DataFrame:
    """vec_id, label and v (whole numbers, all of one length) of the rows that take part, labels moved where the rule says so."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale).cast("int"))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long"), label.alias("label"), v.alias("v"))
    return cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))


def hard_negatives(vectors: DataFrame, params: NegativeParams = NegativeParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score from vectors (vec_id, embedding, label)."""
    p = params
    rows = prepared(vectors, p)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, facts.width or 0)
    rows = rows.withColumn("v", padded("v", width))
    blocks = block_count(facts.n, rows.sparkSession.sparkContext.defaultParallelism, p.least_rows, p.most_rows)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).collect()
    books = Codebooks(np.array([r.v for r in sample], dtype=np.int64).reshape(len(sample), width), p.subspaces)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, residual = books.encode(matrix(b.column(1), np.int64))
                new = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], ["label", "v", "ids", "code", "residual"])

    # a list of the first rows needs as many ids of one vector as it is long, and one more for the anchor itself
    different = copies(rows, ["label", "v"], max(p.positives + 1, p.negatives))
    index = cut(in_arrow(different, encode, "label long, v array<int>, ids array<long>, code binary, residual double").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int")))
    none = F.array().cast("array<long>")
    index = index.withColumn("scores", none)
    anchors = rows.where(F.col("vec_id") % p.anchors_every == 0).select("label", "v", F.array("vec_id").alias("ids"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("residual"))

    found = past_blocks(index, anchors.withColumn("scores", none), blocks, lambda b: Positives(b, books, p), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = cut(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= p.positives).drop("_n"))

    windows = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    anchors = anchors.join(windows, F.col("ids")[0] == F.col("anchor_id")).drop("anchor_id")
    found = past_blocks(index, anchors, blocks, lambda b: Negatives(b, books, p), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.negatives)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
