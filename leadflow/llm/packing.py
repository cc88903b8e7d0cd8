"""Best-fit packing with conflicts: residual-ordered bins that carry source and duplicate-cluster bitmaps.

Documents go into bins of fixed capacity (words), longest first. Open bins are ordered by what is left in them; the
search begins at the smallest residual that holds the piece and goes on to the next until a bin is compatible, so the
tightest compatible bin is taken; stretches of bins that all conflict are passed over at once. A bin's bitmaps hold the duplicate clusters in it (never two of one cluster) and, in
`planes` layers, its sources (never more than `planes` of one source).

A document longer than a bin fills whole bins of its own; what remains of it is packed as a piece. Rows are dealt by
hash, of their place in the input too, into shards of about shard_rows rows, each packed for itself, so copies that
may hold a third of all rows spread over all shards; only ids, lengths, sources and clusters are shuffled. Bins of a shard left open stay open: at most one bin in planes * capacity is lost to a shard's end.

With a mixture, a shard is a range of its slots instead, so that shards follow the order of the mixture and each holds
the sources in its proportions; bins of a shard are numbered by their first slot, pieces of a bin lie in slot order.
With stored=True the order is that in which the rows lie in their files, as whoever wrote them has left it: file by file
by name, row by row. A row's place is its number in its file and the rows of the files before, so nothing is sorted or
numbered again. Rows that do not come straight from files are written first.

Defined cases: a text without words (or null) takes one bin place of length 0; null sources count as one source; a
null cluster conflicts with nothing; repeated rows share a cluster and so never a bin; equally tight bins: the one
opened first; equally long pieces: by id, then cluster; a null id is a row like others, last among equals; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import SPACE, cut, lower_ascii
from leadflow.llm.mixing import MixParams, with_slot
from leadflow.plans.lineage import skew_join


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048
    planes: int = 4
    shard_rows: int = 2000
    seed: int = 13


def word_count(text: Column) -> Column:
    """Words of a text, in the JVM: runs of anything but ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


class OpenBins:
    """Open bins of a shard by what is left in them: a tree over residuals whose nodes hold what all bins below share.

    A bin's mask has a bit for each cluster in it and for each source that is full in it. A node's mask is the
    conjunction of the masks below, so a subtree in which every bin conflicts with a piece is passed over in one step, and
    the search for the tightest compatible bin goes on to the next larger residual only where one may be.
    """

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.node = [-1] * (2 * self.size)  # -1: no bin below, every bit set
        self.at: dict[int, dict[int, int]] = {}  # residual -> bin -> mask, bins in order of opening

    def put(self, left: int, b: int, mask: int) -> None:
        bins = self.at.setdefault(left, {})
        last = next(reversed(bins), -1)
        bins[b] = mask
        if b < last:
            self.at[left] = dict(sorted(bins.items()))
        i = left + self.size
        while i:
            self.node[i] &= mask
            i >>= 1

    def take(self, left: int, b: int) -> int:
        """Remove a bin and give its mask."""
        bins = self.at[left]
        mask, all_ = bins.pop(b), -1
        for m in bins.values():
            all_ &= m
        i = left + self.size
        self.node[i] = all_
        while i > 1:
            i >>= 1
            self.node[i] = self.node[2 * i] & self.node[2 * i + 1]
        return mask

    def tightest(self, least: int, conflicts: int) -> tuple[int, int] | None:
        """(left, bin) of the compatible bin with the smallest residual of at least `least`, the one opened first among equals."""
        return self._search(1, 0, self.size, least, conflicts)

    def _search(self, i: int, low: int, width: int, least: int, conflicts: int) -> tuple[int, int] | None:
        if low + width <= least or self.node[i] & conflicts or self.node[i] == -1:
            return None
        if width == 1:
            return next(((low, b) for b, m in self.at[low].items() if not m & conflicts), None)
        half = width // 2
        return self._search(2 * i, low, half, least, conflicts) or self._search(2 * i + 1, low + half, half, least, conflicts)


def pack_shard(sizes: list[int], sources: list[str], clusters: list[int | None], capacity: int, planes: int) -> list[int]:
    """The bin of each piece, bins numbered from 0 in order of opening; pieces are placed in the order given."""
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(_repeated(clusters)))}  # a cluster met once needs no bit
    source_bit = {s: 1 << (i + len(cluster_bit)) for i, s in enumerate(dict.fromkeys(sources))}
    bins, layers, out = OpenBins(capacity), [], []  # layers: of each bin, `planes` source bitmaps
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        sb, cb = source_bit[s], cluster_bit.get(c, 0)
        found = bins.tightest(n, sb | cb)
        if found:
            left, b = found
            mask = bins.take(left, b)
        else:
            left, b, mask = capacity, len(layers), 0
            layers.append([0] * planes)
        for k in range(planes):
            if not layers[b][k] & sb:
                layers[b][k] |= sb
                break
        if left > n or not n:
            bins.put(left - n, b, mask | cb | (layers[b][-1] & sb))
        out.append(b)
    return out


def _repeated(values: list) -> set:
    seen, twice = set(), set()
    for v in values:
        if v is not None:
            (twice if v in seen else seen).add(v)
    return twice


def _in_files(docs: DataFrame) -> DataFrame:
    """docs with where each row lies: _file and _row; written first if it is no plain read of files."""
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    try:
        return docs.select(*columns, *where)
    except AnalysisException:
        return cut(docs).select(*columns, *where)


def _stored_order(rows: DataFrame) -> DataFrame:
    """rows (with _file and _row) with _order, their place among all rows; parts of a write are numbered in its order."""
    part = F.coalesce(F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    files = rows.groupBy("_file").agg(F.max("_row").alias("_last")).withColumn("_n", F.col("_last") + 1).select("_file", "_n", part.alias("_part"))
    before = F.sum("_n").over(Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(files.select("_file", F.coalesce(before, F.lit(0)).alias("_before")), "_file").withColumn("_order", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def best_fit_packing(docs: DataFrame, p: PackParams = PackParams(), cluster: Column | None = None, mixture: MixParams | None = None, members: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """doc_id, piece, n_words, shard, bin (unique over shards) and offset in the bin, for each piece of each row of docs.

    cluster: a long that near or exact copies share; by default a hash of the text with A-Z lower-cased. mixture: bins
    ascend in the order of this mixture of the rows; stored: in the order of the rows in their files. members: doc_id and
    component_id of near copies, which take the place of cluster for all rows with an id.
    """
    cluster = F.when(F.length("text") > 0, F.xxhash64(lower_ascii(F.col("text")))) if cluster is None else cluster
    where = [F.col("_file"), F.col("_row")] if stored else []
    rows = (_in_files(docs) if stored else docs).select("doc_id", word_count(F.col("text")).alias("n"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), F.monotonically_increasing_id().alias("place"), *where)
    if members is not None:
        near = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_near"))
        rows = skew_join(rows, near, "doc_id", "place", "left").withColumn("cluster", F.coalesce("_near", "cluster")).drop("_near")
    if stored:
        rows = _stored_order(rows).withColumn("shard", F.floor(F.col("_order") / p.shard_rows).cast("int"))
    elif mixture is not None:
        shard_slots = max(1, p.shard_rows // mixture.block_rows)
        rows = with_slot(rows, mixture, "_order").withColumn("shard", F.floor(F.col("_order") / shard_slots).cast("int"))
    else:
        rows = _dealt(rows, docs.select("doc_id").count(), p)
    return _packed(rows, p, stored or mixture is not None)


def pack_counted(rows: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """What best_fit_packing gives, for rows whose words are counted: doc_id, n, source (string), cluster and place (a long of each row's own)."""
    return _packed(_dealt(rows, rows.count(), p), p, False)


def _dealt(rows: DataFrame, n: int, p: PackParams) -> DataFrame:
    """rows with the shard to which each goes by hash; n: their number."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("place", "doc_id", "n", F.lit(p.seed)), F.lit(max(1, -(-n // p.shard_rows)))).cast("int"))


def _packed(rows: DataFrame, p: PackParams, ordered: bool) -> DataFrame:
    """Each shard of rows packed for itself; ordered: by _order."""
    rows = rows.withColumn("source", F.coalesce("source", F.lit("\0")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        part = part.sort_values(["n", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        full = part["n"] // p.capacity
        rest = part["n"] - full * p.capacity
        # the rest of a long document, or the whole of a short one, is what gets packed
        packed = part.assign(piece=full, size=rest).loc[(rest > 0) | (full == 0)].sort_values("size", ascending=False, kind="stable")
        clusters = [None if pd.isna(c) else int(c) for c in packed["cluster"]]
        bins = pack_shard(packed["size"].tolist(), packed["source"].tolist(), clusters, p.capacity, p.planes)
        packed = packed.assign(bin=bins)
        if ordered:
            packed = packed.sort_values(["_order", "doc_id", "n", "cluster"], kind="stable")
        packed["offset"] = packed.groupby("bin")["size"].cumsum() - packed["size"]
        long = part.loc[full.index[full > 0]].assign(times=full[full > 0])
        long = long.loc[long.index.repeat(long["times"])]
        long = long.assign(piece=long.groupby(level=0).cumcount(), size=p.capacity, offset=0)
        long["bin"] = range(len(set(bins)), len(set(bins)) + len(long))
        out = pd.concat([packed, long])
        if ordered:
            out = out.sort_values(["_order", "doc_id", "n", "cluster", "piece"], kind="stable")
            out["bin"] = pd.factorize(out["bin"])[0]  # bins by their first place
        return pd.DataFrame({"doc_id": out["doc_id"], "piece": out["piece"].astype("int64"), "n_words": out["size"].astype("int64"), "shard": shard, "bin": out["bin"].astype("int64") + (shard << 32), "offset": out["offset"].astype("int64")})

    return rows.groupBy("shard").applyInPandas(pack, "doc_id long, piece long, n_words long, shard int, bin long, offset long")
