"""Packing follows the mixture."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from leadflow.llm import mixing, packing
from leadflow.plans.lineage import cut

PACK = packing.PackParams(capacity=100, planes=4, shard_rows=80)


def _docs(spark):
    rows = [(i, " ".join([f"w{i}"] * (1 + i * 7 % 230)) if i % 50 else None, ("a", "b", None)[i % 3], "en") for i in range(900)]
    return spark.createDataFrame([*rows, (None, "x y", "a", "en")], "doc_id long, text string, source string, lang string").repartition(3)


def test_bins_ascend_with_slots_and_shards_hold_the_weights(spark):
    docs, mix = _docs(spark), mixing.MixParams(weights={"a": 700, "b": 200}, block_rows=4)
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs, mix).collect()}
    got = packing.best_fit_packing(docs, PACK, mixture=mix).toPandas()
    got["slot"] = [slot[None if k != k else int(k)] for k in got["doc_id"]]
    assert (got["shard"] == got["slot"] // 20).all() and got["shard"].nunique() > 5
    assert got.groupby("bin")["slot"].min().is_monotonic_increasing
    for _, g in got.groupby("bin"):
        assert g.sort_values("offset")["slot"].is_monotonic_increasing and g["n_words"].sum() <= 100
        assert g["offset"].tolist() and sorted(g["offset"]) == (g.sort_values(["offset", "n_words"])["n_words"].cumsum() - g.sort_values(["offset", "n_words"])["n_words"]).tolist()
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    total = got.assign(k=got["doc_id"].fillna(-1)).groupby("k")["n_words"].sum().to_dict()
    assert total == {(-1 if k is None else k): n for k, n in words.items()}
    assert got[got["piece"] == 0]["doc_id"].fillna(-1).nunique() == 901
    source = {r.doc_id: r.source for r in docs.collect()}
    first = Counter(source[int(k)] for k in got[got["shard"] == 0]["doc_id"].dropna().unique())
    assert abs(first["a"] - 56) <= 4 and abs(first["b"] - 16) <= 4


def test_weights_change_the_packed_result(spark):
    docs, said = _docs(spark), []
    for w in ({"a": 700, "b": 200}, {"a": 200, "b": 700}):
        got = packing.best_fit_packing(docs, PACK, mixture=mixing.MixParams(weights=w, block_rows=4))
        said.append({(r.doc_id, r.piece): r.bin for r in got.collect()})
    assert said[0].keys() == said[1].keys() and said[0] != said[1]


def test_the_pipeline_packs_in_the_order_of_its_mixture(spark):
    docs = spark.range(25000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"), F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("source"))
    mixed = cut(corpus_pipeline.mixing_stage(spark, docs, ""))
    slot = mixing.schedule(docs).groupBy("doc_id").agg(F.max("slot").alias("slot"))
    bins = corpus_pipeline.packing_stage(spark, mixed, "").join(slot, "doc_id").groupBy("bin").agg(F.min("slot").alias("slot")).orderBy("bin").toPandas()
    assert bins["slot"].is_monotonic_increasing and len(bins) > 5


def test_without_the_mixing_stage_the_bins_are_others(spark):
    docs = cut(spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"), F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("source")))
    mixed = cut(corpus_pipeline.mixing_stage(spark, docs, ""))
    one, two = ({(r.doc_id, r.bin) for r in corpus_pipeline.packing_stage(spark, x, "").collect()} for x in (mixed, docs))
    assert len(one) == len(two) == 6000 and one != two


def test_stored_order_is_that_of_the_files(spark):
    docs = _docs(spark).orderBy(F.col("doc_id").desc_nulls_first())
    stored = cut(docs.repartitionByRange(7, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc()))
    for rows, null_at in ((stored, 900), (docs, -1)):  # read from files, and written first
        got = packing.best_fit_packing(rows, PACK, stored=True).toPandas()
        got["at"] = [899 - int(k) if k == k else null_at for k in got["doc_id"]]
        assert got.groupby("bin")["at"].min().is_monotonic_increasing and got["doc_id"].nunique() == 900
        assert got.groupby("shard")["at"].max().is_monotonic_increasing
    assert packing.best_fit_packing(cut(docs.limit(0)), PACK, stored=True).collect() == []


def test_a_column_called_slot_stays(spark):
    got = mixing.with_slot(_docs(spark).withColumn("slot", F.lit(7)), mixing.MixParams(weights={"a": 700}, block_rows=4))
    assert got.columns[-2:] == ["slot", "slot_"] and got.select("slot").distinct().count() == 1
