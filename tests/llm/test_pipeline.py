"""The pipeline against a plain version of its deterministic stages."""

import plain

import corpus_pipeline
from leadflow.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
            kept[name] = {r.doc_id: r.text for r in now.collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    assert kept["toxicity"] == texts
    survivors = {k for k, c in plain.components(texts).items() if k == c}
    assert set(kept["near_duplicates"]) == survivors
    for k, text in kept["pii"].items():
        assert not plain.pii_spans(text), k
    assert kept["mixing"] == kept["pii"]
    packed = now.toPandas()
    assert set(packed["doc_id"]) == survivors
    assert packed.groupby("doc_id")["n_words"].sum().to_dict() == {k: len(plain.re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in kept["mixing"].items()}


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bin", "n_words"} <= set(got.columns) and got.count() > 0
