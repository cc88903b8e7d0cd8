"""Base relation, dealt joins, sinks and progress on small relations."""

import glob
import re
import time

from pyspark.sql import functions as F

from leadflow.operators import base, relations
from leadflow.plans.lineage import CLEANUP, cut, drop_tables, forget, noted, shared_dir, skew_join
from leadflow.sources import sinks
from leadflow.streaming.progress import Progress


def test_skew_join_equals_a_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 700).alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (5, "z"), (None, "n"), (9999, "w")], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(map(str, skew_join(left, right, "k", "id", how).select("k", "id", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))
    assert skew_join(left.limit(0), right, "k", "id").collect() == []


def test_signal_groups_keep_hubs(spark):
    rows = [(i, "hub") for i in range(50)] + [(1, "s"), (2, "s"), (2, "s"), (3, "alone"), (4, None), (None, "s")]
    got = relations.signal_groups(spark.createDataFrame(rows, "e long, s string"), "e", "s").collect()
    assert {(r.e, r.first, r.n) for r in got if r.s == "hub"} == {(i, 0, 50) for i in range(50)}
    assert {(r.e, r.first, r.n) for r in got if r.s != "hub"} == {(1, 1, 2), (2, 1, 2)}


def test_base_projections(spark):
    df = spark.createDataFrame([(1, None, None, "x", None)], "id long, phones array<string>, messengers map<string,string>, name string, merged_into long")
    r = base.with_empties(df).first()
    assert (r.phones, r.messengers, r.name) == ([], {}, "x")
    assert base.listing(df, "snapshot").columns == ["id", "name", "phones", "messengers"]
    assert base.live(df).count() == 1 and base.live(df.withColumn("merged_into", F.lit(3))).count() == 0
    off = spark.createDataFrame([("b", False), ("c", None), ("z", False)], "source string, enabled boolean")
    assert [r.source for r in base.active_sources(off, ("c", "b", "a")).collect()] == ["c", "a"]


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", blocks.getAllBlocks().mkString(" ")))
    before, set_to = shuffles(), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    assert cut(df).count() == 10 and df.count() == 10 and cut(df).count() == 10
    assert spark.conf.get(CLEANUP, None) == set_to
    written = cut(df.repartition(3))
    for _ in range(50):
        if len(shuffles() - before) <= 4:  # what count() made stays until the driver's garbage is collected
            break
        time.sleep(0.1)
    assert len(shuffles() - before) <= 4 and written.count() == 10


def test_network_details_hold_every_company(spark):
    c = spark.createDataFrame([(i, f"n{i}", f"c{i % 12}", None if i % 2 else i, "x" if i == 5 else None) for i in range(40)], "id long, name string, city string, score long, deleted_at string")
    nets = spark.createDataFrame([("a", ["m@a"]), ("b", [])], "base_domain string, emails array<string>")
    members = c.select(F.lit("a").alias("key"), "id").repartition(4)
    logs = spark.createDataFrame([("M@a", "sent")], "email string, status string")
    got = {r.base_domain: r for r in base.network_detail(nets, members, c, logs).collect()}
    live = [i for i in range(40) if i != 5]
    assert got["a"].live_count == 39 and got["a"].ids == live and got["b"].ids is None and got["b"].live_count == 0
    assert [tuple(x) for x in got["a"].companies] == [(i, f"n{i}", f"c{i % 12}", 0 if i % 2 else i) for i in live]
    assert len(got["a"].top_cities) == 10 and got["a"].sent_count == 1


def test_files_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 10)
    df = spark.range(35).select("id", F.lit("city").alias("city"), (F.col("id") % 7).alias("score"))
    sinks.write_report(df, str(tmp_path / "r"))
    assert all(sum(1 for _ in open(f)) <= 10 for f in glob.glob(f"{tmp_path}/r/*.json"))
    sinks.write_registry(spark.createDataFrame([("A.ru", c) for c in "xyz"] + [("b.ru", "x")], "domain string, city string"), str(tmp_path / "reg"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "reg")).collect()] == [("a.ru", 3)]


def test_progress_of_a_stream(spark, tmp_path):
    seen = Progress()
    spark.streams.addListener(seen)
    spark.range(5).write.json(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").json(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).queryName("q").trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(50):
        if any(e["event"] == "finished" for e in seen.events):
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert {"started", "progress", "finished"} <= {e["event"] for e in seen.events}
    assert sum(e.get("rows", 0) for e in seen.events) == 5


def test_forget_deletes_what_was_cut(spark):
    at = f"{shared_dir(spark)}/leadflow-{spark.sparkContext.applicationId}"
    cut(spark.range(3))
    assert glob.glob(f"{at}/*.parquet")
    forget(spark)
    assert not glob.glob(f"{at}/*")


def test_noted_tables_are_dropped_but_for_those_that_are_read(spark):
    outside = cut(spark.range(2))
    with noted() as made:
        one, two = cut(spark.range(3)), cut(spark.range(4))
    assert len(made) == 2
    kept = two.where("id > 0")
    drop_tables(made, kept)
    assert kept.count() == 3 and outside.count() == 2 and len(made) == 1
    assert not glob.glob(one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
