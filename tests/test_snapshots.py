"""Versioned tables and mail that is applied once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadflow.sources import landed
from leadflow.sources.snapshots import Outdated, Store
from leadflow.streaming import mail

ROWS = "id long, city string, tags map<string,string>"


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_parts_are_replaced_and_old_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, "Omsk" if i % 3 else f"c/{i % 5}=x", {"a": "b"}) for i in range(60)] + [(99, None, None)], ROWS)
    assert store.manifest()["version"] == -1
    assert landed.replace_cities(store, rows) == 0
    assert _ids(store.read("raw")) == _ids(rows)
    assert store.read("raw").where("id = 1").first().tags == {"a": "b"}
    assert landed.replace_cities(store, spark.createDataFrame([(1000, "Omsk", None)], ROWS)) == 1
    assert _ids(store.read("raw")) == sorted([i for i in range(60) if i % 3 == 0] + [99, 1000])
    assert landed.replace_cities(store, rows.limit(0), ("Omsk",)) == 2
    assert _ids(store.read("raw")) == sorted([i for i in range(60) if i % 3 == 0] + [99])
    assert _ids(store.read("raw", 0)) == _ids(rows) and store.versions() == [0, 1, 2]


def test_a_large_part_is_many_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    store.replace_parts("raw", spark.range(20_000).selectExpr("id", "'one' as city"), "city")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df = store.read("raw")
    assert len(df.inputFiles()) >= 4 and df.count() == 20_000


def test_a_failed_or_late_write_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], ROWS)
    store.put({"raw": rows})
    with pytest.raises(Exception, match="no such row"):
        store.put({"raw": rows.where(F.raise_error(F.lit("no such row")).isNull())})
    assert _ids(store.read("raw")) == [1, 2] and store.versions() == [0]
    base = store.manifest()
    store.upsert("raw", spark.createDataFrame([(2, "c", None), (3, "d", None)], ROWS), "id")
    with pytest.raises(Outdated):
        store.put({"raw": rows.limit(0)}, base=base)  # made from a version that is no longer the last
    assert {(r.id, r.city) for r in store.read("raw").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def _seed(spark, path):
    store = Store(spark, path)
    t = datetime(2024, 1, 1)
    store.put({
        "logs": spark.createDataFrame([(i, i, 1, f"u{i}@x.ru", t, "sent") for i in range(1, 7)], "log_id long, company_id long, campaign_id long, email string, sent_at timestamp, status string"),
        "campaigns": spark.createDataFrame([(1, 0, 0)], "campaign_id long, total_errors long, total_replied long"),
        "contacts": spark.createDataFrame([(i, "email_sent", False, 0) for i in range(1, 7)], "company_id long, funnel_stage string, stop_automation boolean, email_replied_count long"),
        "tasks": spark.createDataFrame([(i, i, "pending", "follow_up") for i in range(1, 7)], "task_id long, company_id long, status string, task_type string"),
        "touches": spark.createDataFrame([], "company_id long, at timestamp, channel string, direction string, subject string, body string"),
    })
    return store


def _letter(i, kind):
    head = f"Date: Tue, 2 Jan 2024 10:0{i}:00 +0300\nTo: me@x.ru\nContent-Type: text/plain\n"
    if kind == "bounce":
        return f"From: MAILER-DAEMON@mx.ru\nSubject: Undelivered Mail\n{head}\nFinal-Recipient: rfc822; u{i}@x.ru\nStatus: 5.7.1\n"
    extra = "Auto-Submitted: auto-replied\n" if kind == "absence" else ""
    return f"From: Ann <U{i}@x.ru>\nSubject: Re\n{extra}{head}\nyes {i}\n"


def _state(store):
    logs = {r.log_id: r.status for r in store.read("logs").collect()}
    c = store.read("campaigns").first()
    touches = sorted((r.company_id, r.body.strip(), r.at) for r in store.read("touches").collect())
    return logs, (c.total_errors, c.total_replied), {r.company_id: (r.funnel_stage, r.stop_automation) for r in store.read("contacts").collect()}, {r.company_id: r.status for r in store.read("tasks").collect()}, touches


def test_mail_is_applied_once_over_restarts(spark, tmp_path):
    store, box = _seed(spark, str(tmp_path / "store")), tmp_path / "box"
    box.mkdir()
    for i, kind in ((1, "bounce"), (2, "reply"), (3, "absence")):
        (box / f"{i}.eml").write_text(_letter(i, kind))
    run = lambda: mail.follow_mail(store, mail.mail_stream(spark, str(box)), str(tmp_path / "check"), availableNow=True).awaitTermination(180)
    run()
    first = _state(store)
    assert first[0] == {1: "bounced", 2: "replied", 3: "sent", 4: "sent", 5: "sent", 6: "sent"} and first[1] == (1, 1)
    assert first[2][1] == ("email_sent", True) and first[2][2][0] == "replied" and first[3][2] == "cancelled"
    assert first[4] == [(2, "yes 2", datetime(2024, 1, 2, 7, 2))]
    run()  # nothing new
    assert _state(store) == first and store.versions() == [0, 1]
    # a crash between the new version and the checkpoint: the batch comes again
    batch = landed.read_mail(spark, str(box))
    assert not mail.apply_mail(store, batch, 0) and _state(store) == first
    # a crash in the middle of a batch: nothing of it is there, then all of it
    for i, kind in ((4, "reply"), (5, "bounce")):
        (box / f"{i}.eml").write_text(_letter(i, kind))
    broken = mail.mail_stream(spark, str(box)).withColumn("body", F.when(F.col("body").contains("yes 4"), F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        mail.follow_mail(store, broken, str(tmp_path / "check"), availableNow=True).awaitTermination(180)
    assert _state(store) == first
    run()
    logs, counts, *_ = _state(store)
    assert logs == {1: "bounced", 2: "replied", 3: "sent", 4: "replied", 5: "bounced", 6: "sent"} and counts == (2, 2)
