"""Landed sources, sinks and streams; a stream gives what a batch over the same rows gives."""

import base64
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadflow.sources import landed, sinks
from leadflow.sources.snapshots import Store
from leadflow.streaming import contacts as streams


def test_directory_listings(spark):
    item = lambda i: {"item": {"@type": "LocalBusiness", "url": f"u{i}", "name": f" N{i} ", "telephone": "+79031234567, 8 903 765 43 21", "email": "A@b.ru", "sameAs": ["https://a.ru"], "address": {"streetAddress": "s", "addressLocality": "Омск"}, "geo": {"latitude": "55.1", "longitude": "x"}}}
    page = '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": [item(1), item(2), item(1)]}) + '</script><script type="application/ld+json">{broken</script>'
    got = sorted(landed.directory_listings(spark.createDataFrame([(page,), ("",), (None,)], "html string")).collect(), key=lambda r: r.source_url)
    assert [(r.source_url, r.name, r.phones, r.emails, r.lat, r.lon, r.city) for r in got][0] == ("u1", "N1", ["+79031234567", "8 903 765 43 21"], ["a@b.ru"], 55.1, None, "Омск") and len(got) == 2


def test_map_places_and_details(spark):
    body = json.dumps({"id": "7", "name": "N", "address_name": "a", "city": "Омск", "point": {"lat": 1.0, "lon": 2.0}, "contact_groups": [{"contacts": [{"type": "phone", "value": "1"}, {"type": "website", "value": "x", "url": "https://a.ru"}]}, {"contacts": [{"type": "email", "value": "A@B.ru"}, {"type": "website", "value": "https://b.ru"}]}, {}]})
    r = landed.map_places(spark.createDataFrame([(body,), ("{}",), ("bad",)], "body string")).collect()
    assert len(r) == 1 and (r[0].phones, r[0].website, r[0].emails, r[0].lat) == (["1"], "https://a.ru", ["a@b.ru"], 1.0)
    b = lambda s: base64.b64encode(s.encode()).decode()
    html = "".join(f'<a data-link="{b(u)}">' for u in ("https://t.me/x", "https://site.ru", "https://t.me/y", "https://vk.com/z"))
    d = spark.createDataFrame([(html,)], "h string").select(landed.detail_contacts(F.col("h")).alias("d")).first().d
    assert d.website == "https://site.ru" and d.messengers == {"telegram": "https://t.me/x", "vk": "https://vk.com/z"}


def test_two_scrapes(spark):
    old = spark.createDataFrame([("u1", "https://a.ru", ["+79031234567"])], "source_url string, website string, phones array<string>")
    new = spark.createDataFrame([("u1", None, []), ("u2", "a.ru/x", []), ("u3", None, ["89031234567"]), ("u4", "b.ru", ["bad"])], "source_url string, website string, phones array<string>")
    assert [r.source_url for r in landed.without_seen(new, old).collect()] == ["u4"]
    done = landed.declared_complete(spark.createDataFrame([("A",)] * 9, "city string"), spark.createDataFrame([("A", 10), ("B", 1)], "city string, declared_total long"))
    assert {r.city: r.complete for r in done.collect()} == {"A": True, "B": False}


def test_listing_source_and_mail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": "N", "phones": ["1"], "lat": 1.5}\nbroken\n\n{"name": "M"}\n')
    assert {r.name for r in landed.read_listings(spark, str(tmp_path / "a.jsonl")).collect()} == {"N", "M"}
    (tmp_path / "m.eml").write_text("From: Ann <a@x.ru>\nTo: b@x.ru\nSubject: Hi\nContent-Type: text/plain\n\nBody\n")
    r = landed.read_mail(spark, str(tmp_path / "m.eml")).first()
    assert (r.sender, r.subject, r.body.strip()) == ("Ann <a@x.ru>", "Hi", "Body")


COMPANY = "id long, name string, phones array<string>, address string, website string, emails array<string>, messengers map<string,string>, cms string, has_marquiz boolean, is_network boolean, score long, segment string, city string"


def test_exports(spark, tmp_path):
    rows = [(1, "A|b", ["1", "2"], "x", "https://a.ru", ["e@x.ru"], {"telegram": "t"}, "tilda", True, False, 50, "A", "Омск"), (2, "B", [], None, "ftp://b", [], None, None, None, None, 10, "spam", "Омск"), (3, "C", [], None, None, [], None, None, None, None, 0, None, "Омск")]
    df = spark.createDataFrame(rows, COMPANY)
    assert sorted(r.id for r in sinks.export_rows(df).collect()) == [1, 2] and sinks.export_rows(df, "telegram IS NULL").count() == 0
    first = sinks.csv_rows(df).where("id = 1").first()
    assert (first.phones, first.telegram, first.has_marquiz, first.is_network) == ("1; 2", "t", "Yes", "No")
    lines = {(r.segment, r.pos): r.line for r in sinks.markdown_lines(df).collect()}
    assert lines[("A", 1)] == "| A\\|b | 50 | 1, 2 | e@x.ru | [https://a.ru](https://a.ru) |" and lines[("D", 1)].endswith("|  |")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_markdown(df, str(tmp_path / "md"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.text(str(tmp_path / "md")).count() == 3
    raw = Store(spark, str(tmp_path / "raw"))
    landed.replace_cities(raw, df)
    landed.replace_cities(raw, df.where("id = 1").withColumn("city", F.lit("Томск")))
    landed.replace_cities(raw, df.where("id = 2"))
    assert sorted(r.id for r in raw.read("raw").collect()) == [1, 2]
    card = sinks.company_card(df, spark.createDataFrame([(5, 1, "b@x.ru", True, False), (6, 1, "a@x.ru", True, True), (7, 1, "c@x.ru", False, False)], "id long, company_id long, email string, is_active boolean, is_primary boolean"))
    assert {r.id: r.emails for r in card.collect()} == {1: ["a@x.ru", "b@x.ru"], 2: [], 3: []}
    changed = sinks.enrichment_preview(df, df.withColumn("phones", F.array_append("phones", "9")))
    assert all(r.has_changes for r in changed.collect()) and not any(r.has_changes for r in sinks.enrichment_preview(df, df).collect())
    labels = sinks.conflict_lines(spark.createDataFrame([(1, [("n", "a")] * 28)], "cluster long, records array<struct<name:string,address:string>>")).orderBy("pos").collect()
    assert [labels[i].label for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]


def test_a_hot_city_is_written_in_order_by_many_tasks(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "'n' as name", "array('1') as phones", "'a' as address", "null as website", "array() as emails", "map('telegram', 't') as messengers", "'x' as cms", "true as has_marquiz", "false as is_network", "(id * 7919) % 101 as score", "if(id % 2 = 0, 'A', 'spam') as segment", "if(id % 10 = 0, 'Tomsk', 'Omsk') as city")
    df = df.selectExpr(*(f"cast({c.strip().split(' ')[0]} as {c.strip().split(' ')[1]}) as {c.strip().split(' ')[0]}" for c in COMPANY.split(", ")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_markdown(df, str(tmp_path / "md"))
    lines = {(r.city, r.segment, r.pos): r.line for r in sinks.markdown_lines(df).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    best = {c: [(r.id, r.score) for r in sorted(df.where(F.col("city") == c).collect(), key=lambda r: (-r.score, r.id)) if r.score > 0] for c in ("Omsk", "Tomsk")}
    for city, want in best.items():
        files = sorted((tmp_path / "csv" / f"city={city}").glob("*.csv"))
        texts = [f.read_bytes().decode("utf-8") for f in files]
        assert all(t.startswith("\ufeffid,name") for t in texts) and (len(files) > 2 or city == "Tomsk")
        assert [int(line.split(",")[0]) for t in texts for line in t.splitlines()[1:]] == [i for i, _ in want]
    for (city, seg), n in {("Omsk", "A"): 1200, ("Omsk", "D"): 1500}.items():
        files = sorted((tmp_path / "md" / f"city={city}" / f"segment={seg}").glob("*.txt"))
        assert [line for f in files for line in f.read_text().splitlines()] == [lines[city, seg, i + 1] for i in range(n)]


T0 = datetime(2024, 1, 1)


def _run(spark, out, name, mode, tmp_path):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    rows = [("a", i, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 55, 70, 75, 140])] + [("b", 100, T0)]
    df = spark.createDataFrame(rows, "ip string, request_id long, at timestamp")
    batch = {r.request_id: r.admitted for r in streams.rate_limited(df, "ip", 2, 60).collect()}
    assert batch == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 100: True}
    path = str(tmp_path / "in")
    for lo in (0, 3, 6):  # files in time order
        df.where(f"request_id >= {lo} and request_id < {lo + 3 if lo < 6 else 1000}").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.request_id: r.admitted for r in _run(spark, streams.rate_limited(src, "ip", 2, 60), "limits", "append", tmp_path).collect()}
    assert got == batch


def test_funnel_in_batch_and_stream(spark, tmp_path):
    kinds = [("email", "outgoing"), ("tg", "outgoing"), ("wa", "outgoing"), ("email", "incoming")]
    rows = [(i, i % 5, T0 + timedelta(minutes=i), *kinds[(i * 7 + i // 3) % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "touch_id long, company_id long, at timestamp, channel string, direction string")
    want = {(r.company_id, r.funnel_stage, r.contact_count) for r in streams.funnel_stream(df).collect()}
    path = str(tmp_path / "in")
    for lo in (0, 20, 40):
        df.where(f"touch_id >= {lo} and touch_id < {lo + 20}").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _run(spark, streams.funnel_stream(src), "funnel", "update", tmp_path)
    last = out.groupBy("company_id").agg(F.max_by(F.struct("funnel_stage", "contact_count"), "contact_count").alias("x")).select("company_id", "x.*")
    assert {(r.company_id, r.funnel_stage, r.contact_count) for r in last.collect()} == want


def test_windows_and_duplicates_in_stream(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, "k", T0 + timedelta(minutes=10 * i)) for i in range(50)], "id long, kind string, at timestamp")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    src = spark.readStream.schema(df.schema).parquet(path)
    want = {tuple(r) for r in streams.rolling_counts(df, "kind", "2 hours", "1 hour").collect()}
    assert {tuple(r) for r in _run(spark, streams.rolling_counts(src, "kind", "2 hours", "1 hour"), "win", "complete", tmp_path).collect()} == want
    assert _run(spark, streams.deduplicated(src, "id", "1 day"), "dedup", "append", tmp_path).count() == streams.deduplicated(df, "id").count() == 7
    sends = spark.createDataFrame([(1, T0)], "tracking_id long, sent_at timestamp")
    opens = src.select(F.col("id").alias("tracking_id"), "at", F.lit("x").alias("agent"))
    assert _run(spark, streams.opens_with_sends(opens, sends), "opens", "append", tmp_path).count() == 7
