"""Campaign tables and search results on small relations."""

from datetime import datetime

from pyspark.sql import functions as F

from leadflow.operators import campaigns, search_results


def test_relevance(spark):
    rows = [
        ("https://a.ru/x", "Гранит", "Омск", None, True), ("https://a.ru/x", "Гранит", "Омск", True, False), ("https://a.ee", "Гранит", "Омск", None, False), ("https://a.ru", "Казино", "Омск", None, False),
        ("https://a.ru", "памятники в Москве", "Омск", None, False), ("https://a.com", "Гранит Омск", "Омск", None, True), ("https://a.com", "Гранит", "Омск", None, False), ("https://a.xyz", "Мемориал", "Омск", None, True),
        ("https://a.xyz", "Other", "Омск", None, False), (None, "Гранит", "Омск", None, False), ("https://a.ru", None, "Омск", None, True),
    ]
    df = spark.createDataFrame(rows, "url string, title string, city string, abroad boolean, want boolean")
    for r in df.select("*", search_results.is_relevant(F.col("url"), F.col("title"), F.col("city"), F.col("abroad")).alias("got")).collect():
        assert r.got == r.want, r


def test_result_picking(spark):
    r = spark.createDataFrame([("A", 1, "https://www.a.ru/1"), ("A", 2, "https://a.ru/2"), ("B", 3, "https://a.ru/3"), ("A", 4, "https://x.skip.ru"), ("A", 5, None)], "city string, pos int, url string")
    kept = search_results.without_skipped(r, spark.createDataFrame([("skip.ru",)], "domain string"))
    assert sorted(x.pos for x in kept.collect()) == [1, 2, 3, 5] and sorted(x.pos for x in search_results.first_of_domain(kept).collect()) == [1, 3]
    c = spark.createDataFrame([(1, "ООО Гранит Мастер")], "id long, name string")
    found = spark.createDataFrame([(1, 1, "u1", "гранит"), (1, 2, "u2", "гранит мастер"), (1, 3, "u3", "мастер гранит")], "id long, pos int, url string, title string")
    assert search_results.best_result(c, found).first().url == "u2"
    assert [search_results.next_delay(x, s) for x, s in ((2.0, 429), (100.0, 429), (3.0, 200), (100.0, 200))] == [4.0, 120.0, 2.0, 50.0]


def test_progress_and_tasks(spark):
    rows = [("completed", 5, 3, 9, 5), ("completed", 0, 3, 9, 3), ("running", 0, 3, 9, 9), ("running", 0, 0, 9, 0), ("draft", None, None, None, 0), ("paused", 7, 1, 9, 7)]
    df = spark.createDataFrame(rows, "status string, n long, s long, l long, want long")
    assert all(r.got == r.want for r in df.select("*", campaigns.progress_total(F.col("status"), F.col("n"), F.col("s"), F.col("l")).alias("got")).collect())
    now = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, 1, now, now), (2, 2, now, now), (3, None, None, now), (4, 1, None, now)], "task_id long, company_id long, due_at timestamp, created_at timestamp")
    companies = spark.createDataFrame([(1, "A", None), (2, "B", now)], "id long, name string, deleted_at timestamp")
    assert [r.task_id for r in campaigns.task_list(tasks, companies).collect()] == [1, 4]
    assert [r.task_id for r in campaigns.task_list(tasks, companies, include_unlinked=True).collect()] == [1, 3, 4]


def test_last_status_puts_unsent_logs_last(spark):
    logs = spark.createDataFrame([(1, 1, 1, "A@x.ru", datetime(2024, 1, 2), "opened"), (2, 1, 1, "a@x.ru", None, "failed"), (3, 1, 1, "a@x.ru", datetime(2024, 1, 1), "sent")], "log_id long, campaign_id long, company_id long, email string, sent_at timestamp, status string")
    r = spark.createDataFrame([(1, 1, "a@x.ru"), (1, 2, "b@x.ru")], "campaign_id long, company_id long, email string")
    c = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    assert {x.company_id: x.status for x in campaigns.recipient_status(r, c, logs).collect()} == {1: "opened", 2: None}


def test_value_lists(spark):
    df = spark.createDataFrame([("a", ["x", ""]), ("", ["y"]), (None, None)], "c string, l array<string>")
    assert {r.value for r in campaigns.values_of(df, "c").collect()} == {"a"} and {r.value for r in campaigns.values_of(df, "l").collect()} == {"x", "y"}
    assert {r.value for r in campaigns.values_of(df.where("c = ''"), "c", df).collect()} == {"a"}
