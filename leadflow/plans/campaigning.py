"""Queries: campaign tables, task lists, search results, value lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators import campaigns, networks, search_results
from leadflow.plans.registry import COMPANIES, EVENTS, query
from leadflow.plans.textual import _NET_SQL
from leadflow.plans.views import companies, events, geography, table, touches

_LOG_SQL = "lg AS (SELECT event_id AS log_id, k % 4 AS campaign_id, company_id, 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' AS email, CASE WHEN k % 9 <> 0 THEN tm END AS sent_at, CASE kind WHEN 'view' THEN 'opened' WHEN 'click' THEN 'replied' WHEN 'error' THEN 'bounced' WHEN 'signup' THEN 'failed' ELSE 'sent' END AS status FROM ev)"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as message logs: campaign, company, address, time and status."""
    k, c = F.col("k"), F.col("company_id")
    email = F.concat(F.lit("info"), (c % 50).cast("string"), F.lit("@site"), (c % 97).cast("string"), F.lit(".ru"))
    status = F.when(F.col("kind") == "view", "opened").when(F.col("kind") == "click", "replied").when(F.col("kind") == "error", "bounced").when(F.col("kind") == "signup", "failed").otherwise("sent")
    return events(spark, d).select(F.col("event_id").alias("log_id"), (k % 4).alias("campaign_id"), "company_id", email.alias("email"), F.when(k % 9 != 0, F.col("at")).alias("sent_at"), status.alias("status"))


@query(f"""WITH {COMPANIES}, {EVENTS}, {_LOG_SQL}, r AS (SELECT id % 4 AS campaign_id, id AS company_id, emails[1] AS email FROM companies WHERE len(emails) > 0),
l AS (SELECT campaign_id, company_id, email, status FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, company_id, lower(email) ORDER BY sent_at DESC NULLS LAST, log_id DESC) AS n FROM lg) WHERE n = 1)
SELECT r.campaign_id, r.company_id, r.email, c.name, l.status FROM r JOIN companies c ON c.id = r.company_id LEFT JOIN l ON l.campaign_id = r.campaign_id AND l.company_id = r.company_id AND lower(l.email) = lower(r.email)""")
def recipient_status(spark: SparkSession, d: str) -> DataFrame:
    """M8."""
    c = companies(spark, d)
    r = c.where(F.size("emails") > 0).select((F.col("id") % 4).alias("campaign_id"), F.col("id").alias("company_id"), F.get("emails", F.lit(0)).alias("email"))
    return campaigns.recipient_status(r, c, _logs(spark, d)).select("campaign_id", "company_id", "email", "name", "status")


@query(f"""WITH {COMPANIES}, {EVENTS}, {_LOG_SQL}, e AS (SELECT DISTINCT lower(unnest(emails)) AS email FROM companies WHERE id % 3 = 0 OR id % 7 = 1),
o AS (SELECT email, min(id) AS company_id FROM (SELECT lower(unnest(emails)) AS email, id FROM companies WHERE NOT deleted) GROUP BY email),
t AS (SELECT e.email, CASE WHEN e.email LIKE 'info1@%' THEN 'disabled' WHEN e.email IN (SELECT lower(email) FROM lg WHERE status <> 'failed') THEN 'already_mailed' WHEN e.email LIKE 'user%' THEN 'in_campaign' END AS reason, o.company_id FROM e LEFT JOIN o USING (email))
SELECT email, CASE WHEN reason IS NULL THEN coalesce(company_id, 0) END::BIGINT AS company_id, reason FROM t""")
def network_recipients(spark: SparkSession, d: str) -> DataFrame:
    """M6, J17."""
    c = companies(spark, d)
    every = c.select("id", F.explode("emails").alias("email"))
    owners = c.where("not deleted").select(F.col("id").alias("company_id"), "emails")
    return campaigns.network_recipients(every.where("id % 3 = 0 or id % 7 = 1"), every.where("email like 'info1@%'"), _logs(spark, d), every.where("email like 'user%'"), owners)


@query(f"""WITH {COMPANIES}, t AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS company_id, CASE WHEN o_orderkey % 6 <> 1 THEN o_orderdate END AS due_at FROM orders WHERE o_orderstatus = 'O')
SELECT task_id, company_id, name FROM t LEFT JOIN companies ON companies.id = t.company_id WHERE company_id IS NOT NULL AND NOT coalesce(deleted, FALSE)""")
def task_list(spark: SparkSession, d: str) -> DataFrame:
    """F21, J5, S2."""
    t = touches(spark, d).where("status = 'O'")
    t = t.select(F.col("touch_id").alias("task_id"), F.when(F.col("touch_id") % 10 != 0, F.col("company_id")).alias("company_id"), F.when(F.col("touch_id") % 6 != 1, F.col("at")).alias("due_at"), F.col("at").alias("created_at"), "status")
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("2024-01-01").cast("timestamp")))
    return campaigns.task_list(t, c, status="O").select("task_id", "company_id", "name")


@query(f"""WITH {EVENTS}, {_LOG_SQL}, c AS (SELECT unnest(range(0, 5)) AS campaign_id), n AS (SELECT campaign_id, count_if(status = 'replied') AS r, count_if(status = 'bounced') AS b, count_if(status <> 'failed') AS s FROM lg GROUP BY campaign_id)
SELECT c.campaign_id, coalesce(r, 0)::BIGINT AS total_replied, greatest(c.campaign_id * 100, coalesce(b, 0))::BIGINT AS total_errors, greatest(0, coalesce(s, 0))::BIGINT AS total_recipients FROM c LEFT JOIN n USING (campaign_id)""")
def recounted_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    c = spark.range(5).select(F.col("id").alias("campaign_id"), F.lit(7).cast("long").alias("total_replied"), (F.col("id") * 100).alias("total_errors"), F.lit(None).cast("long").alias("total_recipients"))
    return campaigns.recount(c, _logs(spark, d))


@query(f"""WITH {_NET_SQL}, {EVENTS}, {_LOG_SQL}, s AS (SELECT lower(email) AS e, count(*) AS n FROM lg WHERE status <> 'failed' GROUP BY 1), g AS (SELECT key, count(*)::BIGINT AS company_count FROM mem GROUP BY key HAVING count(*) >= 5),
x AS (SELECT key, sum(n) AS n FROM (SELECT DISTINCT mem.key, unnest(emails) AS e FROM mem JOIN live USING (id)) JOIN s USING (e) GROUP BY key)
SELECT g.key AS base_domain, company_count, coalesce(n, 0)::BIGINT AS sent_count, CASE WHEN coalesce(n, 0) > 0 THEN 'sent' ELSE 'none' END AS contact_status FROM g LEFT JOIN x USING (key)""")
def network_list(spark: SparkSession, d: str) -> DataFrame:
    """N3, A13."""
    live = companies(spark, d).where("not deleted")
    t = networks.network_table(live, networks.detect_networks(live))
    return campaigns.network_list(t, _logs(spark, d), 5).select("base_domain", "company_count", "sent_count", "contact_status")


@query(f"WITH {COMPANIES} SELECT 'cms' AS of, cms AS value FROM companies WHERE cms <> 'unknown' GROUP BY cms UNION ALL SELECT 'region', region FROM companies GROUP BY region UNION ALL SELECT 'email', e FROM (SELECT DISTINCT unnest(emails) AS e FROM companies)")
def value_lists(spark: SparkSession, d: str) -> DataFrame:
    """A36."""
    c = companies(spark, d)
    one = lambda name, column, *skip: campaigns.values_of(c, column, None, ("", *skip)).select(F.lit(name).alias("of"), "value")
    return one("cms", "cms", "unknown").union(one("region", "region")).union(one("email", "emails"))


@query(f"""WITH {COMPANIES}, r AS (SELECT n_name AS city, count(*)::BIGINT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), k AS (SELECT city, count(*)::BIGINT AS n FROM companies GROUP BY 1)
SELECT r_name AS region, n_name AS city, coalesce(r.n, 0)::BIGINT AS n_raw, coalesce(k.n, 0)::BIGINT AS n_companies, coalesce(k.n, 0) > 0 AS populated FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN r ON r.city = n_name LEFT JOIN k ON k.city = n_name""")
def city_status(spark: SparkSession, d: str) -> DataFrame:
    """A39, F28."""
    geo = geography(spark, d)
    raw = table(spark, d, "supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("nation_key")).select("city")
    return campaigns.city_status(geo.select("region", F.col("city").alias("name")), raw, companies(spark, d))


@query(f"WITH {COMPANIES} SELECT id FROM companies WHERE (telegram IS NULL AND whatsapp IS NULL AND len(emails) = 0 AND coalesce(score, 0) < 50)")
def reverse_lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F22."""
    return search_results.needs_contacts(companies(spark, d), 50).select("id")


@query("""WITH r AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'Гранит мастерская Омск' WHEN 1 THEN 'Казино онлайн' WHEN 2 THEN 'Памятники в Москве' ELSE 'Мемориал Тула' END AS title, row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') ORDER BY page_id) AS n FROM pages WHERE page_id % 4 = 0)
SELECT page_id FROM r WHERE n = 1 AND NOT regexp_matches(url, '://([^/]*\\.)?spam-farm\\.example\\.org')""")
def relevant_results(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, F14, F15: relevant results, skipped domains apart, one a domain."""
    title = F.when(F.col("page_id") % 4 == 0, "Гранит мастерская Омск").when(F.col("page_id") % 4 == 1, "Казино онлайн").when(F.col("page_id") % 4 == 2, "Памятники в Москве").otherwise("Мемориал Тула")
    r = table(spark, d, "pages").select("page_id", "url", title.alias("title"), F.lit("Омск").alias("city"), F.col("page_id").alias("pos"))
    r = search_results.without_skipped(r, spark.createDataFrame([("spam-farm.example.org",)], "domain string"))
    return search_results.first_of_domain(r.where(search_results.is_relevant(F.col("url"), F.col("title"), F.col("city")))).select("page_id")
