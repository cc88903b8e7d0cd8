"""Queries: base relation and its pages, previews, event effects, clean-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions import cities, names
from leadflow.functions.urls import is_safe_url
from leadflow.functions.values import PROFILE_WORDS
from leadflow.operators import base, company_query, crm, effects
from leadflow.operators.company_query import CompanyQuery
from leadflow.plans.contacts import _CONTACT_SQL, _contacts
from leadflow.plans.registry import COMPANIES, EVENTS, LEADS, query
from leadflow.plans.views import companies, events, last_time, table

s = lambda c: c.cast("string")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """companies with deleted_at and merged_into, what is known of two thirds of them, and contacts of those with events."""
    c = companies(spark, d)
    own = c.select("id", "name", "city", "region", "emails", F.when(F.col("deleted"), F.lit("x")).alias("deleted_at"), F.when(F.col("id") % 19 == 0, F.col("id") - 1).alias("merged_into"))
    known = c.where("id % 3 <> 0").select("id", "name", "segment", "score", "messengers", (F.col("id") % 4).alias("trust_score"))
    state = events(spark, d).groupBy("company_id").agg(F.count("*").alias("contact_count"))
    return own, known, state


_PARTS_SQL = f"""{COMPANIES}, {EVENTS}, own AS (SELECT id, name, city, region, emails, deleted, id % 19 = 0 AS merged FROM companies),
known AS (SELECT id, segment, score, telegram, whatsapp, id % 4 AS trust_score FROM companies WHERE id % 3 <> 0), state AS (SELECT company_id AS id, count(*)::BIGINT AS contact_count FROM ev GROUP BY company_id)"""


@query(f"WITH {_PARTS_SQL} SELECT id, name, segment, score, contact_count FROM own LEFT JOIN known USING (id) LEFT JOIN state USING (id) WHERE NOT deleted AND NOT merged")
def base_relation(spark: SparkSession, d: str) -> DataFrame:
    """Live companies with what is known of them and their contact, where there is one."""
    own, known, state = _parts(spark, d)
    return base.base_relation(base.live(own), known, state).select("id", "name", "segment", "score", "contact_count")


@query(f"WITH {_PARTS_SQL} SELECT id, segment, score, contact_count FROM own LEFT JOIN known USING (id) JOIN state USING (id)")
def contacted_relation(spark: SparkSession, d: str) -> DataFrame:
    """Companies that have a contact."""
    return base.base_relation(*_parts(spark, d), with_contact=True).select("id", "segment", "score", "contact_count")


@query(f"WITH {_PARTS_SQL} SELECT count(*)::BIGINT AS n, count_if(telegram IS NOT NULL)::BIGINT AS has_tg, count_if(trust_score >= 2)::BIGINT AS tg_live, count_if(trust_score = 0 AND telegram IS NOT NULL)::BIGINT AS tg_dead FROM known JOIN own USING (id) WHERE NOT deleted AND NOT merged")
def trust_counts(spark: SparkSession, d: str) -> DataFrame:
    """A26, J3."""
    own, known, _ = _parts(spark, d)
    return base.enriched_of_live(own, known).agg(F.count("*").alias("n"), *base.trust_stats(known))


@query(f"WITH {COMPANIES}, f AS (SELECT *, count(*) OVER () AS total FROM companies WHERE NOT deleted AND NOT is_network AND city IN ('NATION_1', 'NATION_2', 'NATION_3') AND segment <> 'spam') SELECT id, name, city, score, total::BIGINT AS total FROM f ORDER BY city, id LIMIT 30 OFFSET 30")
def search_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of a search by city, and how many rows the search has."""
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x"))).withColumn("network_id", F.when(F.col("is_network"), F.col("id")))
    q = CompanyQuery(cities=("NATION_1", "NATION_2", "NATION_3", " "), is_network=False, sort="city")
    return base.page_with_total(company_query.search(c, q), [F.col("city"), F.col("id")], 2, 30).select("id", "name", "city", "score", "total")


@query(f"WITH {COMPANIES}, {EVENTS}, a AS (SELECT DISTINCT company_id AS id FROM ev WHERE kind = 'click') SELECT id, region FROM companies LEFT JOIN (SELECT id, TRUE AS act FROM a) USING (id) WHERE region = 'ASIA' AND len(emails) = 0 AND act IS NULL AND id % 5 >= 1 AND id % 5 <= 3 AND CASE WHEN id % 9 = 0 THEN 'spam' ELSE segment END = 'spam'")
def search_spam_without_mail(spark: SparkSession, d: str) -> DataFrame:
    """Only spam, by trust and region, without any active address."""
    c = companies(spark, d).withColumn("segment", F.when(F.col("id") % 9 == 0, "spam").otherwise(F.col("segment"))).withColumn("trust_score", F.col("id") % 5)
    mails = events(spark, d).where("kind = 'click'").select("company_id", F.lit(True).alias("is_active"))
    q = CompanyQuery(spam=2, region="ASIA", trust=(1, 3), has_email=False)
    return company_query.search(company_query.with_active_email(c, mails), q).select("id", "region")


@query(f"WITH {COMPANIES}, {EVENTS}, r AS (SELECT DISTINCT CASE WHEN k % 10 = 0 THEN company_id + 1 ELSE company_id END AS id FROM ev WHERE kind = 'purchase') SELECT id, 'raw' AS by_what FROM companies JOIN r USING (id) UNION ALL SELECT id, 'own' FROM companies WHERE id % 4 = 1")
def companies_of_source(spark: SparkSession, d: str) -> DataFrame:
    """by the companies' own sources, and by raw rows where no company has any."""
    c = companies(spark, d).select("id", F.when(F.col("id") % 4 == 1, F.array(F.lit("maps"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    none = c.withColumn("sources", F.array().cast("array<string>"))
    raw = events(spark, d).select(F.col("company_id").alias("id"), F.when(F.col("k") % 10 == 0, F.col("company_id") + 1).alias("merged_into"), F.when(F.col("kind") == "purchase", "maps").otherwise("web").alias("source"))
    by = lambda rows, name: company_query.find(rows, CompanyQuery(source="maps", spam=1), raw=raw, sources=("maps", "web")).select("id", F.lit(name).alias("by_what"))
    return by(none, "raw").union(by(c, "own"))


@query(f"WITH {COMPANIES}, {EVENTS} SELECT id, name FROM companies WHERE len(list_filter(emails, lambda e: contains(lower(e), 'user1'))) > 0 OR id IN (SELECT company_id FROM ev WHERE kind = 'signup' AND k BETWEEN 10 AND 19)")
def search_by_address(spark: SparkSession, d: str) -> DataFrame:
    """the text may stand in a company's own list or among the addresses kept apart."""
    mails = events(spark, d).where("kind = 'signup'").select("company_id", F.concat(F.lit("User"), s(F.col("k")), F.lit("@kept.ru")).alias("email"))
    mails = mails.where(F.length("email") == 14)
    return company_query.find(companies(spark, d), CompanyQuery(search="user1", field="email"), mails).select("id", "name")


@query(f"""WITH {COMPANIES}, {EVENTS}, m AS (SELECT DISTINCT company_id AS id FROM ev WHERE kind = 'signup' AND k BETWEEN 30 AND 39), r AS (SELECT DISTINCT company_id AS id FROM ev WHERE kind IN ('view', 'click')),
f AS (SELECT *, count(*) OVER () AS total FROM companies WHERE NOT deleted AND region IN ('ASIA', 'REGION_1', 'EUROPE', 'AMERICA', 'AFRICA') AND score >= 5 AND id IN (SELECT id FROM r)
  AND (contains(lower(name), '3') OR contains(lower(coalesce(website, '')), '3') OR len(list_filter(phones, lambda p: contains(replace(p, '+', ''), '3'))) > 0 OR len(list_filter(emails, lambda e: contains(lower(e), '3'))) > 0 OR id IN (SELECT id FROM m)))
SELECT id, name, score, total::BIGINT AS total FROM f ORDER BY score DESC, id LIMIT 10 OFFSET 10""")
def company_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """One search over names, sites, phones, own and separate addresses, sources from raw rows, a page and its total."""
    mails = events(spark, d).where("kind = 'signup'").select("company_id", F.concat(F.lit("Box"), F.lpad(s(F.col("k")), 3, "0"), F.lit("@kept.ru")).alias("email")).where("email like 'Box03%'")
    raw = events(spark, d).select(F.col("company_id").alias("id"), F.lit(None).cast("long").alias("merged_into"), F.when(F.col("kind").isin("view", "click"), "yell").otherwise("avito").alias("source"))
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x"))).withColumn("sources", F.array().cast("array<string>"))
    c = c.where(F.col("region").isin("ASIA", "REGION_1", "EUROPE", "AMERICA", "AFRICA"))
    q = CompanyQuery(search=" 3 ", source="yell", score=(5, None), sort="score", descending=True, page=2, per_page=10)
    return company_query.find_page(c, q, mails, raw).select("id", "name", "score", "total")


@query(f"""WITH {_CONTACT_SQL}, r AS (SELECT * FROM (VALUES ('new', 0), ('email_sent', 4), ('email_opened', 2), ('tg_sent', 4), ('wa_sent', 7)) v(funnel_stage, need)),
x AS (SELECT *, floor((epoch((SELECT max(tm) FROM ev)) - epoch(last)) / 86400)::BIGINT AS days FROM con JOIN r USING (funnel_stage) WHERE NOT stop_automation AND NOT deleted AND segment = 'MACHINERY'),
y AS (SELECT company_id, name, coalesce(days, 999)::BIGINT AS days_since, score FROM x WHERE (need = 0 OR days IS NULL OR days >= need) AND (funnel_stage <> 'new' OR email_sent_count = 0))
SELECT *, (SELECT count(*) FROM y)::BIGINT AS total FROM y ORDER BY score DESC, days_since DESC, company_id LIMIT 25 OFFSET 25""")
def followup_page(spark: SparkSession, d: str) -> DataFrame:
    """S3, L2, T4: the second page of one segment's follow-ups."""
    c = _contacts(spark, d)
    queue = crm.followup_queue(c, last_time(events(spark, d), "at"))
    own = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x")))
    return base.followup_page(queue, own, segment="MACHINERY", page=2, per_page=25).select("company_id", "name", "days_since", "score", "total")


@query(f"WITH {COMPANIES}, f AS (SELECT *, count(*) OVER () AS total FROM companies WHERE NOT deleted AND segment = 'BUILDING' AND score >= 50 AND len(emails) > 0) SELECT id, name, city, score, total::BIGINT AS total, TRUE AS is_approximate FROM f ORDER BY id LIMIT 5")
def campaign_preview(spark: SparkSession, d: str) -> DataFrame:
    """M7, L3."""
    c = companies(spark, d).where("not deleted and segment = 'BUILDING' and score >= 50 and size(emails) > 0")
    return base.preview(c).select("id", "name", "city", "score", "total", "is_approximate")


@query(f"""WITH {COMPANIES}, r AS (SELECT id % 3 AS campaign_id, id AS company_id, emails[1] AS email FROM companies WHERE len(emails) > 0),
l AS (SELECT (id % 2)::BIGINT AS campaign_id, lower(emails[1]) AS e FROM companies WHERE len(emails) > 0 AND id % 5 = 0)
SELECT campaign_id, company_id, email FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.campaign_id = r.campaign_id AND l.e = lower(r.email)) AND company_id NOT IN (SELECT id FROM companies WHERE deleted OR id % 23 = 0)""")
def manual_recipients(spark: SparkSession, d: str) -> DataFrame:
    """M3: an address that a campaign has written to stays out, whichever company it was written for."""
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x"))).withColumn("stop_automation", F.col("id") % 23 == 0)
    mail = F.get("emails", F.lit(0)).alias("email")
    asked = c.where("size(emails) > 0").select((F.col("id") % 3).alias("campaign_id"), F.col("id").alias("company_id"), mail)
    logs = c.where("size(emails) > 0 and id % 5 = 0").select((F.col("id") % 2).alias("campaign_id"), F.upper(mail).alias("email"))
    return base.manual_recipients(asked, c, logs)


@query(f"WITH {EVENTS}, r AS (SELECT company_id, 'u' || k || '@x.ru' AS email, max(tm) AS added_at FROM ev WHERE kind = 'signup' GROUP BY ALL) SELECT company_id, email, (SELECT count(*) FROM r)::BIGINT AS total FROM r ORDER BY added_at DESC, email LIMIT 40")
def recipient_listing(spark: SparkSession, d: str) -> DataFrame:
    """S5."""
    r = events(spark, d).where("kind = 'signup'").groupBy("company_id", F.concat(F.lit("u"), s(F.col("k")), F.lit("@x.ru")).alias("email")).agg(F.max("at").alias("added_at"))
    return base.recipient_listing(r, 1, 40).select("company_id", "email", "total")


@query(f"""WITH {COMPANIES}, m AS (SELECT 'site' || (id % 97) || '.ru' AS base_domain, id, name, city, score FROM companies WHERE website IS NOT NULL AND NOT deleted),
n AS (SELECT 'site' || (id % 97) || '.ru' AS base_domain, array_agg(DISTINCT 'info' || (id % 50) || '@site' || (id % 97) || '.ru') AS mails FROM companies WHERE website IS NOT NULL GROUP BY ALL),
l AS (SELECT emails[1] AS e, count(*) AS k FROM companies WHERE id % 9 = 1 AND len(emails) > 0 GROUP BY ALL),
c AS (SELECT base_domain, city, count(*) AS k FROM m GROUP BY ALL), t AS (SELECT base_domain, string_agg(city || ':' || k, ',' ORDER BY k DESC, city) AS top_cities FROM (SELECT *, row_number() OVER (PARTITION BY base_domain ORDER BY k DESC, city) AS r FROM c) WHERE r <= 10 GROUP BY base_domain),
x AS (SELECT base_domain, coalesce(sum(k), 0)::BIGINT AS sent_count FROM (SELECT base_domain, unnest(mails) AS e FROM n) LEFT JOIN l USING (e) GROUP BY base_domain)
SELECT n.base_domain, count(m.id)::BIGINT AS live_count, string_agg(m.id::VARCHAR, ',' ORDER BY m.id) AS ids, any_value(top_cities) AS top_cities, any_value(sent_count) AS sent_count, CASE WHEN any_value(sent_count) > 0 THEN 'sent' ELSE 'none' END AS contact_status
FROM n LEFT JOIN m USING (base_domain) LEFT JOIN t USING (base_domain) JOIN x USING (base_domain) GROUP BY n.base_domain""")
def network_details(spark: SparkSession, d: str) -> DataFrame:
    """N4, J3."""
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x")))
    key = F.concat(F.lit("site"), s(F.col("id") % 97), F.lit(".ru"))
    own = c.where("website is not null")
    nets = own.groupBy(key.alias("base_domain")).agg(F.collect_set(F.concat(F.lit("info"), s(F.col("id") % 50), F.lit("@site"), s(F.col("id") % 97), F.lit(".ru"))).alias("emails"))
    logs = c.where("id % 9 = 1 and size(emails) > 0").select(F.get("emails", F.lit(0)).alias("email"), F.lit("sent").alias("status"))
    out = base.network_detail(nets, own.select(key.alias("key"), "id"), c, logs)
    ids, top = F.array_join(F.transform("ids", s), ","), F.array_join(F.transform("top_cities", lambda x: F.concat_ws(":", x["name"], s(x["count"]))), ",")
    return out.select("base_domain", "live_count", ids.alias("ids"), top.alias("top_cities"), "sent_count", "contact_status")


@query(f"""WITH {COMPANIES} SELECT * FROM (SELECT 'site' || (id % 97) || '.ru' AS key, id, name, city, score, row_number() OVER (PARTITION BY id % 97 ORDER BY id) AS pos FROM companies WHERE website IS NOT NULL AND NOT deleted) WHERE pos BETWEEN 4 AND 6""")
def network_companies(spark: SparkSession, d: str) -> DataFrame:
    """The second page of each network's companies."""
    c = companies(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x")))
    key = F.concat(F.lit("site"), s(F.col("id") % 97), F.lit(".ru"))
    return base.network_companies(c.where("website is not null").select(key.alias("key"), "id"), c, 2, 3)


@query(f"""WITH {EVENTS}, t AS (SELECT event_id AS touch_id, company_id, tm FROM ev WHERE k % 9 <> 0 UNION ALL SELECT event_id + 1000000000, company_id, tm + INTERVAL 1 HOUR FROM ev WHERE kind = 'purchase')
SELECT company_id, touch_id, pos::BIGINT AS pos, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tm DESC, touch_id DESC) AS pos, count(*) OVER (PARTITION BY company_id) AS total FROM t) WHERE pos BETWEEN 4 AND 6""")
def touch_history(spark: SparkSession, d: str) -> DataFrame:
    """Touches are added and deleted; the second page of three, newest first."""
    e = events(spark, d)
    log = e.select(F.col("event_id").alias("touch_id"), "company_id", "at")
    new = e.where("kind = 'purchase'").select((F.col("event_id") + 1000000000).alias("touch_id"), "company_id", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    now = effects.touch_log(log, new, log.join(e.where("k % 9 = 0").select(F.col("event_id").alias("touch_id")), "touch_id", "left_semi"))
    return effects.touch_history(now, 2, 3).select("company_id", "touch_id", F.col("pos").cast("long").alias("pos"), "total")


@query(f"WITH {COMPANIES}, {EVENTS} SELECT company_id, CASE WHEN kind = 'click' THEN 'tg' ELSE 'wa' END AS channel, 'hi ' || k AS body FROM ev WHERE kind IN ('click', 'purchase') AND k % 4 <> 0 AND company_id IN (SELECT id FROM companies)")
def messenger_touches(spark: SparkSession, d: str) -> DataFrame:
    """What went out by messenger becomes an outgoing touch."""
    e = events(spark, d)
    channel = F.when(F.col("kind") == "click", "tg").when(F.col("kind") == "purchase", "wa").otherwise("email")
    sends = e.select("company_id", "at", channel.alias("channel"), F.concat(F.lit("hi "), s(F.col("k"))).alias("text"), (F.col("k") % 4 != 0).alias("ok"))
    return effects.messenger_touches(sends, companies(spark, d)).select("company_id", "channel", "body")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Sent mails: events of companies to the addresses info0 to info49."""
    k = F.col("company_id")
    mail = F.concat(F.lit("info"), s(k % 50), F.lit("@site"), s(k % 97), F.lit(".ru"))
    status = F.when(F.col("k") % 10 == 0, "bounced").when(F.col("k") % 10 == 1, "replied").otherwise("sent")
    return events(spark, d).where("kind = 'view'").select(F.col("event_id").alias("log_id"), "company_id", (F.col("k") % 5).alias("campaign_id"), mail.alias("email"), F.col("at").alias("sent_at"), status.alias("status"))


_LOGS_SQL = "logs AS (SELECT event_id AS log_id, company_id, k % 5 AS campaign_id, 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' AS email, tm, CASE WHEN k % 10 = 0 THEN 'bounced' WHEN k % 10 = 1 THEN 'replied' ELSE 'sent' END AS status FROM ev WHERE kind = 'view'), lastlog AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY tm DESC, log_id DESC) AS r FROM logs) WHERE r = 1)"


@query(f"""WITH {EVENTS}, {_LOGS_SQL}, b AS (SELECT 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' AS email, CASE k % 3 WHEN 0 THEN '5.7.1' WHEN 1 THEN '5.2.2' ELSE '5.1.1' END AS code, tm FROM ev WHERE kind = 'error'),
h AS (SELECT l.log_id, l.company_id, l.campaign_id, arg_min(b.code, b.tm) AS code FROM b JOIN lastlog l USING (email) WHERE l.status <> 'bounced' GROUP BY ALL)
SELECT 'log' AS what, log_id AS id, 'bounced' AS value FROM h UNION ALL SELECT 'campaign', campaign_id, (10 + count(*))::VARCHAR FROM h GROUP BY campaign_id
UNION ALL SELECT 'contact', company_id, CASE WHEN bool_or(code = '5.1.1') THEN 'unreachable' ELSE 'new' END || ':' || CASE WHEN bool_or(code = '5.7.1') THEN 'true' ELSE 'false' END FROM h GROUP BY company_id""")
def bounce_effects(spark: SparkSession, d: str) -> DataFrame:
    """The last log of an address is bounced, its campaign counts an error, its contact follows the code."""
    logs = _logs(spark, d)
    k = F.col("company_id")
    code = F.when(F.col("k") % 3 == 0, "5.7.1").when(F.col("k") % 3 == 1, "5.2.2").otherwise("5.1.1")
    bounces = events(spark, d).where("kind = 'error'").select(F.concat(F.lit("INFO"), s(k % 50), F.lit("@site"), s(k % 97), F.lit(".ru ")).alias("email"), code.alias("code"), "at")
    campaigns = spark.range(6).select(F.col("id").alias("campaign_id"), F.lit(10).cast("long").alias("total_errors"))
    contacts = logs.select("company_id").distinct().select("company_id", F.lit("new").alias("funnel_stage"), F.lit(False).alias("stop_automation"))
    new, c, st = effects.bounce_effects(logs, campaigns, contacts, bounces)
    changed = new.where("status = 'bounced'").join(logs.where("status <> 'bounced'").select("log_id"), "log_id")
    hit = changed.select("company_id").distinct()
    row = lambda df, what, key, value: df.select(F.lit(what).alias("what"), F.col(key).alias("id"), value.alias("value"))
    return row(changed, "log", "log_id", F.col("status")).union(row(c.where("total_errors > 10"), "campaign", "campaign_id", s(F.col("total_errors")))).union(
        row(st.join(hit, "company_id", "left_semi"), "contact", "company_id", F.concat_ws(":", "funnel_stage", s(F.col("stop_automation"))))
    )


@query(f"""WITH {EVENTS}, {_LOGS_SQL}, p AS (SELECT 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' AS email, 'body ' || k AS body, tm, event_id FROM ev WHERE kind = 'click'),
h AS (SELECT l.log_id, l.company_id, l.campaign_id, arg_min(p.body, p.tm) AS body FROM p JOIN lastlog l USING (email) WHERE l.status <> 'replied' GROUP BY ALL), n AS (SELECT company_id, count(*) AS n FROM h GROUP BY company_id)
SELECT 'log' AS what, log_id AS id, 'replied' AS value FROM h UNION ALL SELECT 'campaign', campaign_id, count(*)::VARCHAR FROM h GROUP BY campaign_id UNION ALL SELECT 'contact', company_id, 'replied:' || (2 + n) FROM n
UNION ALL SELECT 'task', company_id, CASE WHEN company_id % 2 = 0 THEN 'cancelled' ELSE 'done' END FROM n UNION ALL SELECT 'touch', company_id, body FROM h""")
def reply_effects(spark: SparkSession, d: str) -> DataFrame:
    """Log, campaign, contact, tasks and an incoming touch."""
    logs = _logs(spark, d)
    k = F.col("company_id")
    replies = events(spark, d).where("kind = 'click'").select(F.concat(F.lit("info"), s(k % 50), F.lit("@site"), s(k % 97), F.lit(".ru")).alias("email"), "at", F.lit("re").alias("subject"), F.concat(F.lit("body "), s(F.col("k"))).alias("body"))
    campaigns = spark.range(6).select(F.col("id").alias("campaign_id"), F.lit(0).cast("long").alias("total_replied"))
    who = logs.select("company_id").distinct()
    contacts = who.select("company_id", F.lit("email_sent").alias("funnel_stage"), F.lit(2).cast("long").alias("email_replied_count"))
    tasks = who.select("company_id", F.lit("follow_up").alias("task_type"), F.when(k % 2 == 0, "pending").otherwise("done").alias("status"))
    out = effects.reply_effects(logs, campaigns, contacts, tasks, replies)
    changed = out["logs"].where("status = 'replied'").join(logs.where("status <> 'replied'").select("log_id"), "log_id")
    hit = changed.select("company_id").distinct()
    row = lambda df, what, key, value: df.select(F.lit(what).alias("what"), F.col(key).alias("id"), value.alias("value"))
    parts = [
        row(changed, "log", "log_id", F.col("status")), row(out["campaigns"].where("total_replied > 0"), "campaign", "campaign_id", s(F.col("total_replied"))),
        row(out["contacts"].where("funnel_stage = 'replied'"), "contact", "company_id", F.concat_ws(":", "funnel_stage", s(F.col("email_replied_count")))),
        row(out["tasks"].join(hit, "company_id", "left_semi"), "task", "company_id", F.col("status")), row(out["touches"], "touch", "company_id", F.col("body")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


@query(f"""WITH {EVENTS}, x AS (SELECT company_id, min(tm) AS sent FROM ev WHERE kind = 'signup' GROUP BY company_id), o AS (SELECT company_id, min(tm) AS opened FROM ev JOIN x USING (company_id) WHERE kind = 'view' AND epoch(tm) - epoch(sent) > 30 GROUP BY company_id)
SELECT 'contact' AS what, x.company_id AS id, CASE WHEN opened IS NULL THEN CASE WHEN x.company_id % 2 = 0 THEN 'email_sent' ELSE 'replied' END || ':0' ELSE CASE WHEN x.company_id % 2 = 0 THEN 'email_opened' ELSE 'replied' END || ':1' END AS value FROM x LEFT JOIN o USING (company_id)
UNION ALL SELECT 'campaign', company_id % 5, count(*)::VARCHAR FROM o GROUP BY ALL""")
def open_effects(spark: SparkSession, d: str) -> DataFrame:
    """The first counted open of a send moves its contact and counts for its campaign."""
    e = events(spark, d)
    sends = e.where("kind = 'signup'").groupBy("company_id").agg(F.min("at").alias("sent_at")).select(F.col("company_id").alias("tracking_id"), "company_id", (F.col("company_id") % 5).alias("campaign_id"), "sent_at")
    opens = e.where("kind = 'view'").select(F.col("company_id").alias("tracking_id"), "at", F.lit("Mozilla/5.0").alias("agent"))
    stage = F.when(F.col("company_id") % 2 == 0, "email_sent").otherwise("replied")
    contacts = sends.select("company_id", stage.alias("funnel_stage"), F.lit(0).cast("long").alias("email_opened_count"), F.lit(None).cast("timestamp").alias("last_email_opened_at"))
    campaigns = spark.range(5).select(F.col("id").alias("campaign_id"), F.lit(0).cast("long").alias("total_opened"))
    st, c = effects.open_effects(crm.first_valid_opens(opens, sends.select("tracking_id", "sent_at")), sends.drop("sent_at"), contacts, campaigns)
    row = lambda df, what, key, value: df.select(F.lit(what).alias("what"), F.col(key).alias("id"), value.alias("value"))
    return row(st, "contact", "company_id", F.concat_ws(":", "funnel_stage", s(F.col("email_opened_count")))).union(row(c.where("total_opened > 0"), "campaign", "campaign_id", s(F.col("total_opened"))))


@query(f"""WITH {COMPANIES}, {EVENTS}, e AS (SELECT id, unnest(emails || ['INFO' || (id % 50) || '@site' || (id % 97) || '.ru ']) AS e, unnest(range(0, len(emails) + 1)) AS p FROM companies), m AS (SELECT id AS company_id, lower(trim(e)) AS email, min(p) AS p FROM e GROUP BY ALL),
l AS (SELECT DISTINCT company_id FROM ev WHERE kind = 'view'), g AS (SELECT *, email LIKE 'info%' AND company_id IN (SELECT company_id FROM l) AS sent FROM m)
SELECT company_id, email, NOT sent AS is_active, p = min(p) OVER (PARTITION BY company_id) AS is_primary, sent::INT AS sent_count FROM g""")
def emails_from_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of arrays become rows, once each."""
    more = F.concat(F.lit("INFO"), s(F.col("id") % 50), F.lit("@site"), s(F.col("id") % 97), F.lit(".ru "))
    return effects.emails_from_arrays(companies(spark, d).withColumn("emails", F.concat("emails", F.array(more))), _logs(spark, d))


@query(f"""WITH {COMPANIES}, {EVENTS}, e AS (SELECT id AS company_id, unnest(emails) AS email, unnest(range(0, len(emails))) AS p FROM companies), x AS (SELECT company_id * 10 + p AS id, company_id, email, company_id % 8 <> 1 AS is_active, p = 0 AS is_primary FROM e),
l AS (SELECT DISTINCT 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' AS email FROM ev WHERE kind = 'view' AND company_id % 3 = 0), g AS (SELECT *, is_active AND email IN (SELECT email FROM l) AS off FROM x),
h AS (SELECT company_id, bool_or(off AND is_primary) AS lost, min(CASE WHEN is_active AND NOT off THEN id END) AS nxt FROM g GROUP BY company_id)
SELECT id, is_active AND NOT off AS is_active, (is_primary AND NOT off) OR (lost AND coalesce(id = nxt, FALSE)) AS is_primary FROM g JOIN h USING (company_id)""")
def deactivated_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that anybody was written at go inactive; a lost primary passes on."""
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.posexplode("emails").alias("p", "email"))
    have = c.select((F.col("company_id") * 10 + F.col("p")).alias("id"), "company_id", "email", (F.col("company_id") % 8 != 1).alias("is_active"), (F.col("p") == 0).alias("is_primary"))
    return effects.deactivate_mailed(have, _logs(spark, d).where("company_id % 3 = 0")).select("id", "is_active", "is_primary")


@query(f"WITH {COMPANIES} SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE coalesce(address, '') END AS address, regexp_replace(website, '/about$', '/') AS website, telegram, CASE WHEN whatsapp IS NOT NULL THEN 'https://api.whatsapp.com/send?phone=7' || id END AS whatsapp FROM companies")
def normalised_after_merge(spark: SparkSession, d: str) -> DataFrame:
    """Links in one form, no URL for an address, websites at their root."""
    c = companies(spark, d)
    address = F.when(F.col("id") % 6 == 0, "http://x.ru/map").when(F.col("id") % 6 == 3, "www.x.ru").otherwise(F.col("address"))
    twice = F.transform_values("messengers", lambda k, v: F.when(k == "telegram", F.concat(F.lit("https://t.me/"), v)).otherwise(v))
    out = effects.normalised_after_merge(c.withColumn("address", address).withColumn("messengers", twice))
    m = lambda k: F.try_element_at("messengers", F.lit(k)).alias(k)
    return out.select("id", "address", "website", m("telegram"), m("whatsapp"))


@query(f"""WITH {COMPANIES} SELECT id, unnest(['segment', 'score', 'deleted_at', 'review_reason', 'needs_review', 'is_network']) AS "column", unnest([segment, score::VARCHAR, NULL, '', 'false', is_network::VARCHAR]) AS before, unnest(['spam', '0', '2026-01-01', 'spam_domain_cleanup', 'true', 'false']) AS after
FROM companies WHERE website LIKE '%site13.%' OR website LIKE '%site44.net%'""")
def spam_cleanup_diff(spark: SparkSession, d: str) -> DataFrame:
    """What deleting companies of spam sites would change."""
    c = companies(spark, d).select("id", "website", "segment", "score", "is_network", F.lit(None).cast("string").alias("deleted_at"), F.lit("").alias("review_reason"), F.lit(False).alias("needs_review"))
    after = effects.delete_spam_sites(c, ("site13.", "site44.net"), F.lit("2026-01-01"))
    diff = effects.repair_diff(c, after)
    # rows that already had the value are no change
    marked = after.where("segment = 'spam'").select("id")
    full = marked.join(c, "id").select("id", F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("before")) for x in ("segment", "score", "deleted_at", "review_reason", "needs_review", "is_network")))).alias("x")).select("id", "x.*")
    same = full.join(diff.select("id", "column"), ["id", "column"], "left_anti").withColumn("after", F.col("before"))
    return diff.unionByName(same.select("id", "column", "before", "after"))


@query(f"WITH {LEADS} SELECT company_id, CASE city WHEN 'NATION_1' THEN 'NATION_1S' WHEN 'NATION_3' THEN 'NATION_3S' ELSE city END AS city_locative FROM leads")
def locative_cities(spark: SparkSession, d: str) -> DataFrame:
    """X24."""
    from leadflow.plans.views import leads

    forms = spark.createDataFrame([("NATION_1", "NATION_1S"), ("NATION_3", "NATION_3S"), ("ROME", "ROMES")], "city string, locative string")
    return cities.locative(leads(spark, d), forms).select("company_id", "city_locative")


@query(f"""WITH {COMPANIES}, b AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b, phones[1] AS ph FROM companies), v AS (SELECT id, [b[1:30], replace(b, 'customer', 'shop')[1:30], b[1:20] || '_shop', 'shop_' || b[1:20]] || CASE WHEN ph IS NULL THEN []::VARCHAR[] ELSE [b[1:15] || right(ph, 4)] END AS v FROM b)
SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS names FROM v""")
def profile_names(spark: SparkSession, d: str) -> DataFrame:
    """X32."""
    c = companies(spark, d)
    return c.select("id", F.array_join(names.usernames(F.col("name"), F.get("phones", F.lit(0)), "shop", "customer"), ",").alias("names"))


@query("SELECT doc_id, contains(t, 'tgme_page_title') AND (contains(lower(regexp_extract(t, 'tgme_page_title[^>]*>([^<]+)', 1)), 'angel') OR contains(lower(regexp_extract(t, 'tgme_page_description[^>]*>([^<]+)', 1)), 'ритуал')) AS matches FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<b class=\"tgme_page_title\">Angel ' || doc_id || '</b>' WHEN 1 THEN '<i class=\"tgme_page_description\">Ритуал</i>' WHEN 2 THEN '<b class=\"tgme_page_title\">x</b><i class=\"tgme_page_description\">РИТУАЛ</i>' ELSE '<b class=\"tgme_page_title\">x</b>angel' END AS t FROM documents)")
def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """Profile pages whose title or description shows the trade."""
    k = F.col("doc_id")
    title, text = F.lit('<b class="tgme_page_title">'), F.lit('<i class="tgme_page_description">')
    page = F.when(k % 4 == 0, F.concat(title, F.lit("Angel "), s(k), F.lit("</b>"))).when(k % 4 == 1, F.concat(text, F.lit("Ритуал</i>"))).when(k % 4 == 2, F.concat(title, F.lit("x</b>"), text, F.lit("РИТУАЛ</i>"))).otherwise(F.concat(title, F.lit("x</b>angel")))
    return table(spark, d, "documents").select("doc_id", names.profile_matches(page, PROFILE_WORDS).alias("matches"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Tver' WHEN 1 THEN 'Perm' WHEN 4 THEN 'Tver' END AS city FROM pages WHERE page_id % 5 IN (0, 1, 4)")
def contact_zone_cities(spark: SparkSession, d: str) -> DataFrame:
    """A foreign city in the footer, the address, a named block or, without any, the page; not inside a word."""
    k = F.col("page_id") % 5
    zone = F.when(k == 0, "<p>perm</p><footer class='f'>Office in <b>TVERi</b></footer>").when(k == 1, "<div id='my-contact'>of perm</div>").when(k == 2, "<footer>superperm</footer><p>tver</p>").when(k == 3, "<address>here</address> tver").otherwise("no zone, tver and perm")
    roots = spark.createDataFrame([(0, "tver", "Tver"), (1, "perm", "Perm")], "ordinal int, root string, city string")
    return cities.contact_city(table(spark, d, "pages").select("page_id", zone.alias("html")), "page_id", "html", roots)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a,c' WHEN 1 THEN 'b' ELSE 'main' END AS kept FROM pages")
def category_lists(spark: SparkSession, d: str) -> DataFrame:
    """F18."""
    k = F.col("page_id") % 3
    asked = F.when(k == 0, F.array(F.lit("a"), F.lit("x"), F.lit("c"))).when(k == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("z")))
    return table(spark, d, "pages").select("page_id", F.array_join(base.allowed_categories(asked, ("a", "b", "c"), "main"), ",").alias("kept"))


@query("SELECT min(p_partkey) AS id, lower(trim(p_name)) AS key FROM part GROUP BY lower(trim(p_name))")
def one_card_per_name(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC9: the first card of each name."""
    cards = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"))
    return base.one_per_name(cards.union(spark.createDataFrame([(0, " "), (0, None)], "id long, name string")), "id").select("id", F.lower(F.trim("name")).alias("key"))


@query(f"""WITH {COMPANIES}, l AS (SELECT city, name AS key, min(id) AS i FROM companies WHERE id % 2 = 0 GROUP BY ALL)
SELECT c.id, coalesce(c.telegram, CASE WHEN l.i IS NOT NULL THEN 'https://t.me/l' || l.i END) AS telegram, CASE WHEN l.i IS NOT NULL THEN 'https://vk.com/l' || l.i END AS vk FROM companies c LEFT JOIN l ON c.city = l.city AND c.name = l.key""")
def backfilled_messengers(spark: SparkSession, d: str) -> DataFrame:
    """Links of a listing fill what a company lacks."""
    c = companies(spark, d).withColumn("key", F.col("name"))
    own = lambda kind, at: F.concat(F.lit(f"https://{at}/l"), s(F.col("id")))
    listings = c.where("id % 2 = 0").select("city", "key", F.col("id").alias("listing_id"), F.create_map(F.lit("telegram"), own("telegram", "t.me"), F.lit("vk"), own("vk", "vk.com")).alias("messengers"))
    m = lambda k: F.try_element_at("messengers", F.lit(k)).alias(k)
    return effects.backfill_messengers(c, listings).select("id", m("telegram"), m("vk"))


@query("SELECT page_id, page_id % 12 IN (0, 3, 8) AS safe FROM pages")
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    """public hosts only, of each range and name that is refused."""
    at = ("https://site.ru/a", "http://10.1.2.3/", "http://192.0.2.77/", "http://203.0.114.1/", "http://203.0.113.9:80/", "http://metadata/x", "http://198.51.100.1/", "http://192.0.0.8/", "http://172.32.0.1/", "http://localhost/", "ftp://site.ru/", "http://100.64.3.2/")
    url = F.get(F.array(*map(F.lit, at)), (F.col("page_id") % 12).cast("int"))
    return table(spark, d, "pages").select("page_id", is_safe_url(url).alias("safe"))
