"""Queries: contact state, recipients, opens, keyed rewrites, limits and rolling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators import crm, networks, relations, review, sending
from leadflow.plans.registry import COMPANIES, EVENTS, query
from leadflow.plans.views import companies, events, last_time
from leadflow.streaming import contacts as streams


def _touches(spark: SparkSession, d: str) -> DataFrame:
    """Events as touches: view and signup by mail, click by tg, purchase by wa, error an answer."""
    kind = F.col("kind")
    return events(spark, d).select(
        F.col("event_id").alias("touch_id"), "company_id", "at", F.when(kind.isin("view", "signup"), "email").when(kind == "click", "tg").when(kind == "purchase", "wa").otherwise("email").alias("channel"),
        F.when(kind == "error", "incoming").otherwise("outgoing").alias("direction"),
    )


_TOUCH_SQL = f"{EVENTS}, t AS (SELECT event_id AS touch_id, company_id, tm, CASE WHEN kind = 'error' THEN 'I' WHEN kind IN ('view', 'signup') THEN 'E' WHEN kind = 'click' THEN 'T' ELSE 'W' END AS c FROM ev)"
_FOLD_SQL = """list_reduce(list_prepend('new', list(c ORDER BY tm, touch_id)), lambda s, x: CASE WHEN x = 'I' THEN CASE WHEN s IN ('interested', 'not_interested') THEN s ELSE 'replied' END WHEN x = 'E' THEN CASE WHEN s = 'new' THEN 'email_sent' ELSE s END
WHEN x = 'T' THEN CASE WHEN s IN ('new', 'email_sent', 'email_opened') THEN 'tg_sent' ELSE s END ELSE CASE WHEN s IN ('replied', 'interested', 'not_interested', 'tg_sent') THEN s ELSE 'wa_sent' END END)"""


@query(f"""WITH {_TOUCH_SQL} SELECT company_id, {_FOLD_SQL} AS funnel_stage, count(*)::BIGINT AS contact_count, count_if(c = 'E')::BIGINT AS email_sent_count, count_if(c = 'T')::BIGINT AS tg_sent_count, count_if(c = 'W')::BIGINT AS wa_sent_count, bool_or(c = 'I') AS stop_automation FROM t GROUP BY company_id""")
def stage_fold(spark: SparkSession, d: str) -> DataFrame:
    """The ordered fold of a company's touches."""
    return crm.fold_touches(_touches(spark, d)).drop("first_contact_at", "last_contact_at")


@query(f"WITH {_TOUCH_SQL} SELECT company_id, {_FOLD_SQL} AS funnel_stage, count(*)::BIGINT AS contact_count FROM t GROUP BY company_id")
def funnel_of_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST7: the streaming operator over a bounded table."""
    return streams.funnel_stream(_touches(spark, d))


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    """Companies with the state that their touches left, `new` where there are none."""
    folded = crm.fold_touches(_touches(spark, d)).withColumnRenamed("company_id", "id")
    m = lambda k: F.try_element_at("messengers", F.lit(k)).alias(k)
    return companies(spark, d).join(folded, "id", "left").select(
        F.col("id").alias("company_id"), "name", "city", "segment", "score", "deleted", "emails", F.coalesce("funnel_stage", F.lit("new")).alias("funnel_stage"), F.coalesce("stop_automation", F.lit(False)).alias("stop_automation"),
        F.coalesce("email_sent_count", F.lit(0)).alias("email_sent_count"), "last_contact_at", m("telegram"), m("whatsapp"),
    )


_CONTACT_SQL = f"""{COMPANIES}, {_TOUCH_SQL}, f AS (SELECT company_id, {_FOLD_SQL} AS funnel_stage, count_if(c = 'E') AS email_sent_count, bool_or(c = 'I') AS stop_automation, max(tm) AS last FROM t GROUP BY company_id),
con AS (SELECT companies.id AS company_id, name, city, segment, score, deleted, emails, coalesce(funnel_stage, 'new') AS funnel_stage, coalesce(stop_automation, FALSE) AS stop_automation, coalesce(email_sent_count, 0) AS email_sent_count, last, telegram, whatsapp FROM companies LEFT JOIN f ON f.company_id = companies.id)"""


@query(f"""WITH {_CONTACT_SQL}, r AS (SELECT * FROM (VALUES ('new', 0, 'email', 'cold_email_v1'), ('email_sent', 4, 'tg', 'tg_intro'), ('email_opened', 2, 'tg', 'tg_intro'), ('tg_sent', 4, 'wa', 'wa_intro'), ('wa_sent', 7, 'email', 'follow_up_email_v1')) v(funnel_stage, need, ch, tpl)),
x AS (SELECT *, floor((epoch((SELECT max(tm) FROM ev)) - epoch(last)) / 86400)::BIGINT AS days, ch = 'tg' AND telegram IS NULL AND whatsapp IS NOT NULL AS swap FROM con JOIN r USING (funnel_stage) WHERE NOT stop_automation)
SELECT company_id, funnel_stage, coalesce(days, 999)::BIGINT AS days_since, CASE WHEN swap THEN 'wa' ELSE ch END AS channel, CASE WHEN swap THEN TRUE WHEN ch = 'tg' THEN telegram IS NOT NULL WHEN ch = 'wa' THEN whatsapp IS NOT NULL ELSE TRUE END AS available,
CASE WHEN swap THEN 'wa_intro' ELSE tpl END AS template, score FROM x WHERE (need = 0 OR days IS NULL OR days >= need) AND (funnel_stage <> 'new' OR email_sent_count = 0)""")
def followup_queue(spark: SparkSession, d: str) -> DataFrame:
    """T4: `now` is the last event."""
    return crm.followup_queue(_contacts(spark, d), last_time(events(spark, d), "at"))


@query(f"""WITH {_CONTACT_SQL}, c AS (SELECT company_id, company_id AS ordinal, name, emails[1] AS email, stop_automation, email_sent_count FROM con WHERE NOT deleted AND len(emails) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY ordinal) AS k FROM c)
SELECT company_id, email, CASE WHEN k > 1 THEN 'duplicate_email' WHEN lower(email) IN (SELECT 'info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru' FROM ev WHERE kind = 'purchase') THEN 'already_mailed' WHEN email_sent_count > 0 THEN 'contact_mailed'
WHEN regexp_extract(email, '@(.*)$', 1) IN ('site5.ru', 'site7.ru') THEN 'aggregator' WHEN regexp_extract(email, '@(.*)$', 1) = 'site11.ru' THEN 'blocked_domain' WHEN stop_automation THEN 'stopped' END AS reason FROM n""")
def recipient_reasons(spark: SparkSession, d: str) -> DataFrame:
    """M1-M4: candidates with the first reason against each."""
    c = _contacts(spark, d).where(~F.col("deleted") & (F.size("emails") > 0))
    c = c.select("company_id", F.col("company_id").alias("ordinal"), "name", F.get("emails", F.lit(0)).alias("email"), "stop_automation", "email_sent_count", F.lit(None).cast("timestamp").alias("last_email_sent_at"))
    k = F.col("company_id")
    sent = events(spark, d).where("kind = 'purchase'").select(F.concat(F.lit("info"), (k % 50).cast("string"), F.lit("@site"), (k % 97).cast("string"), F.lit(".ru")).alias("email"))
    blocked = spark.createDataFrame([("site11.ru",)], "domain string")
    return crm.recipient_reasons(c, sent, blocked, last_time(events(spark, d), "at"), ("site5.ru", "site7.ru")).select("company_id", "email", "reason")


@query(f"""WITH {_CONTACT_SQL}, c AS (SELECT company_id, emails[1] AS email FROM con WHERE NOT deleted AND NOT stop_automation AND segment = 'BUILDING' AND score >= 10 AND len(emails) > 0 AND company_id NOT IN (SELECT company_id FROM ev WHERE kind = 'view'))
SELECT min(company_id) AS company_id, arg_min(email, company_id) AS email FROM c GROUP BY lower(email)""")
def campaign_candidates(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, W1."""
    c = _contacts(spark, d).withColumn("deleted_at", F.when(F.col("deleted"), F.current_timestamp()))
    mails = c.select("company_id", F.posexplode("emails").alias("p", "email")).select((F.col("company_id") * 10 + F.col("p")).alias("id"), "company_id", "email", F.lit(True).alias("is_active"), (F.col("p") == 0).alias("is_primary"))
    return crm.campaign_candidates(c, mails, events(spark, d).where("kind = 'view'"), segment="BUILDING", least_score=10)


@query(f"""WITH {_CONTACT_SQL}, w AS (SELECT *, CASE WHEN company_id % 10 = 3 THEN 'in_campaign' WHEN deleted THEN 'missing' WHEN stop_automation THEN 'stopped' WHEN len(emails) = 0 THEN 'no_email' END AS own FROM con WHERE company_id % 4 = 1),
e AS (SELECT DISTINCT company_id, lower(unnest(emails)) AS email FROM w WHERE own IS NULL), k AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY company_id) AS r FROM e)
SELECT company_id AS ordinal, company_id, NULL AS email, own AS reason FROM w WHERE own IS NOT NULL UNION ALL SELECT company_id, company_id, email, CASE WHEN email LIKE 'info7@%' THEN 'already_mailed' WHEN r > 1 THEN 'claimed' END FROM k""")
def added_recipients(spark: SparkSession, d: str) -> DataFrame:
    """M5: an address goes to the first company in order that passes its own check."""
    c = _contacts(spark, d)
    asked = c.where("company_id % 4 = 1").select(F.col("company_id").alias("ordinal"), "company_id", (~F.col("deleted")).alias("live"), F.col("stop_automation").alias("stopped"), "emails")
    mailed = c.select(F.explode("emails").alias("email")).where(F.col("email").startswith("info7@"))
    return crm.add_recipients(asked, c.where("company_id % 10 = 3"), mailed)


@query(f"""WITH {EVENTS}, s AS (SELECT company_id, min(tm) AS sent FROM ev WHERE kind = 'signup' GROUP BY company_id), o AS (SELECT company_id, tm, sent, epoch(tm) - epoch(sent) <= 3600 AS early FROM ev JOIN s USING (company_id) WHERE kind = 'view' AND k % 7 <> 0)
SELECT company_id AS tracking_id, min(tm) FILTER (WHERE NOT early) AS opened_at, bool_or(early) AS suspicious FROM o GROUP BY company_id""")
def first_valid_opens(spark: SparkSession, d: str) -> DataFrame:
    """T10, F27."""
    e = events(spark, d)
    sends = e.where("kind = 'signup'").groupBy(F.col("company_id").alias("tracking_id")).agg(F.min("at").alias("sent_at"))
    opens = e.where("kind = 'view'").select(F.col("company_id").alias("tracking_id"), "at", F.when(F.col("k") % 7 == 0, "SomeBot/1.0").otherwise("Mozilla/5.0").alias("agent"))
    return crm.first_valid_opens(opens, sends, 3600).withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))


@query(f"""WITH {_CONTACT_SQL}, b AS (SELECT company_id, bool_or(k % 3 = 0) AS stop, bool_or(k % 3 = 2) AS gone FROM ev WHERE kind = 'error' GROUP BY company_id)
SELECT con.company_id, CASE WHEN coalesce(gone, FALSE) THEN 'unreachable' ELSE funnel_stage END AS funnel_stage, stop_automation OR coalesce(stop, FALSE) AS stop_automation FROM con LEFT JOIN b USING (company_id)""")
def bounced_contacts(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    code = F.when(F.col("k") % 3 == 0, "5.7.1").when(F.col("k") % 3 == 1, "5.2.2").otherwise("5.1.1")
    bounces = events(spark, d).where("kind = 'error'").select(F.col("event_id").alias("log_id"), "company_id", code.alias("code"))
    return crm.apply_bounces(_contacts(spark, d).select("company_id", "funnel_stage", "stop_automation"), bounces)


@query(f"""WITH {_CONTACT_SQL}, r AS (SELECT DISTINCT company_id FROM ev WHERE kind = 'click' AND k % 5 > 1)
SELECT con.company_id, CASE WHEN r.company_id IS NOT NULL AND funnel_stage NOT IN ('interested', 'not_interested') THEN 'replied' ELSE funnel_stage END AS funnel_stage, stop_automation OR r.company_id IS NOT NULL AS stop_automation FROM con LEFT JOIN r USING (company_id)""")
def replied_contacts(spark: SparkSession, d: str) -> DataFrame:
    """T9, T11."""
    replies = events(spark, d).where("kind = 'click'").select("company_id", (F.col("k") % 5 == 0).alias("is_bounce"), (F.col("k") % 5 == 1).alias("is_out_of_office"))
    return crm.apply_replies(_contacts(spark, d).select("company_id", "funnel_stage", "stop_automation"), replies)


@query(f"""WITH {_CONTACT_SQL}, t2 AS (SELECT event_id AS task_id, company_id * 3 AS company_id, k FROM ev WHERE kind = 'click' AND tm <= (SELECT max(tm) FROM ev) - INTERVAL 7 DAYS)
SELECT task_id, CASE WHEN con.company_id IS NULL THEN 'cancelled' WHEN stop_automation THEN 'cancelled' WHEN funnel_stage IN ('replied', 'interested', 'not_interested', 'unreachable') THEN 'done' WHEN k % 5 >= 3 THEN 'failed' ELSE 'send' END AS decision FROM t2 LEFT JOIN con USING (company_id)""")
def due_followups(spark: SparkSession, d: str) -> DataFrame:
    """T5-T7, X40."""
    e = events(spark, d)
    tasks = e.where("kind = 'click'").select(F.col("event_id").alias("task_id"), (F.col("company_id") * 3).alias("company_id"), (F.col("at") + F.expr("INTERVAL 7 DAYS")).alias("due_at"), F.lit("pending").alias("status"), F.concat(F.lit("[retry:"), (F.col("k") % 5).cast("string"), F.lit("]")).alias("note"))
    return crm.due_followups(tasks, _contacts(spark, d), last_time(e, "at"))


_ROUND_SQL = f"""WITH {COMPANIES}, {EVENTS}, l AS (SELECT greatest(0, 150 - count(*)) AS l FROM ev WHERE kind = 'purchase' AND tm >= (SELECT max(tm) FROM ev) - INTERVAL 24 HOURS),
al AS (SELECT id % 7 AS campaign_id, (id % 7) * 5 % 7 AS priority, id AS ordinal, emails[1] AS email, id % 5 <> 0 AS ok FROM companies WHERE len(emails) > 0 AND NOT deleted),
q AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ordinal) AS n FROM al WHERE campaign_id <> 3), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY campaign_id ORDER BY n) AS k FROM q WHERE n <= 25),
u AS (SELECT campaign_id, coalesce(sum(w) OVER (ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (SELECT campaign_id, priority, max(k) AS w FROM r GROUP BY ALL)),
plan AS (SELECT campaign_id, ordinal, ordinal AS company_id, email, CASE WHEN least(used, l) + k > l THEN 'day_limit' WHEN ok THEN 'send' ELSE 'error' END AS decision FROM r JOIN u USING (campaign_id), l)"""


def _round(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Campaigns, their queue and the plan of a round: a campaign for each remainder of companies' ids."""
    c = companies(spark, d).where(~F.col("deleted") & (F.size("emails") > 0))
    queue = c.select((F.col("id") % 7).alias("campaign_id"), F.col("id").alias("ordinal"), F.col("id").alias("company_id"), F.get("emails", F.lit(0)).alias("email"), (F.col("id") % 5 != 0).alias("has_contact"))
    k = F.col("campaign_id")
    campaigns = queue.select("campaign_id").distinct().select(k, (k * 5 % 7).alias("priority"), F.when(k == 3, "draft").otherwise("running").alias("status"), F.lit(None).cast("long").alias("total_sent"), k.alias("total_errors"))
    e = events(spark, d)
    logs = e.where("kind = 'purchase'").select(F.col("at").alias("sent_at"))
    return campaigns, queue, sending.send_plan(campaigns, queue, logs, last_time(e, "at"))


@query(_ROUND_SQL + " SELECT * FROM plan")
def send_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a round sends under the cap of a run and what the rolling day allows."""
    return _round(spark, d)[2]


@query(_ROUND_SQL + """, c AS (SELECT campaign_id, count(*) AS n FROM al GROUP BY ALL), p AS (SELECT campaign_id, count(*) AS n, count_if(decision = 'send') AS s, count_if(decision = 'error') AS e, bool_or(decision = 'day_limit') AS cut FROM plan GROUP BY ALL)
SELECT campaign_id, CASE WHEN campaign_id = 3 THEN 'draft' WHEN p.cut THEN 'paused_daily_limit' WHEN c.n > p.n THEN 'paused' ELSE 'completed' END AS status, coalesce(p.s, 0)::BIGINT AS total_sent, (campaign_id + coalesce(p.e, 0))::BIGINT AS total_errors FROM c LEFT JOIN p USING (campaign_id)""")
def campaigns_after_round(spark: SparkSession, d: str) -> DataFrame:
    """M9: status and counters of campaigns after a round."""
    return sending.campaigns_after(*_round(spark, d)).drop("priority")


@query(_ROUND_SQL + """, e AS (SELECT id * 10 + i - 1 AS id, id AS company_id, emails[i] AS email, i = 1 AS is_primary FROM (SELECT id, emails, unnest(range(1, len(emails) + 1)) AS i FROM companies)),
x AS (SELECT e.*, email IN (SELECT email FROM plan WHERE decision = 'send') AS gone, (company_id, email) IN (SELECT company_id, email FROM plan WHERE decision = 'send') AS own FROM e),
y AS (SELECT *, min(id) FILTER (WHERE NOT gone) OVER (PARTITION BY company_id) AS nxt, bool_or(gone AND is_primary) OVER (PARTITION BY company_id) AS lost FROM x)
SELECT id, company_id, email, NOT gone AS is_active, (is_primary AND NOT gone) OR (lost AND coalesce(id = nxt, FALSE)) AS is_primary, own::BIGINT AS sent_count FROM y""")
def addresses_after_round(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that were written at go everywhere, primaries move on."""
    mails = companies(spark, d).select("id", F.posexplode("emails").alias("p", "email"))
    mails = mails.select((F.col("id") * 10 + F.col("p")).alias("id"), F.col("id").alias("company_id"), "email", F.lit(True).alias("is_active"), (F.col("p") == 0).alias("is_primary"), F.lit(None).cast("long").alias("sent_count"))
    return sending.emails_after(mails, _round(spark, d)[2])


@query(f"""WITH {_CONTACT_SQL}, t0 AS (SELECT event_id AS task_id, company_id, CASE WHEN k % 3 = 0 THEN 'call' ELSE 'follow_up' END AS task_type, CASE WHEN k % 4 = 0 THEN 'done' ELSE 'pending' END AS status, tm + INTERVAL 3 DAYS AS due_at FROM ev WHERE kind = 'click' AND k % 5 = 1),
t1 AS (SELECT task_id, t0.company_id, task_type, CASE WHEN status = 'pending' AND task_type = 'follow_up' AND funnel_stage IN ('replied', 'interested', 'not_interested', 'unreachable') THEN 'cancelled' ELSE status END AS status, due_at FROM t0 LEFT JOIN con USING (company_id)),
o AS (SELECT company_id, min(tm) AS m FROM ev WHERE kind = 'view' AND k % 7 <> 0 GROUP BY company_id)
SELECT * FROM t1 UNION ALL SELECT NULL, company_id, 'follow_up', 'pending', m + INTERVAL 7 DAYS FROM o WHERE company_id NOT IN (SELECT company_id FROM t1 WHERE status = 'pending' AND task_type = 'follow_up')""")
def followup_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Follow-ups end with their contact's stage and begin with a first open."""
    e = events(spark, d)
    k = F.col("k")
    tasks = e.where("kind = 'click' and k % 5 = 1").select(F.col("event_id").alias("task_id"), "company_id", F.when(k % 3 == 0, "call").otherwise("follow_up").alias("task_type"), F.when(k % 4 == 0, "done").otherwise("pending").alias("status"), (F.col("at") + F.expr("INTERVAL 3 DAYS")).alias("due_at"))
    opens = e.where("kind = 'view' and k % 7 <> 0").select("company_id", F.col("at").alias("opened_at"))
    return sending.followups_after(tasks, _contacts(spark, d), opens).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query(f"""WITH {EVENTS}, c AS (SELECT k % 11 AS campaign_id, max(tm) FILTER (WHERE kind = 'purchase') AS u, max(tm) FILTER (WHERE kind = 'click') AS s, min(tm) AS c FROM ev GROUP BY ALL)
SELECT campaign_id, greatest(u, s, c) < (SELECT max(tm) FROM ev) - INTERVAL 10 MINUTES AS stale FROM c""")
def stale_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """M10."""
    e = events(spark, d)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    c = e.groupBy((F.col("k") % 11).alias("campaign_id")).agg(of("purchase").alias("u"), of("click").alias("s"), F.min("at").alias("c"))
    return c.select("campaign_id", sending.is_stale(F.col("u"), F.col("s"), F.col("c"), last_time(e, "at")).alias("stale"))


@query(f"""WITH {COMPANIES}, e AS (SELECT 'n' || (id % 9) AS key, unnest(emails) AS email, id FROM companies), l AS (SELECT email, arg_max((id % 7 = 0)::INT, id % 31 * 1000000000 + id) AS b FROM e WHERE id % 2 = 1 AND id % 5 < 2 GROUP BY email)
SELECT DISTINCT key, e.email, CASE WHEN e.email LIKE 'info3@%' THEN 'disabled' WHEN b = 1 THEN 'bounced' WHEN b = 0 THEN 'sent' ELSE 'none' END AS badge FROM e LEFT JOIN l USING (email)""")
def email_badges(spark: SparkSession, d: str) -> DataFrame:
    """N7, A13."""
    e = companies(spark, d).select(F.concat(F.lit("n"), (F.col("id") % 9).cast("string")).alias("key"), F.explode("emails").alias("email"), "id")
    logs = e.where("id % 2 = 1 and id % 5 < 2").select(F.col("id").alias("log_id"), (F.col("id") % 31).alias("at"), "email", F.when(F.col("id") % 7 == 0, "bounced").otherwise("sent").alias("status"))
    return networks.email_badges(e, e.where(F.col("email").startswith("info3@")), logs)


@query(f"""WITH {COMPANIES}, x AS (SELECT id AS company_id, emails[1] AS email, id % 8 <> 1 AS is_active, id % 3 = 0 AS is_primary, id % 4 AS sent_count FROM companies WHERE len(emails) > 0), w AS (SELECT id AS company_id, CASE WHEN id % 6 = 3 THEN ['new' || id || '@x.ru'] ELSE emails END AS emails FROM companies WHERE id % 5 <> 0),
u AS (SELECT company_id, e AS email, min(p) AS p FROM (SELECT company_id, unnest(emails) AS e, unnest(range(0, len(emails))) AS p FROM w) GROUP BY ALL),
j AS (SELECT coalesce(x.company_id, u.company_id) AS company_id, coalesce(x.email, u.email) AS email, is_active, is_primary, sent_count, p FROM x FULL JOIN u ON x.company_id = u.company_id AND x.email = u.email),
k AS (SELECT * FROM j WHERE p IS NOT NULL OR company_id NOT IN (SELECT company_id FROM w))
SELECT company_id, email, coalesce(is_active, TRUE) AS is_active, CASE WHEN bool_or(coalesce(is_primary, FALSE)) OVER (PARTITION BY company_id) THEN coalesce(is_primary, FALSE) ELSE row_number() OVER (PARTITION BY company_id ORDER BY p NULLS LAST, email) = 1 END AS is_primary, coalesce(sent_count, 0)::BIGINT AS sent_count FROM k""")
def synced_emails(spark: SparkSession, d: str) -> DataFrame:
    """C11, W7."""
    c = companies(spark, d)
    have = c.where(F.size("emails") > 0).select(F.col("id").alias("company_id"), F.get("emails", F.lit(0)).alias("email"), (F.col("id") % 8 != 1).alias("is_active"), (F.col("id") % 3 == 0).alias("is_primary"), (F.col("id") % 4).alias("sent_count"))
    fresh = F.when(F.col("id") % 6 == 3, F.array(F.concat(F.lit("new"), F.col("id").cast("string"), F.lit("@x.ru")))).otherwise(F.col("emails"))
    return relations.sync_emails(have, c.where("id % 5 <> 0").select(F.col("id").alias("company_id"), fresh.alias("emails")))


@query(f"""WITH {COMPANIES}, c AS (SELECT id, id - CASE WHEN id % 10 = 7 THEN 1 WHEN id % 10 = 8 THEN 2 ELSE 0 END AS t, emails, id % 4 AS n FROM companies)
SELECT c.id, CASE WHEN c.id <> c.t THEN c.t END AS merged_into, CASE WHEN c.id = c.t AND g.k > 1 THEN g.absorbed ELSE '' END AS merged_from, CASE WHEN c.id = c.t AND g.k > 1 THEN g.n ELSE c.n END::BIGINT AS contact_count, CASE WHEN c.id = c.t AND g.k > 1 THEN g.ne ELSE len(c.emails) END::BIGINT AS n_emails
FROM c JOIN (SELECT t, count(*) AS k, sum(n) AS n, coalesce(string_agg(CASE WHEN id <> t THEN id::VARCHAR END, ',' ORDER BY id), '') AS absorbed, len(list_distinct(flatten(list(emails)))) AS ne FROM c GROUP BY t) g USING (t)""")
def merged_companies(spark: SparkSession, d: str) -> DataFrame:
    """Sources folded into targets, as a new snapshot."""
    c = companies(spark, d).select("id", "phones", "emails", F.array(F.lit("crm")).alias("sources"), F.array().cast("array<bigint>").alias("merged_from"), (F.col("id") % 4).alias("contact_count"), F.lit(None).cast("long").alias("merged_into"))
    plan = c.where("id % 10 in (7, 8)").select(F.col("id").alias("source"), (F.col("id") - F.when(F.col("id") % 10 == 7, 1).otherwise(2)).alias("target"))
    m = relations.merge_into(c, plan)
    return m.select("id", "merged_into", F.array_join(F.transform(F.col("merged_from"), lambda x: x.cast("string")), ",").alias("merged_from"), "contact_count", F.size("emails").cast("long").alias("n_emails"))


@query(f"WITH {COMPANIES} SELECT id, CASE WHEN id % 10 = 4 THEN 'spam' ELSE segment END AS segment, CASE WHEN id % 10 = 4 THEN 'spam prev_segment=' || segment ELSE '' END AS review_reason FROM companies")
def marked_spam(spark: SparkSession, d: str) -> DataFrame:
    """C14: marked twice and unmarked for some, as a new snapshot."""
    c = companies(spark, d).select("id", "segment", F.lit("").alias("review_reason"))
    once = relations.mark_spam(c, c.where("id % 10 in (4, 5)"))
    return relations.unmark_spam(relations.mark_spam(once, c.where("id % 10 = 4")), c.where("id % 10 = 5"))


@query(f"WITH {COMPANIES} SELECT id, CASE WHEN id % 6 = 0 THEN 'resolved' ELSE 'new' END AS status FROM companies UNION ALL SELECT max(id) + 1, 'resolved' FROM companies")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """C15, C16, E6."""
    c = companies(spark, d).select("id", F.lit("new").alias("status"))
    changes = c.where("id % 6 = 0").select("id").union(c.agg(F.max("id") + 1)).withColumn("status", F.lit("resolved"))
    return relations.upsert(c, changes, "id")


@query(f"""WITH {COMPANIES} SELECT id, coalesce(website, 'https://found' || id || '.ru/') AS website, array_to_string(list_sort(list_distinct(list_append(emails, 'hello@found' || (id % 3) || '.ru'))), ',') AS emails, coalesce(telegram, 'https://t.me/f' || id) AS telegram FROM companies WHERE id % 3 = 1
UNION ALL SELECT id, website, array_to_string(list_sort(emails), ','), telegram FROM companies WHERE id % 3 <> 1""")
def enriched_companies(spark: SparkSession, d: str) -> DataFrame:
    """Contacts found elsewhere fill gaps and extend lists."""
    c = companies(spark, d).select("id", "website", "emails", "phones", "messengers")
    k = F.col("id").cast("string")
    found = c.where("id % 3 = 1").select("id", F.concat(F.lit("https://found"), k, F.lit(".ru/")).alias("website"), F.array(F.concat(F.lit("hello@found"), (F.col("id") % 3).cast("string"), F.lit(".ru"))).alias("emails"), F.array().cast("array<string>").alias("phones"), F.create_map(F.lit("telegram"), F.concat(F.lit("https://t.me/f"), k)).alias("messengers"))
    e = relations.enrich(c, found)
    return e.select("id", "website", F.array_join(F.array_sort("emails"), ",").alias("emails"), F.try_element_at("messengers", F.lit("telegram")).alias("telegram"))


@query(f"WITH {COMPANIES}, {EVENTS} SELECT id AS company_id, CASE WHEN id IN (SELECT company_id FROM ev) THEN 'email_sent' ELSE 'new' END AS funnel_stage FROM companies")
def seeded_contacts(spark: SparkSession, d: str) -> DataFrame:
    """T13."""
    have = events(spark, d).select("company_id").distinct().withColumn("funnel_stage", F.lit("email_sent"))
    return relations.seed_missing(companies(spark, d), have)


@query(f"""WITH {EVENTS}, k AS (
  SELECT company_id, list({{'t': epoch_us(tm), 'id': event_id, 'tm': tm}} ORDER BY tm, event_id) AS l FROM ev GROUP BY company_id),
ok AS (SELECT company_id, l, list_reduce(list_prepend(l[1:0], list_transform(l, lambda x: [x])), lambda s, x: CASE WHEN len(list_filter(s, lambda y: y.t > x[1].t - 21600000000)) < 2 THEN list_concat(s, x) ELSE s END) AS got FROM k)
SELECT company_id::VARCHAR AS key, x.id AS request_id, x.tm AS "at", list_contains(list_transform(got, lambda y: y.id), x.id) AS admitted FROM (SELECT company_id, got, unnest(l) AS x FROM ok)""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """ST3: at most two admissions of a company in any six hours."""
    out = streams.rate_limited(events(spark, d).withColumnRenamed("event_id", "request_id"), "company_id", 2, 6 * 3600.0)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""WITH {EVENTS}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, tm, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * j AS window_start, kind AS key FROM ev, range(0, 4) r(j)) SELECT window_start, key, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def rolling_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """ST4, A12: sliding days, every six hours."""
    out = streams.rolling_counts(events(spark, d), "kind", "24 hours", "6 hours")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {COMPANIES} SELECT 'site' || (id % 97) AS domain, count(DISTINCT lower(city))::BIGINT AS n_cities, count(DISTINCT lower(city)) >= 3 AS flagged FROM companies GROUP BY ALL")
def domain_registry(spark: SparkSession, d: str) -> DataFrame:
    """ST5."""
    return streams.domain_registry(companies(spark, d).select(F.concat(F.lit("site"), (F.col("id") % 97).cast("string")).alias("domain"), "city"))


@query(f"""WITH {EVENTS}, f AS (SELECT DISTINCT 'd' || (k % 20) AS domain, tm AS failed_at FROM ev WHERE kind = 'error'), a AS (SELECT DISTINCT 'd' || (k % 20) AS domain, tm FROM ev WHERE kind = 'click')
SELECT a.domain, a.tm AS "at", coalesce(bool_or(failed_at <= tm AND epoch(tm) - epoch(failed_at) < 600), FALSE) AS skip FROM a LEFT JOIN f USING (domain) GROUP BY ALL""")
def failed_recently(spark: SparkSession, d: str) -> DataFrame:
    """ST6."""
    e = events(spark, d).withColumn("domain", F.concat(F.lit("d"), (F.col("k") % 20).cast("string")))
    out = streams.failed_recently(e.where("kind = 'click'").select("domain", "at"), e.where("kind = 'error'").select("domain", F.col("at").alias("failed_at")))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


_JUDGED_SQL = f"""WITH {COMPANIES}, v AS (SELECT id, CASE id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'spam' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'erase' END AS action, CASE WHEN id % 2 = 0 THEN 'looks bad' END AS reason, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN id ELSE id + 3 END AS target_id FROM companies WHERE id % 7 < 4),
j AS (SELECT v.*, CASE WHEN action = 'erase' THEN 'unknown_action' WHEN action = 'spam' AND reason IS NULL THEN 'no_reason' WHEN action = 'duplicate' AND target_id IS NULL THEN 'no_target' WHEN action = 'duplicate' AND target_id NOT IN (SELECT id FROM companies) THEN 'target_missing'
  WHEN action = 'duplicate' AND target_id = v.id THEN 'itself' WHEN action = 'duplicate' AND deleted THEN 'deleted' END AS refusal FROM v JOIN companies USING (id))"""


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("id")
    c = companies(spark, d).select("id", "segment", F.lit("open").alias("status"), F.lit(True).alias("needs_review"), F.lit("why").alias("review_reason"), F.lit(None).cast("long").alias("merged_into"), F.when(F.col("deleted"), F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"))
    action = F.when(k % 7 == 0, "approve").when(k % 7 == 1, "spam").when(k % 7 == 2, "duplicate").otherwise("erase")
    decisions = c.where("id % 7 < 4").select("id", action.alias("action"), F.when(k % 2 == 0, "looks bad").alias("reason"), F.when(k % 5 == 1, k).when(k % 5 > 1, k + 3).alias("target_id"))
    return c, review.judged(c, decisions)


@query(_JUDGED_SQL + " SELECT id, action, refusal FROM j")
def judged_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Which decisions can be carried out."""
    return _reviews(spark, d)[1].select("id", "action", "refusal")


@query(_JUDGED_SQL + """ SELECT c.id, CASE WHEN a = 'spam' THEN 'spam' ELSE segment END AS segment, CASE WHEN a = 'spam' THEN 'spam' ELSE 'open' END AS status, a IS NULL AS needs_review, CASE WHEN a = 'duplicate' THEN target_id END AS merged_into, coalesce(a IN ('spam', 'duplicate'), FALSE) OR deleted AS gone,
CASE a WHEN 'approve' THEN '' WHEN 'spam' THEN 'mark-spam:' || reason || ':prev_segment=' || segment WHEN 'duplicate' THEN 'duplicate_of:' || target_id ELSE 'why' END AS review_reason FROM (SELECT companies.*, j.action AS a, j.reason, j.target_id FROM companies LEFT JOIN j ON j.id = companies.id AND j.refusal IS NULL) c""")
def reviewed_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies after the decisions."""
    c, verdicts = _reviews(spark, d)
    out = review.reviewed(c, verdicts, last_time(events(spark, d), "at"))
    return out.withColumn("gone", F.col("deleted_at").isNotNull()).drop("deleted_at")


@query(f"""WITH {COMPANIES}, c AS (SELECT id, 'https://s' || (id % 60) || '.ru' AS website, CASE WHEN id % 60 % 4 = 0 THEN 'n' || (id % 3) ELSE 'n' END AS name, CASE WHEN id % 60 % 3 = 0 THEN city ELSE 'x' END AS city, (len(emails) > 0)::INT + (len(phones) > 0)::INT + (address <> '')::INT AS f FROM companies WHERE NOT deleted),
g AS (SELECT website, arg_max(id, f * 100000000 - id) AS target FROM c GROUP BY website HAVING count(*) > 1 AND count(DISTINCT city) = 1 AND count(DISTINCT name) = 1)
SELECT id AS source, target FROM c JOIN g USING (website) WHERE id <> target""")
def single_city_merges(spark: SparkSession, d: str) -> DataFrame:
    """Which companies of one site, city and name go into which."""
    k = F.col("id") % 60
    c = companies(spark, d).withColumn("website", F.concat(F.lit("https://s"), k.cast("string"), F.lit(".ru"))).withColumn("name", F.when(k % 4 == 0, F.concat(F.lit("n"), (F.col("id") % 3).cast("string"))).otherwise("n"))
    c = c.withColumn("city", F.when(k % 3 == 0, F.col("city")).otherwise("x")).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("x"))).withColumn("merged_into", F.lit(None).cast("long"))
    return review.single_city_plan(c)
