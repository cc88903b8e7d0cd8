"""What sends, opens, replies and bounces change, and clean-ups after them. Survey: C10, C21, C22, E8, T3, T8-T10, T12, T14, W7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.urls import normalize_messenger, website_root
from leadflow.operators.campaigns import WENT_OUT
from leadflow.operators.crm import bounce_effect
from leadflow.operators.relations import map_fill


def latest_log(logs: DataFrame, messages: DataFrame) -> DataFrame:
    """messages (email, ...) with the last log sent to their address: log_id, company_id, campaign_id, status. Nulls of sent_at come last."""
    last = logs.groupBy(F.lower("email").alias("_e")).agg(F.max_by(F.struct("log_id", "company_id", "campaign_id", "status"), F.struct(F.col("sent_at").isNotNull().alias("h"), "sent_at", "log_id")).alias("x"))
    return messages.withColumn("_e", F.lower(F.trim("email"))).join(last, "_e").select(*messages.columns, "x.*")


def _raised(rows: DataFrame, counts: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` raised by counts (key, _n)."""
    j = rows.join(counts, key, "left")
    return j.withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("_n", F.lit(0))).select(*rows.columns)


def bounce_effects(logs: DataFrame, campaigns: DataFrame, contacts: DataFrame, bounces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """logs, campaigns and contacts after bounces (email, code, at): each meets the last log of its address, once. T8.

    The log is bounced, its campaign has one more error, its contact is stopped or unreachable by the code. Of several
    bounces of a log the first by time counts; one that is bounced already does not.
    """
    hit = latest_log(logs, bounces).where("status <> 'bounced'")
    hit = hit.groupBy("log_id", "company_id", "campaign_id").agg(F.min_by("code", "at").alias("code"), F.min("at").alias("bounced_at"))
    marked = logs.join(hit.select("log_id", F.lit("bounced").alias("_s")), "log_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*logs.columns)
    n = hit.where("campaign_id is not null").groupBy("campaign_id").agg(F.count("*").alias("_n"))
    effect = hit.groupBy("company_id").agg(F.bool_or(bounce_effect(F.col("code")) == "stop").alias("_stop"), F.bool_or(bounce_effect(F.col("code")) == "unreachable").alias("_gone"))
    state = contacts.join(effect, "company_id", "left")
    state = state.withColumn("stop_automation", F.coalesce("stop_automation", F.lit(False)) | F.coalesce("_stop", F.lit(False)))
    state = state.withColumn("funnel_stage", F.when(F.coalesce("_gone", F.lit(False)), "unreachable").otherwise(F.col("funnel_stage")))
    return marked, _raised(campaigns, n, "campaign_id", "total_errors"), state.select(*contacts.columns)


def reply_effects(logs: DataFrame, campaigns: DataFrame, contacts: DataFrame, tasks: DataFrame, replies: DataFrame) -> dict[str, DataFrame]:
    """logs, campaigns, contacts, tasks and new touches after replies (email, at, subject, body; neither bounces nor out-of-office). T9.

    A log is answered once, by its first reply in time; its contact is `replied` and counts it, pending follow-ups of
    the company are cancelled, the campaign counts it, and the reply becomes an incoming touch of 2,000 characters at most.
    """
    hit = latest_log(logs, replies).where("status <> 'replied'")
    hit = hit.groupBy("log_id", "company_id", "campaign_id").agg(F.min_by(F.struct("at", "subject", "body"), "at").alias("x"))
    marked = logs.join(hit.select("log_id", F.lit("replied").alias("_s")), "log_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*logs.columns)
    by_company = hit.groupBy("company_id").agg(F.count("*").alias("_n"))
    state = contacts.join(by_company, "company_id", "left").withColumn("funnel_stage", F.when(F.col("_n") > 0, "replied").otherwise(F.col("funnel_stage")))
    state = state.withColumn("email_replied_count", F.coalesce("email_replied_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).select(*contacts.columns)
    open_ = (F.col("status") == "pending") & (F.col("task_type") == "follow_up") & F.col("_n").isNotNull()
    left = tasks.join(by_company, "company_id", "left").withColumn("status", F.when(open_, "cancelled").otherwise(F.col("status"))).select(*tasks.columns)
    n = hit.where("campaign_id is not null").groupBy("campaign_id").agg(F.count("*").alias("_n"))
    touches = hit.select("company_id", "x.at", F.lit("email").alias("channel"), F.lit("incoming").alias("direction"), "x.subject", F.substring(F.coalesce("x.body", F.lit("")), 1, 2000).alias("body"))
    return {"logs": marked, "campaigns": _raised(campaigns, n, "campaign_id", "total_replied"), "contacts": state, "tasks": left, "touches": touches}


def open_effects(first_opens: DataFrame, sends: DataFrame, contacts: DataFrame, campaigns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contacts and campaigns after first counted opens (tracking_id, opened_at). T10.

    sends: tracking_id, company_id, campaign_id. A contact counts its opens, keeps the last, and moves from email_sent to
    email_opened; a campaign counts its opens.
    """
    hit = first_opens.where("opened_at is not null").join(sends, "tracking_id")
    by = hit.groupBy("company_id").agg(F.count("*").alias("_n"), F.max("opened_at").alias("_at"))
    state = contacts.join(by, "company_id", "left").withColumn("email_opened_count", F.coalesce("email_opened_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    state = state.withColumn("funnel_stage", F.when((F.col("_n") > 0) & (F.col("funnel_stage") == "email_sent"), "email_opened").otherwise(F.col("funnel_stage")))
    state = state.withColumn("last_email_opened_at", F.coalesce("_at", "last_email_opened_at")).select(*contacts.columns)
    n = hit.where("campaign_id is not null").groupBy("campaign_id").agg(F.count("*").alias("_n"))
    return state, _raised(campaigns, n, "campaign_id", "total_opened")


def messenger_touches(sends: DataFrame, companies: DataFrame) -> DataFrame:
    """Outgoing touches of messages (company_id, channel, text, ok, at) that went out by tg or wa to companies that exist. T12."""
    went = sends.where(F.col("ok") & F.col("channel").isin("tg", "wa") & (F.coalesce("text", F.lit("")) != ""))
    return went.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi").select("company_id", "at", "channel", F.lit("outgoing").alias("direction"), F.col("text").alias("body"))


def touch_log(log: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """The touch log with new touches appended and deleted ones (touch_id) left out. T3."""
    return log.unionByName(new, allowMissingColumns=True).join(deleted.select("touch_id").distinct(), "touch_id", "left_anti")


def touch_history(log: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of each company's touches, newest first (ties: largest id), with how many it has. T3: a page is a limit."""
    n = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("at").desc_nulls_last(), F.col("touch_id").desc()))
    total = log.groupBy("company_id").agg(F.count("*").alias("total"))
    ranked = log.withColumn("pos", n).where(F.col("pos").between((page - 1) * per_page + 1, page * per_page))
    return ranked.join(total, "company_id")


def emails_from_arrays(companies: DataFrame, logs: DataFrame) -> DataFrame:
    """company_emails (company_id, email, is_active, is_primary, sent_count) of the addresses in companies' arrays. T14.

    Addresses are trimmed, lower-cased and kept once, the first is primary; one that its company was written to is
    inactive with one send.
    """
    each = companies.select(F.col("id").alias("company_id"), F.posexplode("emails").alias("p", "e")).select("company_id", "p", F.lower(F.trim("e")).alias("email")).where("email <> ''")
    each = each.groupBy("company_id", "email").agg(F.min("p").alias("p"))
    first = each.groupBy("company_id").agg(F.min("p").alias("_first"))
    sent = logs.where(F.col("status").isin(*WENT_OUT)).select("company_id", F.col("email")).distinct().withColumn("_sent", F.lit(True))
    j = each.join(first, "company_id").join(sent, ["company_id", "email"], "left").withColumn("_sent", F.coalesce("_sent", F.lit(False)))
    return j.select("company_id", "email", (~F.col("_sent")).alias("is_active"), (F.col("p") == F.col("_first")).alias("is_primary"), F.col("_sent").cast("int").alias("sent_count"))


def deactivate_mailed(emails: DataFrame, logs: DataFrame) -> DataFrame:
    """company_emails (id, ...) after every active address that anybody was written at is switched off. T14, W7.

    A company that thereby loses its primary gets its first active address (by id) as the new one.
    """
    sent = logs.where(F.col("status").isin(*WENT_OUT)).select("email").distinct().withColumn("_sent", F.lit(True))
    j = emails.join(sent, "email", "left").withColumn("_off", F.col("is_active") & F.coalesce("_sent", F.lit(False)))
    j = j.withColumn("is_active", F.col("is_active") & ~F.col("_off")).withColumn("_lost", F.col("_off") & F.col("is_primary"))
    by = j.groupBy("company_id").agg(F.bool_or("_lost").alias("_any"), F.min(F.when(F.col("is_active"), F.col("id"))).alias("_next"))
    j = j.join(by, "company_id")
    return j.withColumn("is_primary", (F.col("is_primary") & ~F.col("_lost")) | (F.col("_any") & F.coalesce(F.col("id") == F.col("_next"), F.lit(False)))).select(*emails.columns)


def normalised_after_merge(rows: DataFrame) -> DataFrame:
    """Merged rows with messenger links in one form, websites at their root and no URL as an address. C10."""
    kinds = ("telegram", "whatsapp")
    rest = F.map_filter("messengers", lambda k, v: ~k.isin(*kinds))
    found = F.array_compact(F.array(*(F.when(F.map_contains_key("messengers", F.lit(k)), F.struct(F.lit(k).alias("k"), normalize_messenger(F.element_at("messengers", F.lit(k)), k).alias("v"))) for k in kinds)))
    url = F.col("address").startswith("http") | F.col("address").startswith("www.")
    return rows.withColumns({
        "messengers": F.map_concat(F.map_from_entries(found), rest), "address": F.when(url, "").otherwise(F.coalesce("address", F.lit(""))),
        "website": F.when(F.coalesce("website", F.lit("")) != "", website_root(F.col("website"))),
    })


def delete_spam_sites(companies: DataFrame, domains: tuple[str, ...], now: Column) -> DataFrame:
    """companies whose website holds a spam domain anywhere, marked deleted, for review, as spam, outside networks and without a score. C21."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.lower("website").contains(d)
    hit = F.coalesce(hit, F.lit(False))
    new = {
        "deleted_at": now, "needs_review": F.lit(True), "review_reason": F.trim(F.concat(F.coalesce("review_reason", F.lit("")), F.lit(" spam_domain_cleanup"))),
        "segment": F.lit("spam"), "is_network": F.lit(False), "score": F.lit(0),
    }
    return companies.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(t).alias(c) if c in new else F.col(c) for c, t in companies.dtypes))


def repair_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, column, before, after) of each value that a repair would change: the dry run. C22."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    text = lambda df, as_: df.select(key, F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns))).alias(as_))
    j = text(before, "b").join(text(after, "a"), key)
    each = j.select(key, F.explode(F.array(*map(F.lit, columns))).alias("column"), "b", "a")
    each = each.select(key, "column", F.element_at("b", F.col("column")).alias("before"), F.element_at("a", F.col("column")).alias("after"))
    return each.where(~F.col("before").eqNullSafe(F.col("after")))


def backfill_messengers(companies: DataFrame, listings: DataFrame) -> DataFrame:
    """companies with messengers that listings of the same city and name key add to theirs; their own links stay. E8.

    listings: city, key, listing_id, messengers; of several listings of a key, the first by id.
    """
    first = listings.groupBy("city", "key").agg(F.min_by("messengers", "listing_id").alias("_m"))
    j = companies.join(first, ["city", "key"], "left")
    return j.withColumn("messengers", map_fill(F.col("messengers"), F.col("_m"))).select(*companies.columns)
