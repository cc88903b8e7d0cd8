"""Contacts: stage fold, follow-ups, recipients, opens, bounces, replies. Survey: T1-T12, M1-M11, J7, A11, A13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.emails import is_ascii, recipient_format
from leadflow.functions.values import CADENCE, TERMINAL_STAGES


#: Stages that a tg message changes, and those that a wa message leaves.
_BEFORE_TG = ("new", "email_sent", "email_opened")
_NOT_WA = ("replied", "interested", "not_interested", "tg_sent")


def stage_reached(start: Column, answered: Column, mailed: Column, first_tg: Column, first_wa: Column) -> Column:
    """The stage that a contact's touches lead to from `start`. T1, T2.

    Touch by touch the rules are: an answer makes `replied` of all but decided stages; a mail makes `email_sent` of
    `new`; a tg message makes `tg_sent` of the three stages before it; a wa message makes `wa_sent` of all but answered,
    decided and tg stages. No rule leaves `replied`, `tg_sent` or `wa_sent` again but an answer, so order matters only
    between the first tg and the first wa message, and touches need not be gathered or sorted: whether there was an
    answer, whether there was a mail, and the two first places (null: none) decide.
    """
    tg_first = first_tg.isNotNull() & (first_wa.isNull() | (first_tg < first_wa))
    sent = (
        F.when(start.isin(*_BEFORE_TG) & tg_first, "tg_sent")
        .when(~start.isin(*_NOT_WA) & first_wa.isNotNull(), "wa_sent")
        .when((start == "new") & mailed, "email_sent")
        .otherwise(start)
    )
    return F.when(answered, F.when(start.isin("interested", "not_interested"), start).otherwise("replied")).otherwise(sent)


def fold_touches(touches: DataFrame, start: str = "new") -> DataFrame:
    """One contact for each company from its touches (touch_id, company_id, at, channel, direction) in time order. T1, T2, ST7.

    One aggregate with a small fixed state, batch or stream: a company with a third of all touches is summed up by every
    task before the shuffle, and touches may come in any order. A touch without direction went out, but is not counted.
    """
    incoming = F.coalesce(F.col("direction") == "incoming", F.lit(False))
    out = lambda c: (F.col("channel") == c) & ~incoming
    sent = lambda c: F.count_if((F.col("channel") == c) & (F.col("direction") != "incoming"))
    first = lambda c: F.min(F.when(out(c), F.struct("at", "touch_id")))
    by = touches.groupBy("company_id").agg(
        first("tg").alias("_tg"), first("wa").alias("_wa"), F.coalesce(F.bool_or(out("email")), F.lit(False)).alias("_mail"), F.count("*").alias("contact_count"), sent("email").alias("email_sent_count"),
        sent("tg").alias("tg_sent_count"), sent("wa").alias("wa_sent_count"), F.min("at").alias("first_contact_at"), F.max("at").alias("last_contact_at"), F.bool_or(F.col("direction") == "incoming").alias("stop_automation"), F.bool_or(incoming).alias("_in"),
    )
    stage = stage_reached(F.lit(start), F.col("_in"), F.col("_mail"), F.col("_tg"), F.col("_wa"))
    return by.select("company_id", stage.alias("funnel_stage"), "contact_count", "email_sent_count", "tg_sent_count", "wa_sent_count", "first_contact_at", "last_contact_at", "stop_automation")


def days_between(now: Column, at: Column) -> Column:
    """Whole days of 24 hours. X47."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400).cast("long")


def followup_queue(contacts: DataFrame, now: Column) -> DataFrame:
    """Contacts that are due, with channel, template and order of work. T4.

    contacts: company_id, funnel_stage, stop_automation, last_contact_at, email_sent_count, telegram, whatsapp, score.
    """
    rules = contacts.sparkSession.createDataFrame(list(CADENCE), "funnel_stage string, _days int, _channel string, _template string")
    j = contacts.where(~F.coalesce("stop_automation", F.lit(False))).join(F.broadcast(rules), "funnel_stage")
    days = days_between(now, F.col("last_contact_at"))
    due = (F.col("_days") == 0) | F.col("last_contact_at").isNull() | (days >= F.col("_days"))
    fresh = (F.col("funnel_stage") != "new") | (F.coalesce("email_sent_count", F.lit(0)) == 0)
    tg, wa = F.coalesce("telegram", F.lit("")) != "", F.coalesce("whatsapp", F.lit("")) != ""
    swap = (F.col("_channel") == "tg") & ~tg & wa
    reach = F.when(swap, True).when(F.col("_channel") == "tg", tg).when(F.col("_channel") == "wa", wa).otherwise(F.lit(True))
    return j.where(due & fresh).select(
        "company_id", "funnel_stage", F.coalesce(days, F.lit(999)).alias("days_since"), F.when(swap, "wa").otherwise(F.col("_channel")).alias("channel"),
        reach.alias("available"), F.when(swap, "wa_intro").otherwise(F.col("_template")).alias("template"), F.coalesce("score", F.lit(0)).alias("score"),
    )


def recipient_reasons(
    candidates: DataFrame, sent: DataFrame, blocked: DataFrame, now: Column, aggregators: tuple[str, ...] = (), gap_hours: int | None = 1, by_contact: bool = True
) -> DataFrame:
    """candidates with `reason`: why an address is not written to, null where it is; the first cause in order. M4.

    candidates: ordinal, company_id, name, email, stop_automation, email_sent_count, last_email_sent_at. sent: email;
    blocked: domain. An address counts as a repeat from its second row on, whatever became of the first.
    """
    low = F.lower(F.trim("email"))
    c = candidates.withColumn("_e", low).withColumn("_d", F.lower(F.substring_index("email", "@", -1)))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("_e").orderBy("ordinal")))
    c = c.join(sent.select(F.lower("email").alias("_e")).distinct().withColumn("_sent", F.lit(True)), "_e", "left")
    c = c.join(blocked.select(F.col("domain").alias("_d")).distinct().withColumn("_blocked", F.lit(True)), "_d", "left")
    name = F.trim(F.coalesce("name", F.lit("")))
    recent = F.lit(False) if gap_hours is None else F.coalesce(F.col("last_email_sent_at") > now - F.expr(f"INTERVAL {gap_hours} HOURS"), F.lit(False))
    reason = (
        F.when(F.col("_n") > 1, "duplicate_email")
        .when(F.coalesce("_sent", F.lit(False)), "already_mailed")
        .when(F.lit(by_contact) & (F.coalesce("email_sent_count", F.lit(0)) > 0), "contact_mailed")
        .when(~recipient_format(F.col("email")), "bad_format")
        .when(~is_ascii(F.col("email")), "not_ascii")
        .when(F.col("_d").isin(*aggregators) if aggregators else F.lit(False), "aggregator")
        .when(F.coalesce("_blocked", F.lit(False)), "blocked_domain")
        .when(F.coalesce("stop_automation", F.lit(False)), "stopped")
        .when(name == "", "no_name")
        .when(F.length(name) > 80, "long_name")
        .when(recent, "too_soon")
    )
    return c.withColumn("reason", reason).select(*candidates.columns, "reason")


def campaign_candidates(companies: DataFrame, emails: DataFrame, logged: DataFrame, cities: tuple[str, ...] = (), segment: str | None = None, least_score: int | None = None) -> DataFrame:
    """Filter-mode recipients: (company_id, email), the first active address of each company, each address once. M1, M2.

    companies: company_id, city, segment, score, stop_automation, deleted_at; emails: id, company_id, email, is_active,
    is_primary; logged: company_id of companies that the campaign already wrote to.
    """
    c = companies.where(F.col("deleted_at").isNull() & ~F.coalesce("stop_automation", F.lit(False)))
    if cities:
        c = c.where(F.col("city").isin(*cities))
    if segment:
        c = c.where(F.col("segment") == segment)
    if least_score is not None:
        c = c.where(F.col("score") >= least_score)
    c = c.select("company_id").join(logged.select("company_id").distinct(), "company_id", "left_anti")
    first = emails.where("is_active").groupBy("company_id").agg(F.min_by("email", F.struct((~F.col("is_primary")).alias("p"), "id")).alias("email"))
    own = c.join(first, "company_id")
    return own.groupBy(F.lower("email").alias("_e")).agg(F.min_by(F.struct("company_id", "email"), "company_id").alias("x")).select("x.*")


def add_recipients(wanted: DataFrame, taken: DataFrame, mailed: DataFrame) -> DataFrame:
    """(ordinal, company_id, email, reason) of asked-for recipients; null reason: added. M5.

    wanted: ordinal, company_id, live, stopped, emails. A company's own check comes first; an address then goes to the
    first company in order that passes it. taken: company_id already in the campaign; mailed: email.
    """
    c = wanted.join(taken.select("company_id").distinct().withColumn("_in", F.lit(True)), "company_id", "left")
    own = (
        F.when(F.coalesce("_in", F.lit(False)), "in_campaign")
        .when(~F.coalesce("live", F.lit(False)), "missing")
        .when(F.coalesce("stopped", F.lit(False)), "stopped")
        .when(F.coalesce(F.size("emails"), F.lit(0)) <= 0, "no_email")
    )
    c = c.withColumn("_own", own)
    rejected = c.where("_own is not null").select("ordinal", "company_id", F.lit(None).cast("string").alias("email"), F.col("_own").alias("reason"))
    each = c.where("_own is null").select("ordinal", "company_id", F.explode(F.array_distinct(F.transform("emails", F.lower))).alias("email"))
    each = each.join(mailed.select(F.lower("email").alias("email")).distinct().withColumn("_m", F.lit(True)), "email", "left")
    claim = F.row_number().over(Window.partitionBy("email").orderBy("ordinal"))
    reason = F.when(F.coalesce("_m", F.lit(False)), "already_mailed").when(claim > 1, "claimed")
    return rejected.unionByName(each.withColumn("reason", reason).select("ordinal", "company_id", "email", "reason"))


def first_valid_opens(opens: DataFrame, sends: DataFrame, guard_seconds: int = 30, agents: str = r"(?i)bot|crawler|spider|preview|proxy") -> DataFrame:
    """(tracking_id, opened_at, suspicious) of the first counted open of each send. T10, F27.

    opens: tracking_id, at, agent; sends: tracking_id, sent_at. Robots do not count; an open within the guard is only
    suspicious, and a later one still opens.
    """
    j = opens.where(~F.coalesce(F.col("agent").rlike(agents), F.lit(False))).join(sends, "tracking_id")
    early = F.unix_timestamp("at") - F.unix_timestamp("sent_at") <= guard_seconds
    return j.groupBy("tracking_id").agg(F.min(F.when(~early, F.col("at"))).alias("opened_at"), F.bool_or(early).alias("suspicious"))


def bounce_effect(code: Column) -> Column:
    """stop for a policy refusal, none for a full box, unreachable for the rest. T8."""
    return F.when(code.startswith("5.7.1"), "stop").when(code.startswith("5.2.2"), "none").otherwise("unreachable")


def apply_bounces(contacts: DataFrame, bounces: DataFrame) -> DataFrame:
    """contacts after bounces (log_id, company_id, code); each log counts once. T8."""
    b = bounces.dropDuplicates(["log_id"]).groupBy("company_id").agg(F.bool_or(bounce_effect(F.col("code")) == "stop").alias("_stop"), F.bool_or(bounce_effect(F.col("code")) == "unreachable").alias("_gone"))
    j = contacts.join(b, "company_id", "left")
    j = j.withColumn("stop_automation", F.coalesce("stop_automation", F.lit(False)) | F.coalesce("_stop", F.lit(False)))
    return j.withColumn("funnel_stage", F.when(F.coalesce("_gone", F.lit(False)), "unreachable").otherwise(F.col("funnel_stage"))).select(*contacts.columns)


def apply_replies(contacts: DataFrame, replies: DataFrame) -> DataFrame:
    """contacts after replies (company_id, is_bounce, is_out_of_office): stage replied unless decided, automation stops. T9, T11."""
    r = replies.where(~F.coalesce("is_bounce", F.lit(False)) & ~F.coalesce("is_out_of_office", F.lit(False))).select("company_id").distinct().withColumn("_r", F.lit(True))
    on = F.coalesce("_r", F.lit(False))
    j = contacts.join(r, "company_id", "left").withColumn("stop_automation", F.coalesce("stop_automation", F.lit(False)) | on)
    return j.withColumn("funnel_stage", F.when(on & ~F.col("funnel_stage").isin("interested", "not_interested"), "replied").otherwise(F.col("funnel_stage"))).select(*contacts.columns)


def due_followups(tasks: DataFrame, contacts: DataFrame, now: Column, most_tries: int = 3) -> DataFrame:
    """(task_id, decision): done, cancelled, failed or send for pending tasks that are due. T5-T7, X40.

    tasks: task_id, company_id, due_at, status, note (a retry count as [retry:n]).
    """
    tries = F.coalesce(F.regexp_extract(F.coalesce("note", F.lit("")), r"\[retry:(\d+)\]", 1).try_cast("int"), F.lit(0))
    j = tasks.where((F.col("status") == "pending") & (F.col("due_at") <= now)).join(contacts, "company_id", "left")
    return j.select("task_id", F.when(F.col("funnel_stage").isNull(), "cancelled").when(F.coalesce("stop_automation", F.lit(False)), "cancelled").when(F.col("funnel_stage").isin(*TERMINAL_STAGES), "done").when(tries >= most_tries, "failed").otherwise("send").alias("decision"))
