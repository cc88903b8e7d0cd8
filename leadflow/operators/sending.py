"""What a round of sending may send, and the follow-up tasks around it. Survey: M9, A12, M10, T5, T6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.values import TERMINAL_STAGES


def sent_last_day(logs: DataFrame, now: Column) -> DataFrame:
    """One row, `n`: messages (sent_at) of the 24 hours before now. A12."""
    return logs.where((F.col("sent_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("sent_at") <= now)).agg(F.count("*").alias("n"))


def send_plan(campaigns: DataFrame, queue: DataFrame, logs: DataFrame, now: Column, per_run: int = 25, per_day: int = 150) -> DataFrame:
    """(campaign_id, ordinal, company_id, email, decision) of the first `per_run` rows of each running campaign's queue. M9, A12.

    campaigns: campaign_id, priority, status; queue: campaign_id, ordinal, company_id, email, has_contact; logs: sent_at.
    Campaigns run in order of priority (then id) and share what the rolling day still allows. A row is `send`, `error`
    (no contact: it takes a place of the run, none of the day) or `day_limit`: the first row that the day has no place
    for ends its campaign's run, so all rows behind it are.

    Only the first rows of a queue are ranked, and of the campaigns only the first `per_day` that send anything can use
    up the day, so the one window over campaigns holds that many rows at most.
    """
    live = campaigns.where("status = 'running'").select("campaign_id", "priority")
    run = queue.join(live, "campaign_id").withColumn("_n", F.row_number().over(Window.partitionBy("campaign_id").orderBy("ordinal"))).where(F.col("_n") <= per_run)
    before = Window.partitionBy("campaign_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = run.withColumn("_k", F.sum(F.col("has_contact").cast("int")).over(before))
    wants = run.groupBy("campaign_id", "priority").agg(F.max("_k").alias("_wants")).where("_wants > 0")
    first = wants.orderBy("priority", "campaign_id").limit(per_day + 1)
    used = F.sum("_wants").over(Window.orderBy("priority", "campaign_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = first.select("campaign_id", F.coalesce(used, F.lit(0)).alias("_used"))
    left = sent_last_day(logs, now).select(F.greatest(F.lit(0), per_day - F.col("n")).alias("_left"))
    j = run.join(F.broadcast(taken), "campaign_id", "left").crossJoin(F.broadcast(left))  # one row
    used = F.least(F.coalesce("_used", F.col("_left")), F.col("_left"))
    place = used + F.col("_k")
    decision = F.when(F.col("has_contact"), F.when(place <= F.col("_left"), "send").otherwise("day_limit")).otherwise(F.when(place <= F.col("_left"), "error").otherwise("day_limit"))
    return j.select("campaign_id", "ordinal", "company_id", "email", decision.alias("decision"))


def campaigns_after(campaigns: DataFrame, queue: DataFrame, plan: DataFrame) -> DataFrame:
    """campaigns (campaign_id, status, total_sent, total_errors) after a round: paused_daily_limit, paused (rows are left) or completed. M9."""
    waiting = queue.groupBy("campaign_id").agg(F.count("*").alias("_all"))
    done = plan.groupBy("campaign_id").agg(F.count("*").alias("_run"), F.count_if(F.col("decision") == "send").alias("_sent"), F.count_if(F.col("decision") == "error").alias("_errors"), F.bool_or(F.col("decision") == "day_limit").alias("_cut"))
    j = campaigns.join(waiting, "campaign_id", "left").join(done, "campaign_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(F.coalesce("_cut", F.lit(False)), "paused_daily_limit").when(z("_all") > z("_run"), "paused").otherwise("completed")
    j = j.withColumn("status", F.when(F.col("status") == "running", status).otherwise(F.col("status")))
    return j.withColumn("total_sent", z("total_sent") + z("_sent")).withColumn("total_errors", z("total_errors") + z("_errors")).select(*campaigns.columns)


def emails_after(emails: DataFrame, plan: DataFrame) -> DataFrame:
    """company_emails (id, company_id, email, is_active, is_primary, sent_count) after the sends of a plan. M9, W7.

    An address that was written at is switched off, at its own company with one more send and at all others; a company
    whose primary address goes gets its first active one by id.
    """
    sent = plan.where("decision = 'send'")
    own = sent.select("company_id", "email").distinct().withColumn("_own", F.lit(True))
    any_ = sent.select("email").distinct().withColumn("_any", F.lit(True))
    j = emails.join(own, ["company_id", "email"], "left").join(any_, "email", "left")
    off = F.col("is_active") & F.coalesce("_any", F.lit(False))
    j = j.withColumn("_off", off).withColumn("sent_count", F.coalesce("sent_count", F.lit(0)) + F.when(F.col("_off") & F.coalesce("_own", F.lit(False)), 1).otherwise(0))
    j = j.withColumn("is_active", F.col("is_active") & ~F.col("_off")).withColumn("_lost", F.col("_off") & F.col("is_primary"))
    by = j.groupBy("company_id").agg(F.bool_or("_lost").alias("_someone"), F.min(F.when(F.col("is_active"), F.col("id"))).alias("_next"))
    j = j.join(by, "company_id")
    return j.withColumn("is_primary", (F.col("is_primary") & ~F.col("_lost")) | (F.col("_someone") & F.coalesce(F.col("id") == F.col("_next"), F.lit(False)))).select(*emails.columns)


def followups_after(tasks: DataFrame, contacts: DataFrame, opens: DataFrame, days: int = 7) -> DataFrame:
    """tasks (task_id, company_id, task_type, status, due_at) after contacts' stages and first opens (company_id, opened_at). T5, T6.

    Pending follow-ups of companies at a terminal stage are cancelled. Then each company with a first open and without a
    pending follow-up gets one (without an id yet), due `days` after its first open.
    """
    ended = contacts.where(F.col("funnel_stage").isin(*TERMINAL_STAGES)).select("company_id").distinct().withColumn("_ended", F.lit(True))
    open_ = (F.col("status") == "pending") & (F.col("task_type") == "follow_up")
    kept = tasks.join(ended, "company_id", "left").withColumn("status", F.when(open_ & F.coalesce("_ended", F.lit(False)), "cancelled").otherwise(F.col("status"))).select(*tasks.columns)
    first = opens.where("opened_at is not null").groupBy("company_id").agg(F.min("opened_at").alias("at"))
    fresh = first.join(kept.where(open_).select("company_id").distinct(), "company_id", "left_anti")
    fresh = fresh.select("company_id", F.lit("follow_up").alias("task_type"), F.lit("pending").alias("status"), (F.col("at") + F.expr(f"INTERVAL {days} DAYS")).alias("due_at"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def is_stale(updated: Column, started: Column, created: Column, now: Column, minutes: int = 10) -> Column:
    """Whether a running campaign has not moved for some minutes. M10."""
    return F.greatest(updated, started, created) < now - F.expr(f"INTERVAL {minutes} MINUTES")
