"""Campaign tables: recipients with status, network addresses, task lists, counters, value lists. Survey: F21, M6-M8, M11, N3, A31, A36, A39, S2, S5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of messages that went out.
WENT_OUT = ("sent", "opened", "replied", "bounced")


def recipient_status(recipients: DataFrame, companies: DataFrame, logs: DataFrame) -> DataFrame:
    """Recipients (campaign_id, company_id, email) with name and the status of their last log (log_id, sent_at nulls last). M8, J6, J7."""
    last = logs.groupBy("campaign_id", "company_id", F.lower("email").alias("_e")).agg(F.max_by("status", F.struct(F.col("sent_at").isNotNull().alias("h"), "sent_at", "log_id")).alias("status"))
    j = recipients.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id").withColumn("_e", F.lower("email"))
    return j.join(last, ["campaign_id", "company_id", "_e"], "left").drop("_e")


def network_recipients(emails: DataFrame, disabled: DataFrame, logs: DataFrame, taken: DataFrame, owners: DataFrame) -> DataFrame:
    """(email, company_id, reason) of a network's addresses: why one is skipped, or whose it is (0: nobody's). M6, J17.

    emails, disabled, taken: email; logs: email, status; owners: company_id, emails.
    """
    low = lambda df: df.select(F.lower(F.trim("email")).alias("email")).distinct()
    mark = lambda df, name: low(df).withColumn(name, F.lit(True))
    j = low(emails).join(mark(disabled, "_off"), "email", "left").join(mark(logs.where(F.col("status").isin(*WENT_OUT)), "_sent"), "email", "left").join(mark(taken, "_in"), "email", "left")
    own = owners.select("company_id", F.explode("emails").alias("e")).groupBy(F.lower("e").alias("email")).agg(F.min("company_id").alias("company_id"))
    reason = F.when(F.col("_off"), "disabled").when(F.col("_sent"), "already_mailed").when(F.col("_in"), "in_campaign")
    return j.withColumn("reason", reason).join(own, "email", "left").select("email", F.when(F.col("reason").isNull(), F.coalesce("company_id", F.lit(0))).alias("company_id"), "reason")


def task_list(tasks: DataFrame, companies: DataFrame, include_unlinked: bool = False, **equal: str) -> DataFrame:
    """Tasks of live companies with their names; orphans only if asked for; no due date comes last. F21, J5, S2."""
    j = tasks.join(companies.select(F.col("id").alias("company_id"), "name", "deleted_at", F.lit(True).alias("_there")), "company_id", "left")
    j = j.where(F.col("_there").isNull() | F.col("deleted_at").isNull())
    if not include_unlinked:
        j = j.where("company_id is not null")
    for column, value in equal.items():
        j = j.where(F.col(column) == value)
    return j.orderBy(F.col("due_at").asc_nulls_last(), "created_at", "task_id").drop("deleted_at", "_there")


def progress_total(status: Column, recipients: Column, sent: Column, logs: Column) -> Column:
    """How many messages a campaign counts with. M11."""
    n, s = F.coalesce(recipients, F.lit(0)), F.coalesce(sent, F.lit(0))
    moving = status.isin("running", "paused", "paused_daily_limit")
    return F.when(status == "completed", F.when(n > 0, n).otherwise(s)).when((n == 0) & moving & (s > 0), F.greatest(s, F.coalesce(logs, F.lit(0)))).otherwise(n)


def recount(campaigns: DataFrame, logs: DataFrame) -> DataFrame:
    """campaigns with counters brought in line with their logs: replies counted, errors and recipients never lowered. A31."""
    n = logs.groupBy("campaign_id").agg(F.count_if(F.col("status") == "replied").alias("_r"), F.count_if(F.col("status") == "bounced").alias("_b"), F.count_if(F.col("status").isin(*WENT_OUT)).alias("_s"))
    j = campaigns.join(n, "campaign_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    j = j.withColumn("total_replied", z("_r")).withColumn("total_errors", F.greatest(z("total_errors"), z("_b"))).withColumn("total_recipients", F.greatest(z("total_recipients"), z("_s")))
    return j.select(*campaigns.columns)


def network_list(networks: DataFrame, logs: DataFrame, least: int = 2, kind: str | None = None, contact: str | None = None) -> DataFrame:
    """Networks (base_domain, network_type, emails, company_count) with what was sent to their addresses. N3, A13."""
    sent = logs.where(F.col("status").isin(*WENT_OUT)).groupBy(F.lower("email").alias("e")).agg(F.count("*").alias("n"))
    each = networks.select("base_domain", F.explode("emails").alias("e")).withColumn("e", F.lower("e")).join(sent, "e").groupBy("base_domain").agg(F.sum("n").alias("sent_count"))
    j = networks.where(F.col("company_count") >= least).join(each, "base_domain", "left").withColumn("sent_count", F.coalesce("sent_count", F.lit(0)))
    j = j.withColumn("contact_status", F.when(F.col("sent_count") > 0, "sent").otherwise("none"))
    if kind:
        j = j.where(F.col("network_type") == kind)
    return j.where(F.col("contact_status") == contact) if contact else j


def values_of(rows: DataFrame, column: str, fallback: DataFrame | None = None, skip: tuple[str, ...] = ("",)) -> DataFrame:
    """Distinct values of a column or of the elements of an array column, without the skipped; those of fallback where there are none. A36."""
    one = lambda df: df.select((F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)).alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin(*skip)).distinct()
    own = one(rows)
    if fallback is None:
        return own
    return one(fallback) if own.isEmpty() else own


def city_status(cities: DataFrame, raw: DataFrame, companies: DataFrame) -> DataFrame:
    """(region, city, n_raw, n_companies, populated) of every known city, by region and name. A39, F28."""
    n = lambda df, name: df.groupBy("city").agg(F.count("*").alias(name))
    j = cities.select("region", F.col("name").alias("city")).join(n(raw, "n_raw"), "city", "left").join(n(companies, "n_companies"), "city", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("region", "city", z("n_raw"), z("n_companies"), (F.coalesce("n_companies", F.lit(0)) > 0).alias("populated")).orderBy("region", "city")
