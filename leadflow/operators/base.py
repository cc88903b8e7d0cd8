"""The relation that every listing starts from, its pages, and what is shown of it. Survey: F4, F12, F18, F26, J1-J3, L1-L4, M3, M7, N4, P2, P4, P5, S3, S5, A26, SRC17.

companies: id, name, city, ..., deleted_at and merged_into where rows may be dead; enriched and contacts share its ids
one to one, so the three are joined on one key and a partitioning by it serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.operators.campaigns import WENT_OUT
from leadflow.plans.ordered import placed


def live(rows: DataFrame) -> DataFrame:
    """Rows that are neither deleted nor merged into others. F26."""
    for c in ("deleted_at", "merged_into"):
        if c in rows.columns:
            rows = rows.where(F.col(c).isNull())
    return rows


def base_relation(companies: DataFrame, enriched: DataFrame, contacts: DataFrame, with_contact: bool = False, key: str = "id") -> DataFrame:
    """companies with what is known of them and their contact state. J1; with_contact: only those that have a contact, J2."""
    own = enriched.select(key, *(c for c in enriched.columns if c not in companies.columns))
    state = contacts.withColumnRenamed("company_id", key)
    state = state.select(key, *(c for c in state.columns if c not in (*companies.columns, *own.columns)))
    return companies.join(own, key, "left").join(state, key, "inner" if with_contact else "left")


def enriched_of_live(companies: DataFrame, enriched: DataFrame, key: str = "id") -> DataFrame:
    """enriched of live companies. J3."""
    return enriched.join(live(companies).select(key), key, "left_semi")


def with_empties(rows: DataFrame) -> DataFrame:
    """Null arrays and maps as empty ones. P2."""
    fill = {"array": lambda c, t: F.coalesce(c, F.array().cast(t)), "map": lambda c, t: F.coalesce(c, F.create_map().cast(t))}
    return rows.select(*(fill[t.split("<")[0]](F.col(c), t).alias(c) if t.split("<")[0] in fill else F.col(c) for c, t in rows.dtypes))


#: Columns of listings; a relation shows those that it has. P4, P5.
LISTINGS = {
    "snapshot": ("id", "name", "phones", "address", "website", "emails", "messengers", "city", "region", "segment"),
    "campaigns": ("campaign_id", "name", "status", "template_name", "total_sent", "total_opened", "total_replied", "total_errors", "created_at", "started_at", "completed_at"),
    "tasks": ("task_id", "company_id", "title", "task_type", "priority", "status", "due_at", "created_at"),
    "touches": ("touch_id", "channel", "direction", "subject", "body", "note", "at"),
    "templates": ("template_name", "channel", "subject", "body"),
}


def listing(rows: DataFrame, what: str) -> DataFrame:
    """The columns that a listing of a kind shows. P4, P5."""
    return rows.select(*(c for c in LISTINGS[what] if c in rows.columns))


def page_with_total(found: DataFrame, order: list[Column], page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of found in order, with `total`, the number of all of found. L1, L2: a page is a limit, not a cap.

    The total is one row, so it reaches the page by a broadcast.
    """
    total = found.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    rows = found.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def followup_page(queue: DataFrame, companies: DataFrame, cities: tuple[str, ...] = (), segment: str | None = None, page: int = 1, per_page: int = 100) -> DataFrame:
    """A page of a follow-up queue with names: best score first, then the longest without contact, then id. J2, L2, S3."""
    own = live(companies).select(F.col("id").alias("company_id"), "name", "city", "region", "segment", "emails")
    j = queue.join(own, "company_id")
    if wanted := [c for c in cities if c.strip()]:
        j = j.where(F.col("city").isin(*wanted))
    if segment:
        j = j.where(F.col("segment") == segment)
    return page_with_total(j, [F.col("score").desc(), F.col("days_since").desc(), F.col("company_id")], page, per_page)


def preview(candidates: DataFrame, sample: int = 5) -> DataFrame:
    """The first candidates by id with the number of all of them: what a campaign would reach. M7, L3: a preview is a limit."""
    return page_with_total(candidates, [F.col("id")], 1, sample).withColumn("is_approximate", F.lit(True))


def manual_recipients(recipients: DataFrame, companies: DataFrame, logs: DataFrame) -> DataFrame:
    """Chosen recipients (campaign_id, company_id, email) that the campaign has not written to yet at this very address. M3.

    An anti join on (campaign, address), whichever company the address was written to; only live companies whose
    automation runs stay.
    """
    sent = logs.select("campaign_id", F.lower(F.trim("email")).alias("_e")).distinct()
    ok = live(companies).where(~F.coalesce("stop_automation", F.lit(False))).select(F.col("id").alias("company_id"))
    j = recipients.withColumn("_e", F.lower(F.trim("email"))).join(sent, ["campaign_id", "_e"], "left_anti")
    return j.join(ok, "company_id", "left_semi").select(*recipients.columns)


def recipient_listing(recipients: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """Recipients, latest first, then by address. S5."""
    return page_with_total(recipients, [F.col("added_at").desc_nulls_last(), F.col("email")], page, per_page)


def trust_stats(enriched: DataFrame) -> list[Column]:
    """Counts of companies with Telegram, of live and of dead ones, from trust scores. A26."""
    has = F.coalesce(F.map_contains_key("messengers", F.lit("telegram")), F.lit(False))
    return [F.count_if(has).alias("has_tg"), F.count_if(F.col("trust_score") >= 2).alias("tg_live"), F.count_if((F.col("trust_score") == 0) & has).alias("tg_dead")]


def network_detail(networks: DataFrame, members: DataFrame, companies: DataFrame, logs: DataFrame, most_cities: int = 10) -> DataFrame:
    """Networks (base_domain, emails, ...) with their live companies, their number, top cities and what was sent to their addresses. N4, J3.

    members: key, id. A network's companies are its detail: `companies` has them by id, `ids` the ids alone; what a query
    does not ask for is not gathered. Cities are counted first, and only the top ones are gathered. Where a network is
    too large for a row, network_companies has its companies as rows and pages.
    """
    j = members.join(live(companies), "id")
    one = F.struct("id", "name", "city", F.coalesce("score", F.lit(0)).alias("score"))
    each = j.groupBy("key").agg(F.count("*").alias("live_count"), F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(one)).alias("companies"))
    cities = j.where(F.coalesce("city", F.lit("")) != "").groupBy("key", "city").agg(F.count("*").alias("n"))
    first = cities.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "city"))).where(F.col("_r") <= most_cities)
    top = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", "city", "n"))).alias("c")).select("key", F.transform("c", lambda x: F.struct(x["city"].alias("name"), x["n"].alias("count"))).alias("top_cities"))
    sent = logs.where(F.col("status").isin(*WENT_OUT)).groupBy(F.lower("email").alias("e")).agg(F.count("*").alias("n"))
    mailed = networks.select("base_domain", F.explode("emails").alias("e")).withColumn("e", F.lower("e")).join(sent, "e").groupBy("base_domain").agg(F.sum("n").alias("sent_count"))
    out = networks.join(each.withColumnRenamed("key", "base_domain"), "base_domain", "left").join(top.withColumnRenamed("key", "base_domain"), "base_domain", "left").join(mailed, "base_domain", "left")
    out = out.withColumn("live_count", F.coalesce("live_count", F.lit(0))).withColumn("sent_count", F.coalesce("sent_count", F.lit(0))).withColumn("contact_status", F.when(F.col("sent_count") > 0, "sent").otherwise("none"))
    return out.withColumn("primary_email", F.get("emails", F.lit(0))).withColumn("group_id", F.concat(F.lit("website:"), "base_domain"))


def network_companies(members: DataFrame, companies: DataFrame, page: int | None = None, per_page: int = 50) -> DataFrame:
    """(key, pos, id, name, city, score) of the live companies of networks by id, all of them or one page of each. N4."""
    own = members.join(live(companies), "id").select("key", "id", "name", "city", F.coalesce("score", F.lit(0)).alias("score"))
    out = placed(own, ["key"], ["id"])
    return out if page is None else out.where(F.col("pos").between((page - 1) * per_page + 1, page * per_page))


def allowed_categories(categories: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The allowed ones of an array, in its order; the default where none is, or nothing was asked for. F18."""
    kept = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c.isin(*allowed))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def active_sources(settings: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """source, priority: the sources that settings (source, enabled) do not switch off, in the order given. SRC17."""
    spark = settings.sparkSession
    every = spark.createDataFrame(list(enumerate(sources)), "priority int, source string")
    off = settings.where(~F.coalesce("enabled", F.lit(True))).select("source")
    return every.join(F.broadcast(off.where(F.col("source").isin(*sources)).distinct()), "source", "left_anti").select("source", "priority").orderBy("priority")


def one_per_name(cards: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Cards of listings, the first of each name whatever its case; cards without a name go. SRC8, SRC9."""
    key = F.lower(F.trim(name))
    first = cards.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cards.columns), order).alias("x"))
    return first.select("x.*")
