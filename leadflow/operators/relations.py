"""Shared-signal joins, set operations and keyed rewrites. Survey: J9-J18, U1-U3, C11, C13-C19, E1-E7, T13-T16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.plans.lineage import skew_join


def signal_groups(signals: DataFrame, entity: str, signal: str) -> DataFrame:
    """(entity, signal, first, n) of every entity that shares a signal with others: the group's smallest entity and size. J11-J13.

    One row an entity and signal, never pairs, so a signal that a third of all entities carry is whole and no hub is left out.
    """
    own = signals.select(F.col(entity), F.col(signal)).where(F.col(entity).isNotNull() & F.col(signal).isNotNull()).distinct()
    groups = own.groupBy(signal).agg(F.min(entity).alias("first"), F.count("*").alias("n")).where("n > 1")
    return skew_join(own, groups, signal, entity).select(entity, signal, "first", "n")


def similar_to(signals: DataFrame, entity: str, signal: str, ids: DataFrame) -> DataFrame:
    """(entity, other, reasons) of everything that shares a signal with the given ids; signals has `reason`. J13."""
    asked = signals.join(ids.select(F.col(entity)).distinct(), entity, "left_semi").select(F.col(entity).alias("entity"), signal, "reason")
    hits = asked.join(signals.select(F.col(entity).alias("other"), signal, "reason"), [signal, "reason"]).where("entity <> other")
    return hits.groupBy("entity", "other").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def full_key_union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several relations by key, 0 where a relation lacks it; one aggregate over their union. J15, U1."""
    tagged = [df.select(F.col(key), F.lit(name).alias("_of")) for name, df in parts.items()]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(*(F.count_if(F.col("_of") == name).alias(name) for name in parts))


def map_fill(first: Column, second: Column) -> Column:
    """first with the keys that only second has; null maps count as empty. C7, E1, J16."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    return F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def fill_missing(base: Column, found: Column) -> Column:
    """base, or found where base is null or empty. E3, SRC4."""
    return F.when(F.coalesce(base, F.lit("")) == "", found).otherwise(base)


def enrich(companies: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """companies with contacts of found (website, emails, phones, messengers): unions for arrays, fills for the rest. E1-E3."""
    f = found.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in ("website", "emails", "phones", "messengers")))
    out = companies.join(f, key, "left")
    none = F.array().cast("array<string>")
    for c in ("emails", "phones"):
        out = out.withColumn(c, F.array_union(F.coalesce(F.col(c), none), F.coalesce(F.col(f"_{c}"), none)))
    out = out.withColumn("website", fill_missing(F.col("website"), F.col("_website"))).withColumn("messengers", map_fill(F.col("messengers"), F.col("_messengers")))
    return out.select(*companies.columns)


def sync_emails(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """New company_emails (company_id, email, is_active, is_primary, sent_count) after syncing with wanted (company_id, emails). C11.

    Addresses that are not wanted go, new ones are active, counters stay; the first address is primary where none was.
    Companies without a row in wanted keep what they have.
    """
    want = wanted.select("company_id", F.posexplode("emails").alias("_pos", "email")).groupBy("company_id", "email").agg(F.min("_pos").alias("_pos"))
    named = wanted.select("company_id").distinct().withColumn("_named", F.lit(True))
    both = existing.join(want, ["company_id", "email"], "full").join(named, "company_id", "left")
    kept = both.where(F.col("_named").isNull() | F.col("_pos").isNotNull())
    by = Window.partitionBy("company_id")
    had = F.coalesce(F.max(F.coalesce("is_primary", F.lit(False))).over(by), F.lit(False))
    first = F.row_number().over(by.orderBy(F.col("_pos").asc_nulls_last(), "email")) == 1
    return kept.select(
        "company_id", "email", F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.when(had, F.coalesce("is_primary", F.lit(False))).otherwise(first).alias("is_primary"), F.coalesce("sent_count", F.lit(0)).alias("sent_count"),
    )


def reassign_primary(emails: DataFrame) -> DataFrame:
    """is_primary: the active primary address, else the first active one by id, of each company. W7."""
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("is_active"), F.desc("is_primary"), "id"))
    return emails.withColumn("is_primary", F.col("is_active") & (rank == 1))


def merge_into(companies: DataFrame, plan: DataFrame, contacts: bool = True, sources: bool = True, ordered: bool = False, clear_network: tuple[str, ...] = ()) -> DataFrame:
    """A new snapshot in which sources of plan (source, target) are folded into their targets. C13, C17-C19.

    Targets take the union of phones, emails and sources, the ids they absorbed and the sum of contact_count; sources
    stay as rows with merged_into set. Chains must be resolved by the caller; a row that is its own target is left alone.
    Switches: contacts and sources are carried or not; ordered sorts phones and emails, else what is new comes behind;
    clear_network takes the network flag from the "target", the "source" or both.
    """
    p = plan.where("source <> target").select(F.col("source").alias("id"), "target").distinct()
    marked = companies.drop("merged_into").join(p, "id", "left").withColumn("_to", F.coalesce("target", "id"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("_to")).alias("o"), F.col("id").alias("i"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))
    gained = marked.groupBy("_to").agg(
        *((F.array_sort(flat(c)) if ordered else flat(c)).alias(f"_{c}") for c in ("phones", "emails")), F.array_sort(flat("sources")).alias("_sources"),
        F.array_sort(F.collect_list(F.when(F.col("id") != F.col("_to"), F.col("id")))).alias("_absorbed"), F.sum("contact_count").alias("_contacts"),
    ).withColumnRenamed("_to", "id").withColumn("_target", F.size("_absorbed") > 0)
    out = marked.drop("_to").join(gained, "id", "left")
    own = F.coalesce("_target", F.lit(False))
    pick = lambda new, old: F.when(own, F.col(new)).otherwise(F.col(old)).alias(old)
    if not sources:
        out = out.withColumn("_sources", F.col("sources"))
    if not contacts:
        out = out.withColumn("_contacts", F.col("contact_count"))
    if clear_network:
        side = {"target": own, "source": F.col("target").isNotNull()}
        cleared = F.lit(False)
        for which in clear_network:
            cleared = cleared | side[which]
        out = out.withColumn("is_network", F.when(cleared, False).otherwise(F.col("is_network")))
    rest = [c for c in companies.columns if c not in ("id", "phones", "emails", "sources", "merged_from", "contact_count", "merged_into")]
    return out.select(
        "id", *rest, pick("_phones", "phones"), pick("_emails", "emails"), pick("_sources", "sources"),
        F.when(own, F.array_union(F.coalesce("merged_from", F.array().cast("array<bigint>")), "_absorbed")).otherwise(F.col("merged_from")).alias("merged_from"),
        F.when(own, F.col("_contacts")).otherwise(F.col("contact_count")).alias("contact_count"), F.col("target").alias("merged_into"),
    )


def mark_spam(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """segment becomes spam; the reason keeps the old segment so that unmark_spam can restore it. C14."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = companies.join(hit, "id", "left")
    note = F.concat(F.lit("spam prev_segment="), F.coalesce("segment", F.lit("D")))
    on = F.coalesce("_hit", F.lit(False)) & (F.coalesce("segment", F.lit("")) != "spam")
    return j.withColumn("review_reason", F.when(on, F.trim(F.concat_ws(" ", "review_reason", note))).otherwise(F.col("review_reason"))).withColumn("segment", F.when(on, "spam").otherwise(F.col("segment"))).select(*companies.columns)


def unmark_spam(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """Undo mark_spam: the segment noted in the reason comes back, D where none is noted. C14."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = companies.join(hit, "id", "left")
    on = F.coalesce("_hit", F.lit(False)) & (F.col("segment") == "spam")
    noted = F.regexp_extract(F.coalesce("review_reason", F.lit("")), r"spam prev_segment=(\w+)", 1)
    bare = F.trim(F.regexp_replace("review_reason", r"\s*spam prev_segment=\w+", ""))
    restored = {"segment": F.when(on, F.when(noted == "", "D").otherwise(noted)).otherwise(F.col("segment")), "review_reason": F.when(on, bare).otherwise(F.col("review_reason"))}
    return j.withColumns(restored).select(*companies.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new snapshot: rows of changes replace those of base with the same key, new keys are added. C15, C16, E6, T16."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(*base.columns))


def seed_missing(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """contacts plus a `new` one for each company that has none. T13."""
    fresh = companies.select(F.col("id").alias("company_id")).join(contacts.select("company_id"), "company_id", "left_anti").withColumn("funnel_stage", F.lit("new"))
    return contacts.unionByName(fresh, allowMissingColumns=True)


def out_of_domain(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    """c where it is allowed, else the default. T16."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))
