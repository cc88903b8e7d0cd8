"""Review decisions, groups resolved by hand, and the repair chain, as new snapshots. Survey: C15-C17, C19, C22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.urls import extract_domain
from leadflow.functions.values import SPAM_DOMAINS
from leadflow.operators import networks, scoring
from leadflow.operators.effects import repair_diff
from leadflow.operators.relations import merge_into


def judged(companies: DataFrame, decisions: DataFrame, batch: bool = False) -> DataFrame:
    """decisions (id, action, reason, target_id; one an id) with `refusal`: why one cannot be carried out, null where it can. C15, C16.

    Actions: approve; spam, which needs a reason; duplicate, which needs another company that exists, and a company that
    is not deleted yet. A batch passes over deleted companies whatever the action.
    """
    have = companies.select("id", F.col("deleted_at").isNotNull().alias("_gone"), F.lit(True).alias("_there"))
    targets = companies.select(F.col("id").alias("target_id"), F.lit(True).alias("_target"))
    j = decisions.join(have, "id", "left").join(targets, "target_id", "left")
    gone, twin = F.coalesce("_gone", F.lit(False)), F.col("action") == "duplicate"
    refusal = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.lit(batch) & gone, "deleted")
        .when(~F.col("action").isin("approve", "spam", "duplicate"), "unknown_action")
        .when((F.col("action") == "spam") & (F.coalesce("reason", F.lit("")) == ""), "no_reason")
        .when(twin & F.col("target_id").isNull(), "no_target")
        .when(twin & F.col("_target").isNull(), "target_missing")
        .when(twin & (F.col("target_id") == F.col("id")), "itself")
        .when(twin & gone, "deleted")
    )
    return j.select("id", "action", "reason", "target_id", refusal.alias("refusal"))


def reviewed(companies: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """companies (id, segment, status, needs_review, review_reason, merged_into, deleted_at, ...) after judged decisions. C15, C16."""
    v = verdicts.where("refusal is null").select("id", F.col("action").alias("_do"), F.col("reason").alias("_why"), F.col("target_id").alias("_to"))
    j = companies.join(v, "id", "left")
    do = F.coalesce("_do", F.lit(""))
    spam, twin = do == "spam", do == "duplicate"
    note = F.when(do == "approve", "").when(spam, F.concat(F.lit("mark-spam:"), "_why", F.lit(":prev_segment="), F.coalesce("segment", F.lit("unknown")))).when(twin, F.concat(F.lit("duplicate_of:"), F.col("_to").cast("string")))
    new = {
        "review_reason": F.coalesce(note, "review_reason"), "needs_review": F.when(do != "", False).otherwise(F.col("needs_review")), "segment": F.when(spam, "spam").otherwise(F.col("segment")),
        "status": F.when(spam, "spam").otherwise(F.col("status")), "merged_into": F.when(twin, F.col("_to")).otherwise(F.col("merged_into")), "deleted_at": F.when(spam | twin, now).otherwise(F.col("deleted_at")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in companies.columns))


def review_touches(verdicts: DataFrame, now: Column) -> DataFrame:
    """(company_id, at, channel, direction, note): the trace of each decision that was carried out. C15."""
    note = F.when(F.col("action") == "approve", "resolve-review: approved").when(F.col("action") == "spam", F.concat(F.lit("resolve-review: spam, reason="), "reason")).otherwise(F.concat(F.lit("resolve-review: duplicate, target="), F.col("target_id").cast("string")))
    return verdicts.where("refusal is null").select(F.col("id").alias("company_id"), now.alias("at"), F.lit("manual").alias("channel"), F.lit("outgoing").alias("direction"), note.alias("note"))


def stopped_as_spam(contacts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """contacts (company_id, stop_automation, ...): companies that became spam are not written to any more. C15."""
    off = verdicts.where("refusal is null and action = 'spam'").select(F.col("id").alias("company_id"), F.lit(True).alias("_off"))
    return contacts.join(off, "company_id", "left").withColumn("stop_automation", F.coalesce("stop_automation", F.lit(False)) | F.coalesce("_off", F.lit(False))).select(*contacts.columns)


def groups_resolved(companies: DataFrame, members: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """companies after decisions (group_id, action, target_id) on groups (members: group_id, id). C17.

    network: members become a network and need no review. duplicate: live members go into the target, which must be one
    of them (else nothing happens to the group), with their phones, addresses and sources; the target needs no review.
    """
    m = members.join(decisions, "group_id")
    valid = m.where("action = 'duplicate' and id = target_id").select("group_id").distinct()
    net = m.where("action = 'network'").select("id").distinct().withColumn("_net", F.lit(True))
    twins = m.where("action = 'duplicate'").join(valid, "group_id", "left_semi")
    alive = companies.where("deleted_at is null").select("id")
    plan = twins.where("id <> target_id").join(alive, "id", "left_semi").groupBy("id").agg(F.min("target_id").alias("target")).withColumnRenamed("id", "source")
    kept = twins.select(F.col("target_id").alias("id")).distinct().withColumn("_kept", F.lit(True))
    gone = plan.select(F.col("source").alias("id"), F.lit(True).alias("_gone"))
    out = merge_into(companies, plan, contacts=False).join(net, "id", "left").join(kept, "id", "left").join(gone, "id", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    new = {
        "is_network": F.when(on("_net"), True).otherwise(F.col("is_network")), "needs_review": F.when(on("_net") | on("_kept"), False).otherwise(F.col("needs_review")),
        "deleted_at": F.when(on("_gone"), now).otherwise(F.col("deleted_at")), "review_reason": F.when(on("_gone"), F.concat(F.lit("merged_into_"), F.col("merged_into").cast("string"))).otherwise(F.col("review_reason")),
    }
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in companies.columns))


def single_city_plan(companies: DataFrame) -> DataFrame:
    """(source, target) for live companies of one website, one city and one name; the target is the most complete, then the smallest id. C19."""
    live = companies.where(F.col("deleted_at").isNull() & F.col("merged_into").isNull() & (F.coalesce("website", F.lit("")) != ""))
    full = F.when(F.size("emails") > 0, 1).otherwise(0) + F.when(F.size("phones") > 0, 1).otherwise(0) + F.when(F.coalesce("address", F.lit("")) != "", 1).otherwise(0)
    g = live.groupBy("website").agg(F.count("*").alias("n"), F.countDistinct("city").alias("_cities"), F.countDistinct("name").alias("_names"), F.max_by("id", F.struct(full.alias("f"), (-F.col("id")).alias("i"))).alias("target"))
    one = g.where("n > 1 and _cities = 1 and _names = 1").select("website", "target")
    return live.select(F.col("id").alias("source"), "website").join(one, "website").where("source <> target").select("source", "target")


def repaired(companies: DataFrame, spam: bool = True, nets: bool = True, scores: bool = True, domains: tuple[str, ...] = SPAM_DOMAINS) -> DataFrame:
    """companies after the repair chain: known spam sites, then networks, then scores and segments. C22.

    Each step sees what the one before has done: spam rows leave networks and keep a score of 0.
    """
    out = companies
    if spam:
        bad = F.coalesce(extract_domain(F.col("website")).isin(*domains), F.lit(False))
        new = {"segment": F.lit("spam"), "score": F.lit(0).cast("long"), "status": F.lit("spam"), "needs_review": F.lit(True), "review_reason": F.lit("repair_db_known_spam")}
        out = out.select(*(F.when(bad, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in out.columns))
    known = F.coalesce(F.col("status") == "spam", F.lit(False))
    if nets:
        live = out.where(F.col("deleted_at").isNull() & ~known)
        out = networks.assign_networks(out.drop("network_key"), networks.detect_networks(live)).select(*[c for c in companies.columns if c != "network_key"], "network_key")
    if scores:
        s = scoring.scored(out)
        out = s.join(out.select("id", F.col("score").alias("_old"), F.col("segment").alias("_seg")), "id")
        out = out.withColumn("score", F.when(known, F.col("_old")).otherwise(F.col("score"))).withColumn("segment", F.when(known, F.col("_seg")).otherwise(F.col("segment"))).drop("_old", "_seg")
    return out


def repair_plan(companies: DataFrame, **steps: bool) -> DataFrame:
    """(id, column, before, after) of all that the chain would change: the dry run of the whole. C22."""
    return repair_diff(companies, repaired(companies, **steps).select(*companies.columns))
