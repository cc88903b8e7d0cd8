"""Branch networks: detection by shared domains, aggregates, types, candidates. Survey: N1-N8, A14-A17."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.phones import DEFAULT, PhoneRules, normalize_phones
from leadflow.functions.urls import base_domain, extract_domain
from leadflow.functions.values import FREE_EMAIL_DOMAINS, NON_NETWORK_DOMAINS, SPAM_DOMAINS
from leadflow.plans.lineage import cut, skew_join

_NONE = "array<string>"


def email_domain(e):
    return F.lower(F.trim(F.substring_index(e, "@", -1)))


def network_signals(live: DataFrame, spam: tuple[str, ...] = SPAM_DOMAINS, excluded: tuple[str, ...] = NON_NETWORK_DOMAINS, free: tuple[str, ...] = FREE_EMAIL_DOMAINS) -> DataFrame:
    """(id, key, kind) of live companies (id, website, emails): base domains and, once a row, mail domains."""
    base = live.select("id", base_domain(F.col("website"), excluded).alias("key"), F.lit("website").alias("kind"))
    mails = F.array_distinct(F.transform(F.filter(F.coalesce("emails", F.array().cast(_NONE)), lambda e: e.contains("@")), email_domain))
    mail = live.select("id", F.explode(mails).alias("key"), F.lit("email").alias("kind")).where(~F.col("key").isin(*free))
    return base.union(mail).where(F.col("key").isNotNull() & (F.col("key") != "") & ~F.col("key").isin(*spam, *excluded))


def detect_networks(live: DataFrame, least: int = 2, **lists: tuple[str, ...]) -> DataFrame:
    """(key, id) memberships: a kind of signal counts from `least` companies on; both kinds under one key merge. N1."""
    signals = network_signals(live, **lists).distinct()
    sizes = signals.groupBy("key", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key", "kind")
    return signals.join(sizes, ["key", "kind"]).select("key", "id").distinct()


def network_type(n_cities, top_email, all_emails, kind: str = "website", share: float = 0.7):
    """local, regional, aggregator or franchise from counts. A16."""
    regional = (all_emails >= 2) & (top_email >= all_emails * share)
    return F.when(n_cities <= 1, "local").when(regional, "regional").otherwise("aggregator" if kind in ("phone", "email_domain") else "franchise")


def network_table(live: DataFrame, members: DataFrame, r: PhoneRules = DEFAULT) -> DataFrame:
    """One row for each network key with its aggregates; arrays are exploded one at a time, so nothing fans out. A15."""
    j = members.join(live, "id")
    basic = j.groupBy("key").agg(
        F.count("*").alias("company_count"), F.countDistinct("city").alias("city_count"), F.array_sort(F.collect_set("city")).alias("cities"),
        F.array_sort(F.collect_set(extract_domain(F.col("website")))).alias("subdomains"), F.round(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))), 1).alias("avg_score"),
        F.countDistinct(F.when(F.coalesce("city", F.lit("")) != "", F.col("city"))).alias("_named_cities"),
    )
    name = j.groupBy("key", F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    segs = j.groupBy("key", F.coalesce("segment", F.lit("D")).alias("s")).agg(F.count("*").alias("n")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("segment_dist"))
    each = j.select("key", F.explode("emails").alias("e")).where(F.col("e").contains("@")).groupBy("key", "e").agg(F.count("*").alias("n"))
    mails = each.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("emails"), F.max("n").alias("_top"), F.sum("n").alias("_all"))
    phones = j.select("key", F.explode(normalize_phones(F.col("phones"), r)).alias("p")).groupBy("key").agg(F.array_sort(F.collect_set("p")).alias("phones"))
    out = basic.join(name, "key").join(segs, "key").join(mails, "key", "left").join(phones, "key", "left")
    kind = network_type(F.col("_named_cities"), F.coalesce("_top", F.lit(0)), F.coalesce("_all", F.lit(0)))
    fill = lambda c: F.coalesce(c, F.array().cast(_NONE)).alias(c)
    return out.select(F.col("key").alias("base_domain"), "name", kind.alias("network_type"), "subdomains", fill("emails"), fill("phones"), "cities", "company_count", "city_count", "avg_score", "segment_dist")


def assign_networks(companies: DataFrame, members: DataFrame) -> DataFrame:
    """companies with network_key (the largest key of those a row belongs to) and is_network; others are reset. N1."""
    own = members.groupBy("id").agg(F.max("key").alias("network_key"))
    return companies.drop("network_key", "is_network").join(own, "id", "left").withColumn("is_network", F.col("network_key").isNotNull())


def shared_emails(live: DataFrame, members: DataFrame, shown: Callable[[Column], Column] = lambda emails: emails) -> DataFrame:
    """(id, emails): each member's addresses with all those of its networks, sorted. N2.

    Members of the same networks share one list: it is made, and brought into the form in which it is shown, once for
    each set of networks, not once a member. Lists are shuffled once, and again only for parts of a hot set; a member
    moves as its id and its set. Only the result, as many rows as members with a list each, is as long as it must be.
    """
    own = cut(members.groupBy("id").agg(F.to_json(F.array_sort(F.collect_set("key"))).alias("set")))
    every = members.join(live.select("id", F.explode("emails").alias("e")), "id").select("key", "e").distinct()
    sets = own.select("set").distinct().select("set", F.explode(F.from_json("set", _NONE)).alias("key"))
    lists = sets.join(every, "key").select("set", "e").distinct().groupBy("set").agg(F.array_sort(F.collect_list("e")).alias("emails"))
    return skew_join(own, lists.select("set", shown(F.col("emails")).alias("emails")), "set", "id").select("id", "emails")


def candidate_groups(live: DataFrame, least_companies: int = 3, least_cities: int = 3, **lists: tuple[str, ...]) -> DataFrame:
    """(kind, key, n, n_cities): groups worth a look; a base domain that qualifies hides its subdomains. A17, N5."""
    j = network_signals(live, **lists).distinct().join(live.select("id", "city"), "id")
    groups = j.groupBy("kind", "key").agg(F.countDistinct("id").alias("n"), F.countDistinct("city").alias("n_cities")).where((F.col("n") >= least_companies) & (F.col("n_cities") >= least_cities))
    full = live.select("id", "city", extract_domain(F.col("website")).alias("key"), base_domain(F.col("website"), ()).alias("base")).where("key is not null and key <> base")
    sub = full.groupBy("key", "base").agg(F.countDistinct("id").alias("n"), F.countDistinct("city").alias("n_cities")).where((F.col("n") >= least_companies) & (F.col("n_cities") >= least_cities))
    hidden = groups.where("kind = 'website'").select(F.col("key").alias("base"))
    return groups.unionByName(sub.join(hidden, "base", "left_anti").select(F.lit("subdomain").alias("kind"), "key", "n", "n_cities"))


def email_badges(members: DataFrame, disabled: DataFrame, logs: DataFrame) -> DataFrame:
    """(key, email, badge): disabled, else bounced or sent by the latest log, else none, for each network address. N7.

    members: key, email; disabled: key, email; logs: log_id, email, status, at (the latest by time, then by id).
    """
    last = logs.groupBy(F.lower("email").alias("email")).agg(F.max_by("status", F.struct("at", "log_id")).alias("last"))
    off = disabled.select("key", F.lower("email").alias("email")).distinct().withColumn("_off", F.lit(True))
    j = members.select("key", F.lower("email").alias("email")).distinct().join(off, ["key", "email"], "left").join(last, "email", "left")
    return j.select("key", "email", F.when(F.col("_off"), "disabled").when(F.col("last") == "bounced", "bounced").when(F.col("last").isNotNull(), "sent").otherwise("none").alias("badge"))


def tag_by_email(companies: DataFrame, domain: str) -> DataFrame:
    """(key, id) for every company with an address that holds a fixed domain. N8."""
    hit = F.exists("emails", lambda e: F.lower(e).contains(domain.lower()))
    return companies.where(F.coalesce(hit, F.lit(False))).select(F.lit(domain).alias("key"), "id")
