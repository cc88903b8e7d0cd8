"""Data quality: contact validation, duplicate groups, review reports, clean-up. Survey: A23, A28-A33, A38, C18, C20, F25, X8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions.emails import email_problem
from leadflow.functions.names import token_sort_ratio
from leadflow.functions.phones import DEFAULT, PhoneRules, phone_problem
from leadflow.functions.urls import extract_domain
from leadflow.functions.values import FAKE_EMAIL_LOCALS
from leadflow.operators.resolution import rare_pairs


def contact_problems(rows: DataFrame, table: str, r: PhoneRules = DEFAULT) -> DataFrame:
    """(table, field, reason, n) of the bad phones and addresses of rows (phones, emails). A32."""
    p = rows.select(F.lit("phones").alias("field"), F.explode("phones").alias("v")).withColumn("reason", phone_problem(F.col("v"), r))
    e = rows.select(F.lit("emails").alias("field"), F.explode("emails").alias("v")).withColumn("reason", email_problem(F.col("v")))
    bad = p.union(e).where("reason <> 'ok'")
    return bad.groupBy(F.lit(table).alias("table"), "field", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def review_report(companies: DataFrame, most_phones: int = 6, most_emails: int = 4) -> DataFrame:
    """(id, flags) of companies in review, and why. A38."""
    flag = lambda on, name: F.when(on, F.lit(name))
    reason = F.coalesce("review_reason", F.lit(""))
    return companies.where("needs_review").select("id", F.concat_ws(" ", flag(F.size("phones") > most_phones, "too_many_phones"), flag(F.size("emails") > most_emails, "too_many_emails"), flag(reason.contains("different_names"), "different_names"), flag(reason.contains("different_cities"), "different_cities")).alias("flags"))


def website_groups(companies: DataFrame) -> DataFrame:
    """(domain, n, n_cities, kind) of sites with several companies: one city or many. A28, A29."""
    d = companies.withColumn("domain", extract_domain(F.col("website"))).where("domain is not null")
    g = d.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("city").alias("n_cities")).where("n > 1")
    return g.withColumn("kind", F.when(F.col("n_cities") == 1, "single_city").when(F.col("n_cities") == F.col("n"), "one_per_city").otherwise("mixed"))


def duplicate_group_kind(companies: DataFrame) -> DataFrame:
    """(name_key, city, n, kind) of equal names in a city: network, several sites, no site, one site. A30."""
    c = companies.withColumn("name_key", F.lower(F.trim("name"))).withColumn("_d", extract_domain(F.col("website")))
    g = c.groupBy("name_key", "city").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("is_network", F.lit(False))).alias("_net"), F.countDistinct("_d").alias("_sites")).where("n > 1")
    return g.select("name_key", "city", "n", F.when(F.col("_net"), "network").when(F.col("_sites") > 1, "multi_site").when(F.col("_sites") == 0, "no_site").otherwise("single_site").alias("kind"))


def site_merge_plan(companies: DataFrame) -> DataFrame:
    """(domain, action, target, n) for sites with several companies: merge if their non-empty address lists share one, or none has any; else network. C18.

    The target is the most complete row, ties to the smallest id.
    """
    d = companies.withColumn("domain", extract_domain(F.col("website"))).where("domain is not null")
    full = F.when(F.size("emails") > 0, 1).otherwise(0) + F.when(F.size("phones") > 0, 1).otherwise(0) + F.when(F.coalesce("address", F.lit("")) != "", 1).otherwise(0)
    g = d.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.size("emails") > 0).alias("_with"), F.max_by("id", F.struct(full.alias("f"), (-F.col("id")).alias("i"))).alias("target")).where("n > 1")
    each = d.select("domain", "id", F.explode("emails").alias("e")).groupBy("domain", "e").agg(F.countDistinct("id").alias("k")).groupBy("domain").agg(F.max("k").alias("_most"))
    j = g.join(each, "domain", "left")
    ok = (F.col("_with") == 0) | (F.coalesce("_most", F.lit(0)) == F.col("_with"))
    return j.select("domain", F.when(ok, "merge").otherwise("network").alias("action"), "target", "n")


def best_listing(names: DataFrame, listings: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(id, listing_id, score): the most similar listing of each name's city, later ones first among equals. C20.

    Different names are compared, once each, and only those that share one of their rarest letter pairs.
    """
    key = F.lower(F.trim("name")).alias("k")
    asked = names.select("id", "city", key)
    kept = listings.groupBy("city", key).agg(F.max("listing_id").alias("listing_id"))
    side = lambda df, name: df.where("k <> ''").select("city", F.lit(name).alias("b"), "k", F.lit(name).alias("id")).distinct()
    rare = rare_pairs(side(asked, "name").union(side(kept, "listing")), threshold)
    left = rare.where("b = 'name'").select("city", "g", F.col("k").alias("ka"))
    right = rare.where("b = 'listing'").select("city", "g", F.col("k").alias("kb"))
    fits = F.least(F.length("ka"), F.length("kb")) * (200 - threshold) >= F.greatest(F.length("ka"), F.length("kb")) * threshold
    pairs = left.join(right, ["city", "g"]).where(fits).select("city", "ka", "kb").distinct()
    scored = pairs.withColumn("score", token_sort_ratio("ka", "kb")).where(F.col("score") >= threshold).join(kept.withColumnRenamed("k", "kb"), ["city", "kb"])
    best = scored.groupBy("city", F.col("ka").alias("k")).agg(F.max_by(F.struct("listing_id", "score"), F.struct("score", "listing_id")).alias("x"))
    return asked.join(best, ["city", "k"]).select("id", "x.*")


def without_placeholders(rows: DataFrame, column: str = "emails") -> DataFrame:
    """rows without placeholder addresses, with n_removed. F25."""
    kept = F.filter(column, lambda e: ~F.substring_index(F.lower(e), "@", 1).isin(*FAKE_EMAIL_LOCALS))
    return rows.withColumn("n_removed", F.size(column) - F.size(kept)).withColumn(column, kept)


def messenger_histogram(rows: DataFrame) -> DataFrame:
    """(kind, n) over the messenger maps of rows. A33."""
    return rows.select(F.explode(F.map_keys("messengers")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
