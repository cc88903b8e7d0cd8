"""Entity resolution: clusters by shared signals and similar names, their closure, merged companies and review flags.

Survey: C1-C10, C12, Q8-Q11. Clusters form within a city. Where the reference leaves an order open, rows count by
ascending id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.emails import by_priority
from leadflow.functions.names import block_key, extract_street, is_aggregator_name, is_seo_title, name_key, pick_longest, pick_shortest, stripped, token_sort_ratio, word_jaccard
from leadflow.functions.phones import DEFAULT, PhoneRules, is_non_local_phone, normalize_phones
from leadflow.functions.urls import base_domain, extract_domain
from leadflow.functions.values import NON_NETWORK_DOMAINS, SPAM_DOMAINS
from leadflow.operators.components import connected_components, star_edges

#: An entity signal with as many owners ties nobody; most phones and addresses of a merged company.
HUB, MAX_PHONES, MAX_EMAILS, NAME_THRESHOLD, SMALL_BLOCK = 10, 6, 4, 88, 5


def signal_edges(signals: DataFrame, key: str, signal: str, hub: int | None = HUB) -> DataFrame:
    """Star edges between rows that share a signal; signals of `hub` or more rows are left out. C2, C3."""
    own = signals.select(F.col(key).alias("n"), F.col(signal).alias("s")).where("n is not null and s is not null").distinct()
    sizes = own.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") >= 2)
    if hub is not None:
        sizes = sizes.where(F.col("k") < hub)
    return star_edges(own.join(sizes.select("s"), "s"), "s", "n")


def phone_edges(rows: DataFrame, r: PhoneRules = DEFAULT, hub: int = HUB) -> DataFrame:
    """Edges between rows (id, city, phones) of one city that share a number that is no hub. C2."""
    each = rows.select("id", F.explode(normalize_phones(F.col("phones"), r)).alias("p"), "city")
    return signal_edges(each.select("id", F.concat_ws("\1", "city", "p").alias("s")), "id", "s", hub)


def site_edges(rows: DataFrame) -> DataFrame:
    """Edges between rows (id, city, website) of one city with the same full or base domain. C3."""
    full = rows.select("id", F.concat_ws("\1", "city", extract_domain(F.col("website"))).alias("s")).where(extract_domain(F.col("website")).isNotNull())
    base = rows.select("id", F.concat_ws("\1", "city", base_domain(F.col("website"))).alias("s")).where(base_domain(F.col("website")).isNotNull())
    return signal_edges(full, "id", "s", None).union(signal_edges(base, "id", "s", None))


def name_edges(rows: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Edges between rows (id, city, name) of one city with equal or similar names. C4.

    Distinct names are compared, not rows: rows of one name are tied by a star. Names may match in their block (first
    letter); blocks of fewer than SMALL_BLOCK rows also meet the next block. Within these, only names that share a rare
    pair of letters are compared: see `rare_pairs`.
    """
    named = rows.select("id", "city", F.col("name"), name_key(F.col("name")).alias("k"), block_key(F.col("name")).alias("b")).where("b is not null")
    by_name = named.groupBy("city", "b", "k").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    equal = signal_edges(named.select("id", F.concat_ws("\1", "city", "b", "k").alias("s")), "id", "s", None)
    blocks = by_name.groupBy("city", "b").agg(F.sum("rows").alias("rows"))
    blocks = blocks.withColumn("next", F.lead("b").over(Window.partitionBy("city").orderBy("b")))
    fits = F.least(F.length("ka"), F.length("kb")) * (200 - threshold) >= F.greatest(F.length("ka"), F.length("kb")) * threshold
    reach = blocks.select("city", "b", F.col("b").alias("b2")).union(blocks.where((F.col("rows") < SMALL_BLOCK) & F.col("next").isNotNull()).select("city", "b", "next"))
    rare = rare_pairs(by_name, threshold)
    left = rare.select("city", "g", "b", F.col("k").alias("ka"), F.col("id").alias("src"))
    right = rare.select("city", "g", F.col("b").alias("b2"), F.col("k").alias("kb"), F.col("id").alias("dst"))
    near = left.join(right, ["city", "g"]).where(fits & (F.col("src") != F.col("dst")) & ((F.col("b") != F.col("b2")) | (F.col("ka") < F.col("kb"))))
    pairs = near.select("city", "b", "b2", "ka", "kb", "src", "dst").distinct().join(reach, ["city", "b", "b2"], "left_semi")
    similar = pairs.where(token_sort_ratio("ka", "kb") >= threshold).select("src", "dst")
    return equal.union(similar)


def rare_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(city, b, k, id, g) of each name's rarest letter pairs, one of which every similar name has among its own rarest.

    Words in order, a name of n letters has n pairs (the first letter pairs with a mark), numbered where they repeat. A
    similar name differs by d letters left out or added, at most (1 - t) of both lengths, and each touches two pairs;
    so of the pairs in any common order the first 2 * d + 1 of each meet. Rare pairs come first, so lists stay short.
    """
    t = threshold / 100
    text = F.concat(F.lit("\1"), F.array_join(F.array_sort(F.split(F.trim("k"), r"\s+")), " "))
    grams = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))
    numbered = F.transform("gs", lambda g, i: F.concat(g, F.lit("\1"), F.size(F.filter(F.slice("gs", 1, i), lambda x: x == g)).cast("string")))
    each = names.withColumn("s", text).withColumn("gs", grams).select("city", "b", "k", "id", F.length("s").alias("n"), F.explode(numbered).alias("g"))
    often = each.groupBy("city", "g").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("city", "id", "k").orderBy("f", "g"))
    # the longest similar name has n * (2 - t) / t letters; a hair more, so that rounding loses nothing
    most = F.floor((1 - t) * (F.col("n") - 1) * 2 / t + 1e-6)
    return each.join(often, ["city", "g"]).withColumn("r", rank).where(F.col("r") <= 2 * most + 1).select("city", "b", "k", "id", "g")


def clusters(rows: DataFrame, *edges: DataFrame) -> DataFrame:
    """id, cluster for every row; a row without edges is its own cluster. C6."""
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    found = connected_components(every).select(F.col("node").alias("id"), F.col("component"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def resolve(rows: DataFrame, r: PhoneRules = DEFAULT, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Clusters of raw rows by phones, sites and names. C1."""
    return clusters(rows, phone_edges(rows, r), site_edges(rows), name_edges(rows, threshold))


def _names_similar(names: Column) -> Column:
    """Whether every two of the names share more than half of their words."""
    return F.forall(names, lambda a: F.forall(names, lambda b: (a == b) | (word_jaccard(a, b) > 0.5)))


def merge_clusters(rows: DataFrame, members: DataFrame, r: PhoneRules = DEFAULT) -> DataFrame:
    """One company for each cluster, with review flags. C7, C8.

    rows: id, name, phones, address, website, emails, messengers, source, city, needs_review, review_reason.
    """
    none = F.array().cast("array<string>")
    record = F.struct("id", "name", "phones", "address", "website", "emails", F.map_entries(F.coalesce("messengers", F.create_map().cast("map<string,string>"))).alias("messengers"), "source", "city", "needs_review", "review_reason")
    g = rows.join(members, "id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))).alias("m"))
    g = g.withColumn("m", F.transform("m", lambda x: x["r"]))
    of = lambda name: F.transform("m", lambda x: x[name])
    full = lambda c: F.filter(c, lambda v: v.isNotNull() & (v != ""))
    phones = normalize_phones(F.flatten(F.transform("m", lambda x: F.coalesce(x["phones"], none))), r)
    emails = F.array_distinct(full(F.transform(F.flatten(F.transform("m", lambda x: F.coalesce(x["emails"], none))), lambda e: F.lower(stripped(e)))))
    g = g.select(
        "cluster", "m", F.transform("m", lambda x: x["id"]).alias("merged_from"), full(of("name")).alias("_names"), phones.alias("_phones"), emails.alias("_emails"),
        F.get(full(F.transform(of("website"), lambda w: F.when(extract_domain(w).contains("."), extract_domain(w)).otherwise(""))), F.lit(0)).alias("_site"),
        F.array_sort(F.array_distinct(full(F.transform(of("source"), stripped)))).alias("sources"), F.get(of("city"), F.lit(0)).alias("city"),
        F.array_distinct(full(of("city"))).alias("_cities"), F.array_distinct(full(F.transform(of("address"), extract_street))).alias("_streets"),
    )
    brands = F.filter("_names", lambda n: ~is_aggregator_name(n))
    good = F.filter(brands, lambda n: ~is_seo_title(n))
    longest = F.get(F.array_sort(F.transform(good, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), F.lit(0))["v"]
    ranked = by_priority(F.col("_emails"), F.col("_site"))
    keys = F.array_distinct(full(F.transform("_names", name_key)))
    g = g.withColumns({"_keys": keys, "_ranked": ranked})
    over = (F.size("_phones") > MAX_PHONES) | (F.size("_emails") > MAX_EMAILS)
    apart = (F.size("_streets") > 1) & (F.size("_keys") > 1) & ~_names_similar(F.col("_keys"))
    moved = (F.size("_streets") > 1) & (F.size("_keys") <= 2) & _names_similar(F.col("_keys"))
    kept_phones = F.slice("_phones", 1, MAX_PHONES)
    distant = (F.size("_phones") > 0) & (F.coalesce("city", F.lit("")) != "") & F.forall(kept_phones, lambda p: is_non_local_phone(p, F.col("city")))
    flags = (("contacts_over_limit", over), ("different_names_different_addresses", apart), ("same_name_diff_address", moved), ("different_cities", F.size("_cities") > 1), ("all_non_local_phones", distant))
    old = F.array_sort(F.array_distinct(full(of("review_reason"))))
    reason = F.array_join(F.concat(old, F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags)))), " ")
    review = F.exists(of("needs_review"), lambda x: F.coalesce(x, F.lit(False)))
    for _, on in flags:
        review = review | on
    site = pick_longest(of("website"))
    messengers = F.aggregate(
        F.flatten(F.transform("m", lambda x: x["messengers"])), F.create_map().cast("map<string,string>"),
        lambda a, e: F.when(F.map_contains_key(a, e["key"]) | (F.coalesce(e["value"], F.lit("")) == ""), a).otherwise(F.map_concat(a, F.create_map(e["key"], e["value"]))),
    )
    return g.select(
        "cluster", "merged_from", F.coalesce(longest, pick_shortest(brands), pick_shortest(F.col("_names")), F.lit("")).alias("name_best"), kept_phones.alias("phones"),
        F.slice("_ranked", 1, MAX_EMAILS).alias("emails"), pick_longest(of("address")).alias("address"), F.when(site != "", site).alias("website"), messengers.alias("messengers"),
        "sources", "city", review.alias("needs_review"), reason.alias("review_reason"),
    )


def aggregator_scan(companies: DataFrame, least_cities: int = 3, spam: tuple[str, ...] = SPAM_DOMAINS, excluded: tuple[str, ...] = NON_NETWORK_DOMAINS, foreign: tuple[str, ...] = (".ua", ".xn--j1amh")) -> DataFrame:
    """companies (id, website, city, emails) with domain, n_cities, is_network, is_spam and reason. C12."""
    at = companies.withColumn("domain", extract_domain(F.col("website"))).withColumn("_base", base_domain(F.col("website"), ()))
    cities = at.where("domain is not null").groupBy("domain").agg(F.countDistinct(F.lower("city")).alias("n_cities"))
    j = at.join(cities, "domain", "left")
    ends = lambda c: F.greatest(*(c.endswith(x) for x in foreign)) if len(foreign) > 1 else c.endswith(foreign[0])
    abroad = F.coalesce(ends(F.col("domain")), F.lit(False)) if foreign else F.lit(False)
    by_mail = F.coalesce(F.exists("emails", lambda e: ends(F.lower(stripped(F.substring_index(e, "@", -1))))), F.lit(False)) if foreign else F.lit(False)
    listed = F.coalesce(F.col("domain").isin(*spam) | F.col("_base").isin(*spam), F.lit(False))
    network = F.coalesce((F.col("n_cities") >= least_cities) & ~F.col("domain").isin(*excluded, *spam), F.lit(False)) & ~abroad
    is_spam = listed | abroad
    reason = F.concat_ws(" ", F.when(network, F.concat(F.lit("aggregator_network("), F.col("n_cities"), F.lit(" cities)"))), F.when(is_spam, "known_spam_aggregator"), F.when(by_mail, "foreign_email_spam"))
    return j.withColumns({"is_network": network & ~is_spam & ~by_mail, "is_spam": is_spam | by_mail, "reason": reason}).drop("_base")
