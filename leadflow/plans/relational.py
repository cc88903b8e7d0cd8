"""Queries: counts, funnels, search, joins, ranking, quality and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators import quality, relations, stats
from leadflow.operators.company_query import CompanyQuery, page, preset_filter, search
from leadflow.plans.registry import COMPANIES, EVENTS, LEADS, TOUCHES, query
from leadflow.plans.views import companies, events, last_time, leads, line_signals, table, touches
from leadflow.sources import sinks

_KIND_STAGE = {"signup": "new", "view": "email_opened", "click": "replied", "purchase": "interested", "error": "unreachable"}
_STAGE_SQL = "CASE kind WHEN 'signup' THEN 'new' WHEN 'view' THEN 'email_opened' WHEN 'click' THEN 'replied' WHEN 'purchase' THEN 'interested' WHEN 'error' THEN 'unreachable' END"


@query(f"""WITH {LEADS}, {EVENTS},
last AS (SELECT company_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tm DESC, event_id DESC) AS r FROM ev) WHERE r = 1),
s AS (SELECT coalesce({_STAGE_SQL}, 'new') AS stage FROM leads LEFT JOIN last USING (company_id)),
d AS (SELECT unnest(['new','email_sent','email_opened','tg_sent','wa_sent','replied','interested','not_interested','unreachable']) AS stage)
SELECT d.stage, count(s.stage)::BIGINT AS n FROM d LEFT JOIN s USING (stage) GROUP BY d.stage""")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    """Leads by the stage that their last event left them in."""
    last = stats.latest(events(spark, d), ["company_id"], ["at", "event_id"], ["kind"])
    stage = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in _KIND_STAGE.items()))
    return stats.funnel(leads(spark, d).join(last, "company_id", "left").withColumn("stage", stage), "stage")


@query(f"WITH {LEADS} SELECT segment, count(*)::BIGINT AS n FROM leads GROUP BY segment")
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return stats.histogram(leads(spark, d), "segment", "D")


@query(f"WITH {LEADS} SELECT city, count(*)::BIGINT AS n FROM leads GROUP BY city ORDER BY n DESC, city LIMIT 10")
def top_cities(spark: SparkSession, d: str) -> DataFrame:
    """A4: a top-k report."""
    return stats.top(leads(spark, d), "city", 10)


@query(f"WITH {COMPANIES} SELECT count(*)::BIGINT AS n, count(DISTINCT city)::BIGINT AS cities, count_if(telegram IS NOT NULL)::BIGINT AS with_telegram, count_if(whatsapp IS NOT NULL)::BIGINT AS with_whatsapp, count_if(len(emails) > 0)::BIGINT AS with_email, count_if(website IS NOT NULL)::BIGINT AS with_website, count_if(is_network)::BIGINT AS in_network, round(avg(score), 1) AS avg_score FROM companies WHERE NOT deleted")
def stats_overview(spark: SparkSession, d: str) -> DataFrame:
    """One pass of conditional counts."""
    has = lambda k: F.map_contains_key("messengers", k)
    return companies(spark, d).where("not deleted").agg(
        F.count("*").alias("n"), F.countDistinct("city").alias("cities"), F.count_if(has("telegram")).alias("with_telegram"), F.count_if(has("whatsapp")).alias("with_whatsapp"),
        F.count_if(F.size("emails") > 0).alias("with_email"), F.count_if(F.col("website").isNotNull()).alias("with_website"), F.count_if("is_network").alias("in_network"), F.round(F.avg("score"), 1).alias("avg_score"),
    )


@query(f"WITH {LEADS} SELECT city, count_if(segment = 'BUILDING')::BIGINT AS \"BUILDING\", count_if(segment = 'MACHINERY')::BIGINT AS \"MACHINERY\" FROM leads GROUP BY city")
def city_segment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return stats.crosstab(leads(spark, d), "city", "segment", ["BUILDING", "MACHINERY"])


@query(f"""WITH {LEADS}, o AS (SELECT city FROM orders JOIN leads ON o_custkey = company_id), s AS (SELECT n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT city, 'raw' AS k FROM o UNION ALL SELECT city, 'companies' FROM leads UNION ALL SELECT city, 'enriched' FROM s),
g AS (SELECT city, count_if(k = 'raw')::BIGINT AS raw, count_if(k = 'companies')::BIGINT AS companies, count_if(k = 'enriched')::BIGINT AS enriched FROM u GROUP BY city)
SELECT *, CASE WHEN enriched > 0 THEN 'enriched' WHEN companies > 0 THEN 'deduped' WHEN raw > 0 THEN 'scraped' ELSE 'start' END AS stage, CASE WHEN companies > 0 THEN round(enriched / companies, 3) ELSE 0.0 END AS progress FROM g""")
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    """Three relations by city, their stage and progress."""
    own = leads(spark, d)
    raw = touches(spark, d).join(own.select("company_id", "city"), "company_id")
    done = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("city"))
    g = relations.full_key_union({"raw": raw, "companies": own, "enriched": done}, "city")
    return g.withColumn("stage", stats.stage_of_progress(F.col("raw"), F.col("companies"), F.col("enriched"))).withColumn("progress", stats.progress(F.col("enriched"), F.col("companies")))


@query(f"WITH {COMPANIES} SELECT id, name, city, segment, score FROM companies WHERE NOT deleted AND segment IN ('BUILDING', 'MACHINERY') AND score >= 10 AND telegram IS NOT NULL AND len(emails) > 0 AND lower(name) LIKE '%customer%1%' ORDER BY score DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def company_search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a search."""
    q = CompanyQuery(segments=("BUILDING", "MACHINERY", " "), score=(10, None), messengers={"telegram": True}, has_email=True, search="customer#", sort="score", descending=True, page=2, per_page=20)
    return page(companies(spark, d).where("not deleted").where(F.lower("name").like("%customer%1%")), q).select("id", "name", "city", "segment", "score")


@query(f"WITH {COMPANIES} SELECT id, segment, website FROM companies WHERE website IS NULL AND NOT coalesce(has_marquiz, FALSE) AND whatsapp IS NULL AND coalesce(address, '') <> '' AND score <= 50")
def company_search_absent(spark: SparkSession, d: str) -> DataFrame:
    """conditions on what is missing."""
    q = CompanyQuery(texts={"website": False, "address": True}, flags={"has_marquiz": False}, messengers={"whatsapp": False}, score=(None, 50))
    return search(companies(spark, d), q).select("id", "segment", "website")


@query(f"WITH {LEADS} SELECT company_id, name FROM leads WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = company_id AND o_orderpriority = '1-URGENT')")
def urgent_owners(spark: SparkSession, d: str) -> DataFrame:
    """A semi join."""
    return leads(spark, d).join(touches(spark, d).where("channel = '1-URGENT'"), "company_id", "left_semi").select("company_id", "name")


@query(f"WITH {LEADS} SELECT company_id, name FROM leads WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = company_id AND o_orderstatus = 'F')")
def never_failed(spark: SparkSession, d: str) -> DataFrame:
    """An anti join."""
    return leads(spark, d).join(touches(spark, d).where("status = 'F'"), "company_id", "left_anti").select("company_id", "name")


@query(f"WITH {TOUCHES} SELECT company_id, touch_id, status FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tm DESC, touch_id DESC) AS r FROM touches) WHERE r = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    """The last touch of each company."""
    return stats.latest(touches(spark, d), ["company_id"], ["at", "touch_id"], ["touch_id", "status"])


@query(f"WITH {LEADS}, c AS (SELECT region, city, count(*)::BIGINT AS n FROM leads GROUP BY ALL) SELECT region, city, n, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, city) AS r FROM c) WHERE r <= 3")
def top_cities_by_region(spark: SparkSession, d: str) -> DataFrame:
    """A14, W6."""
    return stats.top_per_group(leads(spark, d), "region", "city", 3)


_HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(f"""WITH s AS (SELECT DISTINCT page_id, {_HOST_SQL} AS host FROM pages), g AS (SELECT host, min(page_id) AS first, count(*)::BIGINT AS n FROM s WHERE host <> '' GROUP BY host HAVING count(*) > 1)
SELECT page_id, host, first, n FROM s JOIN g USING (host)""")
def pages_of_one_host(spark: SparkSession, d: str) -> DataFrame:
    """Every page that shares its host with others, as a member of the host's group."""
    from leadflow.plans.views import sites

    return relations.signal_groups(sites(spark, d), "page_id", "host")


@query(f"""WITH {COMPANIES}, sig AS (SELECT DISTINCT id, 'phone:' || right(regexp_replace(p, '[^0-9]', '', 'g'), 6) AS signal FROM (SELECT id, unnest(phones) AS p FROM companies) UNION SELECT id, 'email:' || e FROM (SELECT id, unnest(emails) AS e FROM companies)
UNION SELECT id, 'site:' || {_HOST_SQL.replace("url", "website")} FROM companies WHERE website IS NOT NULL UNION SELECT id, 'address:' || address FROM companies WHERE address <> ''),
g AS (SELECT signal, min(id) AS first, count(*)::BIGINT AS n FROM sig GROUP BY signal HAVING count(*) > 1) SELECT id, signal, first, n FROM sig JOIN g USING (signal)""")
def similar_companies(spark: SparkSession, d: str) -> DataFrame:
    """All companies with others of the same line number, address, site or street."""
    from leadflow.functions.urls import extract_domain

    c = companies(spark, d)
    own = lambda kind, value: F.concat(F.lit(f"{kind}:"), value).alias("signal")
    phones = c.select("id", F.explode("phones").alias("v")).select("id", own("phone", F.substring(F.regexp_replace("v", "[^0-9]", ""), -6, 6)))
    signals = phones.union(c.select("id", F.explode("emails").alias("v")).select("id", own("email", F.col("v"))))
    signals = signals.union(c.select("id", own("site", extract_domain(F.col("website"))))).union(c.where("address <> ''").select("id", own("address", F.col("address"))))
    return relations.signal_groups(signals, "id", "signal")


@query(f"""WITH {TOUCHES}, v AS (SELECT CASE WHEN ('0x' || right(md5(company_id::VARCHAR), 1))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS variant, status FROM touches)
SELECT variant, count(*)::BIGINT AS sent, count_if(status IN ('F', 'P'))::BIGINT AS opened, count_if(status = 'P')::BIGINT AS replied, round(count_if(status IN ('F', 'P')) * 100.0 / count(*)::DOUBLE, 1)::DOUBLE AS open_rate, round(count_if(status = 'P') * 100.0 / count(*)::DOUBLE, 1)::DOUBLE AS reply_rate FROM v GROUP BY variant""")
def ab_stats(spark: SparkSession, d: str) -> DataFrame:
    """A9, A10, X41."""
    return stats.ab_stats(touches(spark, d), "company_id", F.col("status").isin("F", "P"), F.col("status") == "P")


@query(f"WITH {EVENTS} SELECT 'd' || (k % 10) AS domain, count(*)::BIGINT AS n FROM ev WHERE kind = 'error' AND tm >= (SELECT max(tm) FROM ev) - INTERVAL 24 HOURS GROUP BY ALL HAVING count(*) >= 2")
def bounce_blocklist(spark: SparkSession, d: str) -> DataFrame:
    """`now` is the last event."""
    e = events(spark, d)
    bad = e.where("kind = 'error'").withColumn("domain", F.concat(F.lit("d"), (F.col("k") % 10).cast("string")))
    return stats.blocked_domains(bad, "domain", "at", last_time(e, "at"), 24, 2)


@query("SELECT lower(trim(p_name)) AS name_key, p_brand AS city, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """A23, J10."""
    return stats.duplicate_names(table(spark, d, "part"), "p_partkey", "p_name", "p_brand")


@query(f"""WITH {LEADS}, g AS (SELECT city, count(*)::BIGINT AS n, count_if(score = 0)::BIGINT AS n_zero, round(count_if(score = 0) * 100.0 / count(*)::DOUBLE, 1)::DOUBLE AS pct_zero, round(avg(score), 1) AS avg_score FROM leads GROUP BY city)
SELECT *, CASE WHEN pct_zero < 25 THEN 'good' WHEN pct_zero < 30 THEN 'fair' WHEN pct_zero < 35 THEN 'poor' ELSE 'critical' END AS bucket FROM g""")
def quality_by_city(spark: SparkSession, d: str) -> DataFrame:
    """A20, A21, A27."""
    return leads(spark, d).groupBy("city").agg(*stats.health("score")).withColumn("bucket", stats.health_bucket(F.col("pct_zero")))


@query(f"WITH {COMPANIES} SELECT city, count(*)::BIGINT AS n FROM companies WHERE len(phones) = 0 AND len(emails) = 0 AND website IS NULL GROUP BY city")
def dead_records(spark: SparkSession, d: str) -> DataFrame:
    """A24."""
    return stats.histogram(companies(spark, d).where((F.size("phones") == 0) & (F.size("emails") == 0) & F.col("website").isNull()), "city")


@query(f"WITH {COMPANIES} SELECT cms, count(*)::BIGINT AS n FROM companies GROUP BY cms")
def cms_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    return stats.histogram(companies(spark, d), "cms")


@query(f"WITH {COMPANIES} SELECT id, score, segment FROM companies WHERE score < 15 AND (website IS NOT NULL OR len(emails) > 0) ORDER BY score, id LIMIT 50")
def scoring_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    odd = companies(spark, d).where((F.col("score") < 15) & (F.col("website").isNotNull() | (F.size("emails") > 0)))
    return odd.orderBy("score", "id").limit(50).select("id", "score", "segment")


@query(f"WITH {EVENTS} SELECT event_id, kind, k FROM ev WHERE k BETWEEN 10 AND 20")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    """F3, X46."""
    return events(spark, d).where("k between 10 and 20").select("event_id", "kind", "k")


@query(f"WITH {EVENTS} SELECT k, count(*)::BIGINT AS n FROM ev GROUP BY k")
def json_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A33, X46."""
    return stats.histogram(events(spark, d), "k")


@query(f"WITH {COMPANIES}, m AS (SELECT unnest(list_filter([CASE WHEN telegram IS NOT NULL THEN 'telegram' END, CASE WHEN whatsapp IS NOT NULL THEN 'whatsapp' END], lambda x: x IS NOT NULL)) AS kind FROM companies) SELECT kind, count(*)::BIGINT AS n FROM m GROUP BY kind")
def messenger_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A33."""
    return quality.messenger_histogram(companies(spark, d))


_DOMAIN_SQL = r"regexp_replace(lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(f"WITH {COMPANIES}, g AS (SELECT {_DOMAIN_SQL} AS domain, count(*)::BIGINT AS n, count(DISTINCT city)::BIGINT AS n_cities FROM companies WHERE website IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT *, CASE WHEN n_cities = 1 THEN 'single_city' WHEN n_cities = n THEN 'one_per_city' ELSE 'mixed' END AS kind FROM g")
def website_groups(spark: SparkSession, d: str) -> DataFrame:
    """A28, A29."""
    return quality.website_groups(companies(spark, d))


@query("SELECT lower(trim(p_name)) AS name_key, p_brand AS city, count(*)::BIGINT AS n, CASE WHEN bool_or(p_size > 45) THEN 'network' WHEN count(DISTINCT CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END) > 1 THEN 'multi_site' WHEN count(DISTINCT CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END) = 0 THEN 'no_site' ELSE 'single_site' END AS kind FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_group_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A30."""
    site = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("https://s"), (F.col("p_partkey") % 3).cast("string"), F.lit(".ru")))
    return quality.duplicate_group_kind(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("city"), (F.col("p_size") > 45).alias("is_network"), site.alias("website")))


@query(f"""WITH {COMPANIES}, c AS (SELECT *, {_DOMAIN_SQL} AS domain, (len(emails) > 0)::INT + (len(phones) > 0)::INT + (address <> '')::INT AS f FROM companies WHERE website IS NOT NULL),
g AS (SELECT domain, count(*)::BIGINT AS n, count_if(len(emails) > 0) AS w, arg_max(id, f * 100000000 - id) AS target FROM c GROUP BY domain HAVING count(*) > 1),
e AS (SELECT domain, max(k) AS most FROM (SELECT domain, e, count(DISTINCT id) AS k FROM (SELECT domain, id, unnest(emails) AS e FROM c) GROUP BY ALL) GROUP BY domain)
SELECT domain, CASE WHEN w = 0 OR coalesce(most, 0) = w THEN 'merge' ELSE 'network' END AS action, target, n FROM g LEFT JOIN e USING (domain)""")
def site_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """C18, W4, W5."""
    return quality.site_merge_plan(companies(spark, d))


@query(f"WITH {COMPANIES} SELECT id, score FROM companies WHERE telegram IS NOT NULL AND score >= 50 AND score > 0 AND segment <> 'spam'")
def preset_hot_leads(spark: SparkSession, d: str) -> DataFrame:
    """F13, SNK2: a preset's conditions; clauses that it does not know are ignored."""
    return sinks.export_rows(companies(spark, d), "telegram IS NOT NULL AND crm_score >= 50 AND colour = 'red'").select("id", "score")


@query(f"WITH {COMPANIES} SELECT id FROM companies WHERE telegram IS NULL AND whatsapp IS NULL AND len(emails) > 0")
def preset_cold_email(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    out = companies(spark, d)
    for c in preset_filter("telegram IS NULL AND whatsapp IS NULL AND emails IS NOT NULL")[0]:
        out = out.where(c)
    return out.select("id")


@query(f"""WITH {COMPANIES} SELECT id, coalesce(name, '') AS name, array_to_string(phones, '; ') AS phones, coalesce(address, '') AS address, coalesce(website, '') AS website, array_to_string(emails, '; ') AS emails, coalesce(telegram, '') AS telegram, coalesce(whatsapp, '') AS whatsapp, '' AS vk, cms,
CASE WHEN has_marquiz THEN 'Yes' ELSE 'No' END AS has_marquiz, CASE WHEN is_network THEN 'Yes' ELSE 'No' END AS is_network, score, segment, city FROM companies WHERE score > 0""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK3, P3."""
    return sinks.csv_rows(sinks.export_rows(companies(spark, d)))


@query(f"""WITH {COMPANIES} SELECT city, 'D' AS segment, row_number() OVER (PARTITION BY city ORDER BY score DESC, id)::BIGINT AS pos,
'| ' || name || ' | ' || score || ' | ' || array_to_string(phones, ', ') || ' | ' || array_to_string(emails, ', ') || ' | ' || CASE WHEN website IS NULL THEN '' ELSE '[' || website || '](' || website || ')' END || ' |' AS line FROM companies""")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, X43."""
    return sinks.markdown_lines(companies(spark, d))


@query("SELECT coalesce(signal, '') AS signal, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS signal FROM documents) WHERE length(signal) >= 40 GROUP BY signal HAVING count(*) >= 10")
def hub_signals(spark: SparkSession, d: str) -> DataFrame:
    """Lines of so many documents that they tie nobody."""
    return line_signals(spark, d).groupBy("signal").agg(F.count("*").alias("n")).where("n >= 10")


@query(f"WITH {LEADS}, {EVENTS}, l AS (SELECT company_id, max(tm) AS last FROM ev GROUP BY company_id) SELECT company_id, coalesce(floor((epoch((SELECT max(tm) FROM ev)) - epoch(last)) / 86400)::BIGINT, 999)::BIGINT AS days FROM leads LEFT JOIN l USING (company_id)")
def days_since_event(spark: SparkSession, d: str) -> DataFrame:
    """X47."""
    from leadflow.operators.crm import days_between

    e = events(spark, d)
    last = e.groupBy("company_id").agg(F.max("at").alias("last"))
    return leads(spark, d).join(last, "company_id", "left").select("company_id", F.coalesce(days_between(last_time(e, "at"), F.col("last")), F.lit(999)).alias("days"))
