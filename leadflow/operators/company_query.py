"""Company search: filters, order and pages as one declarative plan. Survey: F1-F13, S1, L1, P1."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SORTS = ("id", "name", "city", "score", "segment", "updated_at", "funnel_stage", "company_count")


def like_escaped(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


@dataclass(frozen=True)
class CompanyQuery:
    """What a search may ask for; None means no condition. Flags: True keeps rows that have it, False those that lack it."""

    include_deleted: bool = False
    spam: int = 0
    trust: tuple[int | None, int | None] = (None, None)
    source: str | None = None
    cities: tuple[str, ...] = ()
    region: str | None = None
    segments: tuple[str, ...] = ()
    stage: str | None = None
    messengers: dict[str, bool] = field(default_factory=dict)
    has_email: bool | None = None
    is_network: bool | None = None
    flags: dict[str, bool] = field(default_factory=dict)
    texts: dict[str, bool] = field(default_factory=dict)
    cms: str | None = None
    score: tuple[int | None, int | None] = (None, None)
    search: str | None = None
    #: Where the search text must stand: name, domain, phone or email; None: in any of them.
    field: str | None = None
    sort: str = "id"
    descending: bool = False
    page: int = 1
    per_page: int = 50


def condition(q: CompanyQuery, have: set[str]) -> Column:
    """All conditions of q over columns that the relation has; every null branch is spelled out."""
    c: list[Column] = [F.lit(True)]
    if not q.include_deleted and "deleted_at" in have:
        c.append(F.col("deleted_at").isNull())
    if q.spam == 0:
        c.append((F.col("segment") != "spam") | F.col("segment").isNull())
    elif q.spam == 2:
        c.append(F.col("segment") == "spam")
    for at, (low, high) in {"trust_score": q.trust, "score": q.score}.items():
        if low is not None:
            c.append(F.col(at) >= low)
        if high is not None:
            c.append(F.col(at) <= high)
    if q.source:
        own = F.coalesce(F.array_contains("sources", q.source), F.lit(False))
        c.append(F.when(F.col("_listed"), own).otherwise(F.col("_from_raw")) if "_listed" in have else own)
    if cities := [x for x in q.cities if x.strip()]:
        c.append(F.col("city").isin(*cities))
    if q.region:
        c.append(F.col("region") == q.region)
    if segments := [x for x in q.segments if x.strip()]:
        c.append(F.col("segment").isin(*segments))
    if q.stage:
        c.append(F.coalesce("funnel_stage", F.lit("new")) == q.stage)
    for kind, wanted in q.messengers.items():
        there = F.coalesce(F.try_element_at("messengers", F.lit(kind)), F.lit("")) != ""
        c.append(there if wanted else ~there)
    if q.has_email is not None:
        there = F.coalesce(F.size("emails") > 0, F.lit(False))
        if "has_active_email" in have:
            there = there | F.coalesce("has_active_email", F.lit(False))
        c.append(there if q.has_email else ~there)
    if q.is_network is not None:
        c.append(F.col("is_network") if q.is_network else F.col("network_id").isNull())
    for name, wanted in q.flags.items():
        there = F.coalesce(F.col(name), F.lit(False))
        c.append(there if wanted else ~there)
    for name, wanted in q.texts.items():
        there = F.coalesce(F.col(name), F.lit("")) != ""
        c.append(there if wanted else ~there)
    if q.cms:
        c.append(F.col("cms") == q.cms)
    if q.search and q.search.strip():
        text = f"%{like_escaped(q.search.strip().lower())}%"
        number = re.sub(r"[\s()+-]", "", q.search)
        hit = F.lit(False)
        for name, field_ in (("name", "name"), ("website", "domain")):
            if name in have and q.field in (None, field_):
                hit = hit | F.coalesce(F.lower(name).like(text), F.lit(False))
        if "phones" in have and number and q.field in (None, "phone"):
            hit = hit | F.coalesce(F.exists("phones", lambda p: F.replace(p, F.lit("+"), F.lit("")).contains(number)), F.lit(False))
        if q.field in (None, "email"):
            if "emails" in have:
                hit = hit | F.coalesce(F.exists("emails", lambda e: F.lower(e).like(text)), F.lit(False))
            if "_mail_like" in have:
                hit = hit | F.col("_mail_like")
        c.append(hit)
    out = c[0]
    for x in c[1:]:
        out = out & x
    return out


def search(companies: DataFrame, q: CompanyQuery, key: str = "id") -> DataFrame:
    """Rows of companies that fit q, unordered and unpaged."""
    return companies.where(condition(q, set(companies.columns)))


#: Sources that may be asked for.
SOURCES = ("jsprav", "web_search", "2gis", "yell", "jsprav_playwright", "avito", "google_maps")


def find(companies: DataFrame, q: CompanyQuery, company_emails: DataFrame | None = None, raw: DataFrame | None = None, key: str = "id", sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Rows of companies that fit q, with all that a search may look at. F1-F12.

    company_emails (company_id, email): addresses kept apart, which the text may stand in as well as in a company's own
    list. raw (id, merged_into, source): where no live company lists its sources, the companies that raw rows of the
    source belong to. Each is one semi join on ids that its filter leaves; an unknown source is an error.
    """
    if q.source and q.source not in sources:
        raise ValueError(f"source must be one of {', '.join(sorted(sources))}")
    columns, rows = companies.columns, companies
    text = (q.search or "").strip().lower()
    if company_emails is not None and text and q.field in (None, "email"):
        like = company_emails.where(F.lower("email").like(f"%{like_escaped(text)}%")).select(F.col("company_id").alias(key)).distinct().withColumn("_mail_like", F.lit(True))
        rows = rows.join(like, key, "left").withColumn("_mail_like", F.coalesce("_mail_like", F.lit(False)))
    if raw is not None and q.source:
        alive = F.col("deleted_at").isNull() if "deleted_at" in columns else F.lit(True)
        listed = companies.where(alive & (F.size("sources") > 0)).limit(1).agg((F.count("*") > 0).alias("_listed"))
        of = raw.where(F.col("source") == q.source).select(F.coalesce("merged_into", "id").alias(key)).distinct().withColumn("_from_raw", F.lit(True))
        rows = rows.join(of, key, "left").withColumn("_from_raw", F.coalesce("_from_raw", F.lit(False))).crossJoin(F.broadcast(listed))  # one row
    return rows.where(condition(q, set(rows.columns))).select(*columns)


def find_page(companies: DataFrame, q: CompanyQuery, company_emails: DataFrame | None = None, raw: DataFrame | None = None, key: str = "id", sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One page of find with `total`, the number of all its rows, from one pass: rows are counted on their way to the page. L1.

    A page is small by its nature, so it is what the driver holds; an empty page has no row to carry the total.
    """
    seen = Observation()
    found = find(companies, q, company_emails, raw, key, sources).observe(seen, F.count(F.lit(1)).alias("total"))
    by = F.col(q.sort)
    order = [by.desc_nulls_last() if q.descending else by.asc_nulls_first(), F.col(key)]
    rows = found.orderBy(*order).limit(q.page * q.per_page).offset((q.page - 1) * q.per_page).collect()
    schema = StructType([*companies.schema.fields, StructField("total", LongType())])
    return companies.sparkSession.createDataFrame([(*r, seen.get["total"]) for r in rows], schema)


def page(companies: DataFrame, q: CompanyQuery, key: str = "id") -> DataFrame:
    """One page of search, ordered; nulls last when descending and first when ascending, ties by key."""
    by = F.col(q.sort)
    found = search(companies, q).orderBy(by.desc_nulls_last() if q.descending else by.asc_nulls_first(), key)
    return found.offset((q.page - 1) * q.per_page).limit(q.per_page)


def with_active_email(companies: DataFrame, company_emails: DataFrame, key: str = "id") -> DataFrame:
    """companies with has_active_email: one left join to the distinct owners of active addresses. F8, J8."""
    owners = company_emails.where("is_active").select(F.col("company_id").alias(key)).distinct().withColumn("has_active_email", F.lit(True))
    return companies.join(owners, key, "left").withColumn("has_active_email", F.coalesce("has_active_email", F.lit(False)))


def preset_filter(filters: str | None) -> tuple[list[Column], list[str]]:
    """Conditions of a preset and the clauses that it does not know (they are ignored). F13.

    Clauses are joined by AND: `telegram|whatsapp|vk IS [NOT] NULL`, `emails IS NOT NULL`, `crm_score >=|<=|= n`,
    `segment = 'A'`; `1=1` and nothing at all keep everything.
    """
    known, unknown = [], []
    for clause in re.split(r"\s+AND\s+", (filters or "").strip(), flags=re.I):
        clause = clause.strip()
        if not clause or clause == "1=1":
            continue
        if m := re.fullmatch(r"(telegram|whatsapp|vk)\s+IS\s+(NOT\s+)?NULL", clause, re.I):
            there = F.coalesce(F.map_contains_key("messengers", m[1].lower()), F.lit(False))
            known.append(there if m[2] else ~there)
        elif re.fullmatch(r"emails?\s+IS\s+NOT\s+NULL", clause, re.I):
            known.append(F.coalesce(F.size("emails") > 0, F.lit(False)))
        elif m := re.fullmatch(r"crm_score\s*(>=|<=|=)\s*(\d+)", clause, re.I):
            s, n = F.col("score"), int(m[2])
            known.append({">=": s >= n, "<=": s <= n, "=": s == n}[m[1]])
        elif m := re.fullmatch(r"segment\s*=\s*'([A-D])'", clause, re.I):
            known.append(F.col("segment") == m[1].upper())
        else:
            unknown.append(clause)
    return known, unknown
