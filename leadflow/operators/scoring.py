"""Additive score, segments and technical weights. Survey: K1-K4, A37."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.phones import is_non_local_phone
from leadflow.functions.urls import extract_domain
from leadflow.functions.values import SEO_SCORE_PHRASES


# Weights, penalties and thresholds.
@dataclass(frozen=True)
class ScoreRules:
    has_website: int = 5
    cms_bitrix: int = 10
    cms_modern: int = 3
    has_marquiz: int = 4
    has_telegram: int = 15
    has_whatsapp: int = 10
    trust_multiplier: int = 3
    bot_penalty: int = 10
    multiple_phones: int = 5
    has_email: int = 5
    is_network: int = 5
    has_address: int = 5
    non_local_penalty: int = 5
    seo_penalty: int = 15
    tld: tuple[tuple[str, int], ...] = ((".kz", -5), (".by", -5), (".com", -3), (".net", -3), (".org", -3), (".biz", -5))
    tech: dict[str, int] = field(default_factory=lambda: {"production": 8, "equipment": 5, "portrait": 2, "site_constructor": -3})
    levels: tuple[int, int, int] = (40, 25, 15)

    def problems(self) -> list[str]:
        """What is wrong with these rules; empty if nothing is. K4."""
        a, b, c = self.levels
        out = [] if a > b > c > 0 else ["levels must fall and be positive"]
        out += [f"{k} must not be negative" for k in ("has_website", "has_telegram", "has_whatsapp", "has_email") if getattr(self, k) < 0]
        return out + [f"penalty of {t} must not be positive" for t, p in self.tld if p > 0]


PRODUCTION = ScoreRules()


def score(columns: set[str], r: ScoreRules = PRODUCTION) -> Column:
    """The score as one expression over the columns that the relation has; missing ones count as absent."""
    get = lambda name, kind: F.col(name) if name in columns else F.lit(None).cast(kind)
    points = lambda on, n: F.when(F.coalesce(on, F.lit(False)), n).otherwise(0)
    site, name, city = get("website", "string"), get("name", "string"), get("city", "string")
    phones, emails = get("phones", "array<string>"), get("emails", "array<string>")
    messengers, tech = get("messengers", "map<string,string>"), get("tech_signals", "array<string>")
    has_site = F.coalesce(site, F.lit("")) != ""
    has = lambda kind: F.coalesce(F.try_element_at(messengers, F.lit(kind)), F.lit("")) != ""
    cms = get("cms", "string")
    out = points(has_site, r.has_website)
    out = out + points(has_site & (cms == "bitrix"), r.cms_bitrix) + points(has_site & cms.isin("wordpress", "tilda", "flexbe"), r.cms_modern)
    out = out + points(has_site & get("has_marquiz", "boolean"), r.has_marquiz)
    out = out + points(has("telegram"), r.has_telegram) + F.when(has("telegram"), F.coalesce(get("trust_score", "int"), F.lit(0)) * r.trust_multiplier).otherwise(0)
    out = out - points(has("telegram") & get("is_bot", "boolean"), r.bot_penalty) + points(has("whatsapp"), r.has_whatsapp)
    out = out + points(F.size(phones) > 1, r.multiple_phones)
    distant = (F.size(phones) > 0) & (F.coalesce(city, F.lit("")) != "") & F.forall(phones, lambda p: is_non_local_phone(p, city))
    out = out - points(distant, r.non_local_penalty) + points(F.size(emails) > 0, r.has_email) + points(get("is_network", "boolean"), r.is_network)
    for category, n in r.tech.items():
        out = out + points(F.array_contains(tech, category), n)
    out = out + points(F.coalesce(get("address", "string"), F.lit("")) != "", r.has_address)
    domain, penalty = extract_domain(site), F.lit(0)
    for ending, n in reversed(r.tld):
        penalty = F.when(domain.endswith(ending), n).otherwise(penalty)
    out = out + F.when(has_site & domain.isNotNull(), penalty).otherwise(0)
    out = out - points(name.rlike(f"(?iu){SEO_SCORE_PHRASES}"), r.seo_penalty)
    return F.greatest(F.lit(0), out).cast("long")


def segment(points: Column, r: ScoreRules = PRODUCTION) -> Column:
    """spam for 0, then A, B, C by threshold, else D."""
    a, b, c = r.levels
    return F.when(points == 0, "spam").when(points >= a, "A").when(points >= b, "B").when(points >= c, "C").otherwise("D")


def scored(companies: DataFrame, r: ScoreRules = PRODUCTION) -> DataFrame:
    """companies with score and segment. K3."""
    out = companies.withColumn("_s", score(set(companies.columns) - {"score", "segment"}, r))
    return out.withColumn("score", F.col("_s")).withColumn("segment", segment(F.col("_s"), r)).drop("_s")


def score_changes(companies: DataFrame, r: ScoreRules = PRODUCTION) -> DataFrame:
    """id, old and new score and segment of rows that scoring would change. A37."""
    now = companies.withColumns({"new_score": score(set(companies.columns) - {"score", "segment"}, r)})
    now = now.withColumn("new_segment", segment(F.col("new_score"), r))
    return now.where(~F.col("score").eqNullSafe(F.col("new_score")) | ~F.col("segment").eqNullSafe(F.col("new_segment"))).select("id", "score", "new_score", "segment", "new_segment")


def trust_score(avatar: Column, description: Column, channel: Column, bot: Column) -> Column:
    """One up for an avatar and a description, one down for a channel and a bot. X31."""
    n = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return n(avatar) + n(description) - n(channel) - n(bot)
