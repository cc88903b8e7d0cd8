"""Web-search results to raw rows: relevance, one result a domain, enrichment picks. Survey: SRC6, SRC9, SRC14, F14-F18, F22, F23, E2, X36."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.urls import extract_domain, host_suffixes, hostname

# Endings of sites that are trusted, blocked, or need both a keyword and the city.
TRUSTED_TLDS = (".ru", ".su")
BLOCKED_TLDS = (
    ".ee", ".lv", ".lt", ".ge", ".md", ".am", ".az", ".tm", ".tr", ".cn", ".il", ".pl", ".fi", ".cz", ".it", ".es",
    ".de", ".fr", ".uk", ".us", ".jp", ".kz", ".by", ".kg", ".uz",
)
GENERIC_TLDS = (".com", ".net", ".org", ".io", ".info", ".biz")

# Words of titles about other countries, about other topics, and about the trade.
FOREIGN_TITLES = (
    r"Эстон[ияию]|Латв[ияию]|Литв[аеы]|Груз[ияию]|Казахстан|Беларус[ьюи]|Украин[аеыу]|Молдов[аеы]|Армен[ияию]|Азербайджан"
    r"|Узбекистан|Туркменистан|Кыргызстан|Таджикистан|Турци[еяю]|Китай|Израил[ьюь]|США|Герман[ияиюю]|Польш[аеы]"
    r"|Финлянд[ияиюю]|Чех[ияиюю]|Итали[еяю]|Испан[ияиюю]|Tallinn|Riga|Vilnius|Baltic|Москв[аеыу]|Петербург[аеуя]"
    r"|Питер[аеу]|Екатеринбург[аеу]|Казан[ьию]|Новосибирск[аеу]|Краснодар[аеу]|Ростов[аеу]|Воронеж[аеу]"
)
JUNK_TITLES = (
    r"прогноз|ставк|букмекер|казино|азарт|спорт|футбол|хоккей|бонус|бесплатн.*скачат|кино|фильм|сериал|аниме|игра|игрушк"
    r"|порн|эрот|дать объявлен|авито|доска объявлен|новости|погода|курс.*валют|обмен.*крипт|майнинг"
)
TRADE_TITLES = (
    r"памятник|гранит|надгробие|ритуал|мемориал|захоронен|могил|камень|плита|монумент|склеп|крематорий|кладбищ|мастерск"
    r"|изготовлен|установк|ритуаль|похорон|гробов|венки|крест|обелиск"
)


def _ends(host: Column, endings: tuple[str, ...]) -> Column:
    return host.rlike(f"(?:{'|'.join(e.replace('.', chr(92) + '.') for e in endings)})$")


def is_relevant(url: Column, title: Column, city: Column, foreign_city: Column | None = None) -> Column:
    """Whether a search result is about the trade in the city: the first rule that decides. F14.

    foreign_city: whether the title names a city of another region (F16). Skip lists are joined apart (without_skipped).
    """
    host, t = hostname(url), F.coalesce(title, F.lit(""))
    abroad = F.lit(False) if foreign_city is None else F.coalesce(foreign_city, F.lit(False))
    trade = t.rlike(f"(?iu){TRADE_TITLES}")
    rule = (
        F.when(F.coalesce(url, F.lit("")) == "", False)
        .when(t.rlike(f"(?iu){FOREIGN_TITLES}"), False)
        .when(_ends(host, BLOCKED_TLDS), False)
        .when(t.rlike(f"(?iu){JUNK_TITLES}"), False)
        .when(_ends(host, TRUSTED_TLDS), ~abroad)
        .when(_ends(host, GENERIC_TLDS), trade & F.lower(t).contains(F.lower(city)))
        .otherwise(trade)
    )
    return F.coalesce(rule, F.lit(False))


def without_skipped(results: DataFrame, skip: DataFrame) -> DataFrame:
    """results whose host is neither in skip (domain) nor below one of its domains: an anti join on host suffixes. F15."""
    hosts = results.select(hostname(F.col("url")).alias("_h")).where("_h is not null").distinct()
    hit = hosts.withColumn("domain", F.explode(host_suffixes(F.col("_h")))).join(skip.select("domain").distinct(), "domain", "left_semi").select("_h").distinct()
    return results.withColumn("_h", hostname(F.col("url"))).join(hit, "_h", "left_anti").select(*results.columns)


def first_of_domain(results: DataFrame, order: str = "pos") -> DataFrame:
    """One result for each city and domain, the first in order; results without a domain go. W6."""
    rank = F.row_number().over(Window.partitionBy("city", "_d").orderBy(order))
    return results.withColumn("_d", extract_domain(F.col("url"))).where("_d is not null").withColumn("_n", rank).where("_n = 1").select(*results.columns)


def best_result(companies: DataFrame, results: DataFrame) -> DataFrame:
    """(id, url, overlap): the result that shares most of the first three long words of the name, first in order among equals. E2."""
    words = F.slice(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 2), 1, 3)
    j = companies.select("id", words.alias("_w")).join(results.select("id", "pos", "url", F.lower("title").alias("_t")), "id")
    j = j.withColumn("overlap", F.size(F.filter("_w", lambda w: F.col("_t").contains(w)))).where("overlap > 0")
    return j.groupBy("id").agg(F.max_by(F.struct("url", "overlap"), F.struct("overlap", -F.col("pos"))).alias("x")).select("id", "x.*")


def needs_contacts(companies: DataFrame, least_score: int = 5) -> DataFrame:
    """Companies without messengers and addresses below a score: candidates for reverse lookup. F22."""
    bare = (F.coalesce(F.size(F.map_keys("messengers")), F.lit(0)) <= 0) & (F.coalesce(F.size("emails"), F.lit(0)) <= 0)
    return companies.where(bare & (F.coalesce("score", F.lit(0)) < least_score))


def needs_enrichment(companies: DataFrame) -> DataFrame:
    """Companies without a site or without addresses. F23."""
    return companies.where((F.coalesce("website", F.lit("")) == "") | (F.coalesce(F.size("emails"), F.lit(0)) <= 0))


def uncached(cities: DataFrame, cache: DataFrame) -> DataFrame:
    """Cities that the category cache does not know, known to have none included. SRC14."""
    return cities.join(cache.select("name").distinct(), "name", "left_anti")


def next_delay(delay: float, status: int, least: float = 2.0, most: float = 120.0) -> float:
    """Seconds to wait after an answer: doubled when throttled, halved on success, within bounds. SRC10, ST9."""
    return min(most, delay * 2) if status == 429 else max(least, delay * 0.5)
