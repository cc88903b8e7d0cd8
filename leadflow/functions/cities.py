"""City names in text: roots of a gazetteer, mentions and their weight, reassignment. Survey: X21-X24, X36, F16, F17, J18, SRC12, SRC13."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.names import slugify
from leadflow.functions.urls import hostname
from leadflow.functions.values import CITY_PREPOSITIONS, CITY_SEPARATORS, STREET_WORDS


def gazetteer(rows: DataFrame) -> DataFrame:
    """(name, region, is_doppelganger) from (pos, region, name): the first region wins, names met twice are marked. SRC12."""
    return rows.groupBy("name").agg(F.min_by("region", "pos").alias("region"), (F.count("*") > 1).alias("is_doppelganger"))


def with_region(rows: DataFrame, cities: DataFrame, city: str = "city") -> DataFrame:
    """rows with the region of their city, empty where it is unknown. J18."""
    return rows.drop("region").join(cities.select(F.col("name").alias(city), "region"), city, "left").withColumn("region", F.coalesce("region", F.lit("")))


def expand(cities: DataFrame, what: str) -> DataFrame:
    """Names of all cities, of one city, of a region's cities, or the literal name, in that order of precedence. SRC13."""
    one, region = cities.where(F.col("name") == what), cities.where(F.col("region") == what)
    literal = cities.sparkSession.createDataFrame([(what,)], "name string")
    if what == "all":
        return cities.select("name")
    if not one.isEmpty():
        return one.select("name")
    return region.select("name") if not region.isEmpty() else literal


def city_roots(cities: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(root, city): lower-cased name, the name without its last letter, without a final soft sign; five letters or more.

    Names that stand for several places have no root. A root of two cities goes to the one that comes first. X21.
    """
    low = F.lower("name")
    n = F.length(low)
    roots = F.array_compact(F.array(
        F.when(n >= 5, low), F.when((n >= 5) & (F.greatest(F.lit(5), n - 1) < n), F.substr(low, F.lit(1), F.greatest(F.lit(5), n - 1))),
        F.when((n >= 5) & low.endswith("ь"), F.substr(low, F.lit(1), n - 1)),
    ))
    each = cities.where("not is_doppelganger").select("name", F.explode(F.array_distinct(roots)).alias("root"))
    if stop:
        each = each.where(~F.col("root").isin(*stop))
    return each.groupBy("root").agg(F.min("name").alias("city"))


#: Java's \s.
_SPACE = " \t\n\x0b\f\r"


def mention_weight(text: str, start: int, end: int, prepositions: tuple[str, ...], separators: tuple[str, ...]) -> int:
    """Weight of a mention: 3 after a preposition, 2 after a separator, 1 otherwise, 0 inside a word or with over two letters behind it. X22."""
    if start and text[start - 1].isalpha() or len(after := text[end : end + 3]) == 3 and after.isalpha():
        return 0
    if not start:
        return 1
    before = text[max(0, start - 40) : start]  # prepositions are short
    if before.endswith(prepositions):
        return 3
    bare = before.rstrip(_SPACE) or text[:start].rstrip(_SPACE)[-40:]
    return 2 if bare.endswith(separators) else 1


class _Mentions:
    """Finds the heaviest mention of a text by one pass of an automaton over all roots."""

    def __init__(self, roots: list[tuple[str, str]], prepositions: tuple[str, ...], separators: tuple[str, ...]):
        import ahocorasick

        self.of = ahocorasick.Automaton()
        for root, city in roots:
            self.of.add_word(root, (len(root), city))
        self.of.make_automaton()
        self.words = prepositions, separators

    def best(self, text: str, exclude: str | None) -> tuple[int, int, str] | None:
        """(weight, length of the root, city); among equals the longer root, then the later name."""
        out = None
        for last, (n, city) in self.of.iter(text):
            if city != exclude and (out is None or (3, n, city) > out):
                w = mention_weight(text, last - n + 1, last + 1, *self.words)
                if w and (out is None or (w, n, city) > out):
                    out = (w, n, city)
        return out


#: Roots of one automaton: some tens of MB in a task.
ROOTS = 100_000


def detect_cities(texts: DataFrame, key: str, text: str, roots: DataFrame, exclude: str | None = None, prepositions: tuple[str, ...] = CITY_PREPOSITIONS, separators: tuple[str, ...] = CITY_SEPARATORS, most: int = ROOTS) -> DataFrame:
    """(key, city) of the heaviest mention in each text, longer roots first among equals; texts without one are left out. X22, J20.

    Roots may have any length and several words. They form automata of `most` roots at most, which tasks get with their
    code; a text passes each of them once, whatever the number of roots. A gazetteer that needs more than one automaton
    is dealt over several, whose best mentions meet by key. An excluded city (column `exclude`) is no mention.
    """
    own = [F.col(key).alias("key"), F.lower(F.col(text)).alias("text"), (F.col(exclude) if exclude else F.lit(None)).cast("string").alias("not")]
    base = texts.where(F.col(text).isNotNull()).select(*own)
    named = roots.where(F.col("root").isNotNull() & (F.col("root") != "") & F.col("city").isNotNull()).select("root", "city")
    parts = max(1, -(-named.count() // most))
    kind = base.schema["key"].dataType.simpleString()

    def search(listed: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mentions = _Mentions(listed, prepositions, separators) if listed else None
            for b in batches:
                found = [mentions.best(t, x) if mentions else None for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                rows = [i for i, f in enumerate(found) if f]
                hits = [found[i] for i in rows]
                keys = b.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([w for w, _, _ in hits], pa.int32()), pa.array([n for _, n, _ in hits], pa.int32()), pa.array([c for _, _, c in hits], pa.string())], ["key", "w", "n", "city"])

        return base.mapInArrow(run, f"key {kind}, w int, n int, city string")

    found = None
    for i in range(parts):
        part = search([tuple(r) for r in named.where(F.pmod(F.xxhash64("root"), F.lit(parts)) == i).collect()])
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("key").agg(F.max_by("city", F.struct("w", "n", "city")).alias("city"))
    return best.withColumnRenamed("key", key)


def is_local(address_city: Column, city: Column) -> Column:
    """Whether two place names mean one: equal, a prefix of 70 % or more, or equal without final vowels (five letters). F17."""
    a, b = F.lower(F.trim(address_city)), F.lower(F.trim(city))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    stem = lambda c: F.regexp_replace(c, "[аеёиоуыэюяьй]+$", "")
    return F.coalesce((a == b) | ((a.startswith(b) | b.startswith(a)) & (short >= 0.7 * long)) | ((F.length(stem(a)) >= 5) & (stem(a) == stem(b))), F.lit(False))


def names_foreign_city(texts: DataFrame, key: str, text: str, roots: DataFrame, region: str, most: int = ROOTS) -> DataFrame:
    """(key) of the texts in which a root of a city of another region begins a word; its end does not matter. F16.

    roots: root, city, region. As in detect_cities, roots form automata of `most` roots at most.
    """
    foreign = roots.where(~F.col("region").eqNullSafe(F.lit(region)) & (F.col("root") != "")).select("root")
    parts = max(1, -(-foreign.count() // most))
    base = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    kind = base.schema["key"].dataType.simpleString()

    def search(listed: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _Mentions(listed, (), ()).of if listed else None
            for b in batches:
                hit = [of is not None and any(last < n or not t[last - n].isalpha() for last, (n, _) in of.iter(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], ["key"])

        return base.mapInArrow(run, f"key {kind}")

    found = None
    for i in range(parts):
        part = search([(r.root, "") for r in foreign.where(F.pmod(F.xxhash64("root"), F.lit(parts)) == i).collect()])
        found = part if found is None else found.union(part)
    return (found if parts == 1 else found.distinct()).withColumnRenamed("key", key)


def _subdomain_is(website: Column, city: Column) -> Column:
    """Whether a site's first label begins like a city: its first five letters, or all of the shorter one (three at least)."""
    host = F.coalesce(hostname(website), F.lit(""))
    label = F.when(host.contains("."), F.split_part(host, F.lit("."), F.lit(1))).otherwise(F.lit(""))
    slug = slugify(city)
    n = F.least(F.lit(5), F.length(label), F.length(slug))
    return (n >= 3) & (F.substr(label, F.lit(1), n) == F.substr(slug, F.lit(1), n))


def city_moves(companies: DataFrame, cities: DataFrame, roots: DataFrame, **words: tuple[str, ...]) -> DataFrame:
    """(id, name, city, new_city, region) of companies whose address plainly names another city. X23.

    companies: id, name, city, address, website. The address must have six characters, be no URL and hold a word for a
    street; a site that holds the present city, or whose first label begins like it, keeps a company where it is. A city
    that the gazetteer (name, region) gives no region is a dead letter: `region` is null. words: as in detect_cities.
    """
    a = F.trim(F.coalesce("address", F.lit("")))
    street = F.lit(False)
    for w in STREET_WORDS:
        street = street | F.lower(a).contains(w)
    link = a.startswith("http://") | a.startswith("https://") | a.startswith("www.")
    named = F.coalesce(F.lower("website").contains(F.lower("city")), F.lit(False))
    c = companies.where((F.length(a) >= 6) & ~link & street & ~named).select("id", "name", "city", "website", a.alias("_a"))
    found = detect_cities(c, "id", "_a", roots, exclude="city", **words).withColumnRenamed("city", "new_city")
    moved = c.join(found, "id").where(~F.coalesce(_subdomain_is(F.col("website"), F.col("city")), F.lit(False)))
    known = cities.select(F.col("name").alias("new_city"), "region").where("region <> ''").dropDuplicates(["new_city"])
    return moved.join(known, "new_city", "left").select("id", "name", "city", "new_city", "region")


def reassigned(companies: DataFrame, moves: DataFrame) -> DataFrame:
    """companies (id, city, region, review_reason, ...) in their new cities; dead letters change nothing. X23."""
    to = moves.where("region is not null").select("id", F.col("new_city").alias("_city"), F.col("region").alias("_region"))
    j = companies.join(to, "id", "left")
    hit = F.col("_city").isNotNull()
    new = {"city": F.col("_city"), "region": F.col("_region"), "review_reason": F.concat(F.lit("city_reassigned_from_"), F.col("city"))}
    return j.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in companies.columns))


def unmatched_cities(moves: DataFrame) -> DataFrame:
    """(city, n, example) of the cities that addresses name and no gazetteer knows. X23."""
    return moves.where("region is null").groupBy(F.col("new_city").alias("city")).agg(F.count("*").alias("n"), F.min_by("name", "id").alias("example"))


def locative(rows: DataFrame, forms: DataFrame, city: str = "city") -> DataFrame:
    """rows with city_locative: the form of forms (city, locative), else the city itself. X24: forms are a list of known cities."""
    known = forms.select(F.col("city").alias("_c"), "locative").dropDuplicates(["_c"])
    j = rows.join(known, F.col(city) == F.col("_c"), "left")
    return j.select(*rows.columns, F.coalesce("locative", F.col(city)).alias("city_locative"))


def contact_zone(html: Column) -> Column:
    """Lower-cased text of a page's footer, else its address, else a block named contact or footer, else of all of it. X36."""
    block = lambda tag: F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)
    named = F.regexp_extract(html, r"""(?is)<(\w+)\b[^>]*\bid\s*=\s*["'][^"']*(?:contact|footer)[^"']*["'][^>]*>(.*?)</\1>""", 2)
    zone = F.coalesce(*(F.when(x != "", x) for x in (block("footer"), block("address"), named)), html)
    return F.lower(F.regexp_replace(zone, "<[^>]*>", " "))


def contact_city(pages: DataFrame, key: str, html: str, roots: DataFrame) -> DataFrame:
    """(key, city) of the first foreign city, by order of roots, that a page's contact zone names at the start of a word. X36.

    roots: ordinal, root, city; a list of known cities, so it is broadcast in whole.
    """
    text = pages.select(key, contact_zone(F.col(html)).alias("_t"))
    at = F.instr(F.col("_t"), F.col("root"))
    hit = text.join(F.broadcast(roots), (at > 0) & ~F.coalesce(F.substr("_t", at - 1, F.lit(1)).rlike(r"\p{L}") & (at > 1), F.lit(False)))
    return hit.groupBy(key).agg(F.min_by("city", "ordinal").alias("city"))
