"""Company names, addresses, slugs and name similarity. Survey: X12, X13, X17-X19, C5, C9."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leadflow.functions.values import AGGREGATOR_NAMES, LEGAL_FORMS, SEO_PHRASES, TRANSLITERATION


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_seo_title(name: Column) -> Column:
    """Whether a name reads like an advertising title."""
    words = F.split(stripped(name), r"\s+")
    glued = name.rlike("(?iu)[а-яё]{16,}")
    long_word = F.exists(words, lambda w: (F.length(w) > 20) & ~w.startswith("http"))
    letters = F.length(F.regexp_replace(name, "(?iu)[^а-яa-z]", ""))
    bad = (F.length(name) > 100) | name.rlike(f"(?iu){SEO_PHRASES}") | glued | ((F.length(name) > 25) & ~name.contains(" ")) | long_word | (letters < 3)
    return name.isNull() | (name == "") | F.coalesce(bad, F.lit(True))


def is_aggregator_name(name: Column) -> Column:
    return F.coalesce(stripped(F.lower(name)).isin(*AGGREGATOR_NAMES), F.lit(False))


def name_key(name: Column) -> Column:
    """Lower-cased and trimmed: what equal names share."""
    return stripped(F.lower(name))


def block_key(name: Column) -> Column:
    """First letter after a legal form, "#" for anything but a letter, null for blank names."""
    bare = stripped(F.regexp_replace(name, rf"(?iu)^(?:{'|'.join(LEGAL_FORMS)})\s+", ""))
    first = F.substring(F.lower(F.when(bare != "", bare).otherwise(name)), 1, 1)
    return F.when(stripped(name) != "", F.when(first.rlike(r"^\p{L}$"), first).otherwise("#"))


def extract_street(address: Column) -> Column:
    """Street name of an address, lower-cased; the part before the first comma where no street word is found."""
    a = F.lower(F.coalesce(address, F.lit("")))
    tail = lambda sep: F.substr(a, F.instr(a, sep) + len(sep))
    a = F.when(a.contains("г. "), tail("г. ")).when(a.contains("город "), tail("город ")).otherwise(a)
    street = r"(?:ул\.?|улица|пр-т\.?|проспект|пер\.?|переулок)\s*(.+?)[,0-9]"
    return F.when(a.rlike(street), stripped(F.regexp_extract(a, street, 1))).when(a.contains(","), stripped(F.substring_index(a, ",", 1))).otherwise(a)


def transliterated(c: Column) -> Column:
    c = stripped(F.lower(c))
    for a, b in TRANSLITERATION:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slugify(text: Column) -> Column:
    bare = F.regexp_replace(transliterated(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "^-+|-+$", "")


def safe_filename(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(transliterated(F.coalesce(name, F.lit(""))), "[^a-z0-9_-]", "_"), "_+", "_")
    s = F.substring(F.regexp_replace(s, "^[_-]+|[_-]+$", ""), 1, 100)
    return F.when(s == "", "unnamed").otherwise(s)


def pick_longest(values: Column) -> Column:
    """The longest trimmed value of an array, the first among equals; empty without any."""
    bare = F.filter(F.transform(values, stripped), lambda v: v.isNotNull() & (v != ""))
    best = F.array_sort(F.transform(bare, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v"))))
    return F.coalesce(F.get(best, F.lit(0))["v"], F.lit(""))


def pick_shortest(values: Column) -> Column:
    """The shortest value of an array that is not empty, the first among equals; null without any."""
    best = F.array_sort(F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda v, i: F.struct(F.length(v).alias("n"), i.alias("i"), v.alias("v"))))
    return F.get(best, F.lit(0))["v"]


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two names' distinct words; 0 where one has none."""
    wa, wb = (F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")) for x in (a, b))
    both = F.size(F.array_union(wa, wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(F.size(F.array_intersect(wa, wb)) / both)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word operation set a character (Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_sort_similarity(a: str, b: str) -> float:
    """100 times twice the common subsequence of the word-sorted names over both lengths; 0 for an empty one."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * _common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two lower-cased, trimmed names; null names count as empty."""
    return pd.Series([token_sort_similarity((x or "").lower().strip(), (y or "").lower().strip()) for x, y in zip(a, b, strict=True)])


def usernames(name: Column, phone: Column, trade: str, phrase: str) -> Column:
    """Names under which a company's profile may be found, best first: at least 5 characters, each once. X32.

    From the transliterated name without anything but letters and digits: itself, itself with `phrase` shortened to
    `trade`, with `trade` behind and in front, and with the last four characters of a phone of at least 11.
    """
    base = F.regexp_replace(transliterated(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    short = F.substring(base, 1, 20)
    found = F.array(
        F.substring(base, 1, 30), F.substring(F.replace(base, F.lit(phrase), F.lit(trade)), 1, 30), F.concat(short, F.lit(f"_{trade}")), F.concat(F.lit(f"{trade}_"), short),
        F.when(F.length(phone) >= 11, F.concat(F.substring(base, 1, 15), F.substring(phone, -4, 4))),
    )
    kept = F.array_distinct(F.filter(F.array_compact(found), lambda v: F.length(v) >= 5))
    return F.when(base != "", kept).otherwise(F.array().cast("array<string>"))


def profile_matches(html: Column, words: tuple[str, ...]) -> Column:
    """Whether a landed profile page has a title, and its title or description holds a word of the trade. X33."""
    part = lambda what: F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), f"tgme_page_{what}[^>]*>([^<]+)", 1))
    hit = F.lit(False)
    for w in words:
        hit = hit | part("title").contains(w) | part("description").contains(w)
    return F.coalesce(html.contains("tgme_page_title"), F.lit(False)) & hit
