"""Phone numbers. Survey: X1-X4, X8, X14."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.values import CAPITAL_CODES


@dataclass(frozen=True)
class PhoneRules:
    """country: the code of a full number; trunk: a first digit that stands for it; bare: how a number without code begins (None: never accepted); areas: rejected area codes; plus: regex in front of the code in running text."""

    country: str = "7"
    trunk: str | None = "8"
    bare: str | None = "9"
    areas: tuple[str, ...] = ("000", "800")
    plus: str = r"\+?"


DEFAULT = PhoneRules()
#: For numbers of the driver's texts: code 1, always with a plus sign there.
NORTH_AMERICA = PhoneRules(country="1", trunk=None, bare=None, areas=("000",), plus=r"\+")
_BETWEEN = r"[ \t\n\x0B\f\r()-]*"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def distinct_digits(d: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(d, ""), lambda x: x != "")))


def normalize_phone(phone: Column, r: PhoneRules = DEFAULT) -> Column:
    """Eleven digits from the country code on, or null."""
    d = digits(phone)
    if r.trunk is not None:
        d = F.when(d.startswith(r.trunk) & (F.length(d) == 11), F.concat(F.lit(r.country), F.substring(d, 2, 10))).otherwise(d)
    if r.bare is not None:
        d = F.when((F.length(d) == 10) & d.startswith(r.bare), F.concat(F.lit(r.country), d)).otherwise(d)
    ok = (F.length(d) == 11) & d.startswith(r.country) & ~F.substring(d, 2, 3).isin(*r.areas) & (distinct_digits(d) > 2)
    return F.when(ok, d)


def normalize_phones(phones: Column, r: PhoneRules = DEFAULT) -> Column:
    """The valid ones of an array, normalised, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(phones, F.array().cast("array<string>")), lambda p: normalize_phone(p, r)), lambda p: p.isNotNull()))


def extract_phones(text: Column, r: PhoneRules = DEFAULT) -> Column:
    """Normalised numbers of a text in order of first occurrence."""
    pattern = f"({r.plus}{r.country}{_BETWEEN}[0-9]{{3}}{_BETWEEN}[0-9]{{3}}{_BETWEEN}[0-9]{{2}}{_BETWEEN}[0-9]{{2}})"
    return normalize_phones(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), r)


def phone_problem(phone: Column, r: PhoneRules = DEFAULT) -> Column:
    """Why a stored number is no good, or 'ok'."""
    d = digits(phone)
    return (
        F.when(phone.isNull() | (phone == ""), "empty")
        .when(F.length(d) != 11, F.concat(F.lit("wrong_length:"), F.length(d)))
        .when(~d.startswith(r.country), "wrong_prefix")
        .when(F.substring(d, 2, 3) == "000", "invalid_def:000")
        .when(F.substring(d, 2, 3) == "800", "suspicious_def:800")
        .when(distinct_digits(d) <= 2, "all_same_digits")
        .otherwise("ok")
    )


def is_non_local_phone(phone: Column, city: Column) -> Column:
    """Whether a number carries a capital's code in a city that is not that capital."""
    code, town = F.substring(phone, 2, 3), F.lower(F.coalesce(city, F.lit("")))
    known = F.coalesce((F.length(phone) == 11) & phone.startswith("7"), F.lit(False))
    foreign = F.lit(False)
    for codes in dict.fromkeys(CAPITAL_CODES.values()):
        home = F.lit(False)
        for start, own in CAPITAL_CODES.items():
            home = home | (town.startswith(start) if own == codes else F.lit(False))
        foreign = foreign | (code.isin(*codes) & ~home)
    return known & foreign
