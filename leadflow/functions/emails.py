"""E-mail addresses. Survey: X5-X8, S4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.values import FAKE_EMAIL_LOCALS, FAKE_EMAIL_TLDS, FREE_EMAIL_DOMAINS, IMAGE_FILES, IMAGE_FILES_STORED

IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def local_part(e: Column) -> Column:
    """What stands before the last "@"."""
    return F.regexp_extract(e, "(?s)^(.*)@", 1)


def domain_part(e: Column) -> Column:
    """What stands after the last "@"."""
    return F.substring_index(e, "@", -1)


def _tld(e: Column) -> Column:
    return F.substring_index(domain_part(e), ".", -1)


def faults(e: Column, images: str = IMAGE_FILES, shortest: int = 0) -> dict[str, Column]:
    """What may be wrong with a lower-cased address, by name: conditions that hold where it is. Survey: X5, X8.

    images: names of image files; shortest: least letters of a placeholder that counts as one.
    """
    local = local_part(e)
    base = F.substring_index(local, "+", 1)
    return {
        "no_dot_in_domain": ~domain_part(e).contains("."),
        "fake_tld": _tld(e).isin(*FAKE_EMAIL_TLDS),
        "fake_local": base.isin(*FAKE_EMAIL_LOCALS) & (F.length(base) >= shortest),
        "double_dot": e.contains(".."),
        "leading/trailing_dot": local.rlike(r"^\.|\.$"),
        "img_pattern": e.rlike(images),
    }


def is_plausible(e: Column) -> Column:
    """Whether a lower-cased address found in text has no fault; placeholders of up to four letters may be real."""
    return F.greatest(*faults(e, shortest=5).values()) == F.lit(False)


def extract_emails(text: Column) -> Column:
    """Plausible addresses of a text, lower-cased; one for each spelling found, in order of first occurrence."""
    raw = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IN_TEXT})"), F.lit(1)))
    return F.filter(F.transform(raw, F.lower), is_plausible)


def validate_emails(emails: Column) -> Column:
    """Well-formed ASCII addresses of an array, trimmed, first occurrences in order."""
    bare = F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.regexp_replace(e, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(bare, lambda e: e.rlike(f"^{IN_TEXT}$")))


def email_problem(email: Column, least_local: int = 3) -> Column:
    """Why a stored address is no good, or 'ok'; the first reason that holds."""
    e = F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))
    wrong = faults(e, IMAGE_FILES_STORED)
    detail = {"fake_tld": F.concat(F.lit("fake_tld:."), _tld(e)), "fake_local": F.concat(F.lit("fake_local:"), F.substring_index(local_part(e), "+", 1))}
    first = {
        "empty": email.isNull() | (email == ""), "no_at": ~e.contains("@"), "empty_part": (local_part(e) == "") | (domain_part(e) == ""),
        "no_dot_in_domain": wrong.pop("no_dot_in_domain"), "too_short_local": F.length(local_part(e)) < least_local,
    }
    return F.coalesce(*(F.when(holds, detail.get(name, F.lit(name))) for name, holds in (first | wrong).items()), F.lit("ok"))


def recipient_format(email: Column) -> Column:
    """Whether mail can be addressed to it; word characters of any script count here, ASCII is tested apart."""
    return F.coalesce(email.rlike(r"(?U)^[\w.+-]+@[\w.-]+\.\w{2,}$"), F.lit(False))


def is_ascii(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{ASCII}*$"), F.lit(True))


def by_priority(emails: Column, site: Column) -> Column:
    """Addresses on the site's own domain, then others, then free providers; in order within each. No site: as given."""

    def rank(e: Column) -> Column:
        d = F.lower(domain_part(e))
        return F.when((d == site) | d.endswith(F.concat(F.lit("."), site)), 0).when(d.isin(*FREE_EMAIL_DOMAINS), 2).otherwise(1)

    ranked = F.array_sort(F.transform(emails, lambda e, i: F.struct(rank(e).alias("r"), i.alias("i"), e.alias("e"))))
    return F.when(site.isNull(), emails).otherwise(F.transform(ranked, lambda x: x["e"]))


def masked(email: Column) -> Column:
    """First character of the local part, stars, and the domain."""
    return F.when(email.contains("@"), F.concat(F.substring(local_part(email), 1, 1), F.lit("***@"), domain_part(email))).otherwise("***")
