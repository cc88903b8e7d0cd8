"""URLs, hosts and messenger links. Survey: X9-X11, X15, X16, F15, F19, F20, X45."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.values import MESSENGER_DOMAINS, NON_NETWORK_DOMAINS, PRIVATE_HOSTS, PRIVATE_RANGES


def _netloc(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extract_domain(url: Column) -> Column:
    """Lower-cased authority (port and user kept) without a leading www., or null; a missing scheme is fine."""
    d = F.regexp_replace(_netloc(url), r"^www\.", "")
    return F.when(d != "", d)


def hostname(url: Column) -> Column:
    """Lower-cased host of a URL with scheme, without user and port, or null."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^.*@", ""), ":[0-9]*$", "")
    return F.when(h != "", h)


def base_domain(url: Column, excluded: tuple[str, ...] = NON_NETWORK_DOMAINS) -> Column:
    """Last two labels of the host; null without scheme, without dot, or for excluded platforms."""
    h = hostname(url)
    base = F.substring_index(h, ".", -2)
    return F.when(h.contains(".") & ~base.isin(*excluded), base)


def website_root(url: Column) -> Column:
    """scheme://authority/ of a company's own site; null for messengers and names without a dot."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    n = _netloc(u)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when((u != "") & n.contains(".") & ~F.substring_index(n, ":", 1).isin(*MESSENGER_DOMAINS), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), n, F.lit("/")))


def has_suffix(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether host is one of domains or below it."""
    own = F.lit(False)
    for d in domains:
        own = own | (host == d) | host.endswith(f".{d}")
    return F.coalesce(own, F.lit(False))


def host_suffixes(host: Column) -> Column:
    """host and every domain above it, as an array: the key for joins with large domain lists."""
    n = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(F.split(host, r"\."), -k, k), "."))


_PREFIXES = {
    "telegram": r"https?://t\.me/|https?://telegram\.me/|tg://resolve\?domain=",
    "whatsapp": r"https?://wa\.me/|https?://api\.whatsapp\.com/send\?phone=|https?://api\.whatsapp\.com/send/\?phone=",
}
_TARGET = {"telegram": "https://t.me/", "whatsapp": "https://api.whatsapp.com/send?phone="}


def normalize_messenger(url: Column, kind: str) -> Column:
    """One clean link: repeated prefixes and stray separators go; WhatsApp keeps digits only, 8 becomes 7."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    if kind not in _PREFIXES:
        return F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, f"(?i)^(?:{_PREFIXES[kind]}|[/@ ])+", "")
    if kind == "whatsapp":
        d = F.regexp_replace(rest, "[^0-9]", "")
        rest = F.when(d.startswith("8") & (F.length(d) == 11), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return F.when(rest == "", "").otherwise(F.concat(F.lit(_TARGET[kind]), rest))


def classify_messenger(url: Column) -> Column:
    """Kind of a messenger or social link, null for none; the first rule that holds."""
    u = F.lower(url)
    has = lambda *marks: F.greatest(*(u.contains(m) for m in marks)) if len(marks) > 1 else u.contains(marks[0])
    return (
        F.when(has("t.me"), "telegram").when(has("vk.com", "vkontakte"), "vk").when(has("viber"), "viber")
        .when(has("wa.me", "whatsapp"), "whatsapp").when(has("ok.ru"), "odnoklassniki")
        .when(has("youtube", "youtu.be"), F.lit(None)).when(has("instagram"), "instagram")
    )


def is_safe_url(url: Column) -> Column:
    """Whether a URL may be fetched: http(s), a public host. Addresses are tested by range, names by list."""
    h = hostname(url)
    part = lambda i: F.split_part(h, F.lit("."), F.lit(i)).try_cast("long")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    inside = F.lit(False)
    for first, bits in PRIVATE_RANGES:
        a, b, c, d = map(int, first.split("."))
        low = a * 16777216 + b * 65536 + c * 256 + d
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    numeric = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    named = h.isin(*PRIVATE_HOSTS) | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal") | h.startswith("[")
    # names and shortened numbers that begin like a private address
    begins = h.rlike(r"^(127|10|192\.168|169\.254|0)\.") | h.rlike(r"^172\.0*(1[6-9]|2[0-9]|3[01])(\.|$)") | h.rlike(r"^100\.0*(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])(\.|$)")
    ok = url.rlike("(?i)^https?://") & h.isNotNull() & ~named & ~begins & ~(numeric & F.coalesce(inside, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def is_safe_link(url: Column) -> Column:
    """Whether a link may be shown: http(s) with a host."""
    return F.coalesce(url.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def for_logs(url: Column, most: int = 80) -> Column:
    """A URL without query and fragment, shortened."""
    bare = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    return F.when(url.isNull() | (url == ""), "<no url>").when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)
