"""Web pages as text. Survey: X20, X25-X30, X34, X35, X38."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadflow.functions.emails import extract_emails
from leadflow.functions.phones import DEFAULT, PhoneRules, extract_phones
from leadflow.functions.urls import hostname
from leadflow.functions.values import CMS_GENERATORS, CMS_MARKS, CONTACT_URLS, IMAGE_ATTRIBUTES, MESSENGER_LINKS, NOISE_ELEMENTS, SHARING, USEFUL_URLS, VOID_TAGS


#: What is no text, as one alternation: a page is read once.
_NOISE = "|".join([*(f"<{t}[^>]*>.*?</{t}>" for t in NOISE_ELEMENTS), "<!--.*?-->", rf"<(?:{'|'.join(VOID_TAGS)})\b[^>]*>", f"<[^>]+(?:{'|'.join(IMAGE_ATTRIBUTES)})[^>]*>"])


def without_noise(html: Column) -> Column:
    """html without elements that hold no text, comments, void tags, and tags with image addresses."""
    return F.regexp_replace(html, f"(?is){_NOISE}", "")


def attributes(html: Column, name: str) -> Column:
    """All quoted values of an attribute, in order."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)\b{name}\s*=\s*(["'])(.*?)\1"""), F.lit(2))


def addressed(html: Column, scheme: str) -> Column:
    """What links with a scheme like mailto point at, without the parameters that may follow."""
    own = F.filter(attributes(html, "href"), lambda h: F.lower(h).startswith(f"{scheme}:"))
    return F.filter(F.transform(own, lambda h: F.substring_index(F.substr(h, F.lit(len(scheme) + 2)), "?", 1)), lambda t: (t != "") & ~t.rlike(r"\s"))


def tags_to_spaces(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def title(html: Column) -> Column:
    """Trimmed content of the first title tag, null without one."""
    t = F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def heading(html: Column) -> Column:
    """Text of the first h1, tags removed, null without one."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def links(html: Column) -> Column:
    """Distinct targets of anchors in order, without fragments, scripts, tel: and mailto:."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: ~h.rlike("^(#|javascript:|tel:|mailto:)")))


def resolve(base: Column, href: Column) -> Column:
    """href as a full URL on the page's host: full, protocol-relative, rooted or relative to the root."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def useful_links(html: Column, base: Column, marks: tuple[str, ...] = USEFUL_URLS, most: int = 3) -> Column:
    """The first links of the page's own host whose address holds one of marks."""
    full = F.filter(links(html), lambda h: F.lower(h).rlike("|".join(m.replace(".", r"\.") for m in marks)))
    return F.slice(F.filter(F.transform(full, lambda h: resolve(base, h)), lambda u: hostname(u) == hostname(base)), 1, most)


def contact_link(html: Column, base: Column) -> Column:
    """First link to a contact page, null without one."""
    found = F.filter(links(html), lambda h: F.lower(h).rlike("|".join(CONTACT_URLS)))
    return F.when(F.size(found) > 0, resolve(base, F.get(found, F.lit(0))))


def social_link(html: Column, kind: str) -> Column:
    """First link to a messenger, null without one; Telegram's sharing links do not count."""
    hosts, begins = MESSENGER_LINKS[kind]
    after = lambda u: F.regexp_extract(u, "(?i)^https?://[^/?#]*(.*)$", 1)
    own = F.filter(attributes(html, "href"), lambda u: u.rlike(r"(?i)^https?://\S+$") & hostname(u).isin(*hosts) & after(u).startswith(begins) & (F.length(after(u)) > len(begins)))
    if kind == "telegram":
        own = F.transform(F.filter(own, lambda u: ~F.lower(u).rlike("|".join(SHARING))), lambda u: F.regexp_replace(u, "/+$", ""))
    return F.get(own, F.lit(0))


def page_emails(html: Column) -> Column:
    """Addresses of mailto: links as written, then of the text, first occurrences in order."""
    return F.array_distinct(F.concat(addressed(html, "mailto"), extract_emails(without_noise(html))))


def page_phones(html: Column, r: PhoneRules = DEFAULT) -> Column:
    """Numbers of tel: links as written, then of the text, first occurrences in order."""
    return F.array_distinct(F.concat(addressed(html, "tel"), extract_phones(tags_to_spaces(without_noise(html)), r)))


def generator(html: Column) -> Column:
    a = F.regexp_extract(html, r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""", 1)
    b = F.regexp_extract(html, r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']generator["']""", 1)
    return F.lower(F.when(a != "", a).otherwise(b))


def detect_cms(html: Column) -> Column:
    """System a page runs on: by marks in the page, then by its generator tag, else 'unknown'."""
    low, said = F.lower(html), generator(html)
    out = F.lit("unknown")
    for mark, name in reversed(CMS_GENERATORS):
        out = F.when(said.contains(mark), name).otherwise(out)
    for name, marks in reversed(CMS_MARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = F.when(hit, name).otherwise(out)
    return F.when(html.isNull(), "unknown").otherwise(out)


def tech_signals(text: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """Categories with a keyword in the text, as an array in the order given."""
    low, found = F.lower(text), []
    for name, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def page_name(html: Column) -> Column:
    """Company name of a page: structured data, site name, title up to a separator, first heading."""
    site = F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)["']""", 1)
    data = F.get_json_object(F.regexp_extract(html, r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>""", 1), "$.name")
    head = F.regexp_replace(F.regexp_extract(title(html), r"^(.*?)(?:\s+[|–—-]\s+.*)?$", 1), r"^\s+|\s+$", "")
    short = lambda c: F.when((F.length(c) >= 2) & (F.length(c) <= 100), c)
    return F.coalesce(short(data), short(site), short(head), short(heading(html)))


def linkified(text: Column) -> Column:
    """Plain text as HTML: escaped, addresses as links, lines as breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"(https?://[^\s<]+)", '<a href="$1">$1</a>')
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.skipped -= tag in ("script", "style") and self.skipped > 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    """Text of a page, a line for each piece between tags, blank lines and outer spaces removed."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (line.strip() for line in "\n".join(parser.parts).splitlines())
    return "\n".join(line for line in lines if line)


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Entities and broken markup need a parser; every other page function stays a column expression."""
    return html.map(plain_text)
