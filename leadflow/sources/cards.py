"""Cards of companies cut out of landed directory pages. Survey: SRC8, SRC9.

A page is read once, tag by tag, into a list of elements in document order; what an element contains is then a stretch
of that list and a stretch of the page's text, so cards and their fields are found by scanning stretches, without a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.emails import extract_emails
from leadflow.functions.phones import DEFAULT, PhoneRules, extract_phones, normalize_phones

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
#: Text of these does not run into what stands beside them.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Start tags that end an open element of these kinds, as browsers do.
_ENDS = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}


@dataclass(frozen=True)
class Pick:
    """Elements with this tag (None: any) whose attribute holds a text ("": has the attribute), inside an element of another tag."""

    tag: str | None = None
    attr: str | None = None
    part: str = ""
    inside: str | None = None
    without: str | None = None


@dataclass(frozen=True)
class CardRules:
    """What makes a card and its fields: alternatives in any order, the first element in the page wins.

    Without picks for phones, they are looked for in a card's text.
    container: parts of class names; a card's phones, mails and links are then read from the nearest element around it
    with such a class, or its parent, as on pages whose card is a bare link.
    entities: the only references that stand for a character, closed by a semicolon, on pages whose writer escapes no
    others and may cut one off; None: all of HTML, closed or not.
    """

    card: tuple[Pick, ...]
    name: tuple[Pick, ...] = ()
    address: tuple[Pick, ...] = (Pick("address"), Pick(attr="class", part="address"))
    phone: tuple[Pick, ...] = (Pick("a", "href", "tel:"), Pick(attr="class", part="phone"))
    site: tuple[Pick, ...] = (Pick("a", "class", "website"),)
    category: tuple[Pick, ...] = (Pick(attr="class", part="category"), Pick(attr="class", part="rubric"))
    container: tuple[str, ...] = ()
    entities: tuple[str, ...] | None = None


class Page(HTMLParser):
    """The elements of a page in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.last: list[int] = []  # the last element inside
        self.begin: list[int] = []  # of its text
        self.end: list[int] = []
        self.parts: list[str] = []
        self.size = 0
        self.open: list[int] = []
        self.feed(html)
        self.close()
        while self.open:
            self._shut()
        self.text = "".join(self.parts)

    def _shut(self) -> None:
        i = self.open.pop()
        self.last[i], self.end[i] = len(self.tags) - 1, self.size
        if self.tags[i] in _BLOCKS:
            self._write("\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and tag in _ENDS.get(self.tags[self.open[-1]], ()):
            self._shut()
        if tag in _BLOCKS:
            self._write("\n")
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(i)
        self.begin.append(self.size)
        self.end.append(self.size)
        if tag not in _VOID:
            self.open.append(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        if any(self.tags[i] == tag for i in self.open):
            while self.tags[self.open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data: str) -> None:
        if not any(self.tags[i] in _SILENT for i in self.open):
            self._write(data)

    def _write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    def words(self, i: int) -> str:
        return self.text[self.begin[i] : self.end[i]].strip()

    def above(self, i: int) -> Iterator[int]:
        while (i := self.parent[i]) >= 0:
            yield i

    def fits(self, i: int, picks: tuple[Pick, ...]) -> bool:
        for p in picks:
            if p.tag not in (None, self.tags[i]) or p.attr is not None and p.part not in self.attrs[i].get(p.attr, "\0"):
                continue
            if p.without is not None and p.without in self.attrs[i].get(p.attr or "", ""):
                continue
            if p.inside is None or any(self.tags[j] == p.inside for j in self.above(i)):
                return True
        return False

    def within(self, i: int, picks: tuple[Pick, ...]) -> list[int]:
        return [j for j in range(i + 1, self.last[i] + 1) if self.fits(j, picks)]


def page_cards(html: str, rules: CardRules) -> list[dict]:
    """Cards of a page in document order: name, source_url, address, phone_texts, website, category, text and links."""
    if rules.entities is not None:
        html = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, rules.entities))});)", "&amp;", html)
    page, out = Page(html), []
    for i in range(len(page.tags)):
        if not page.fits(i, rules.card):
            continue
        named = [i] if not rules.name else page.within(i, rules.name)[:1]
        name = page.words(named[0]) if named else ""
        if len(name) < 3:
            continue
        box = i
        if rules.container:
            box = next((j for j in page.above(i) if any(c in page.attrs[j].get("class", "") for c in rules.container)), page.parent[i] if page.parent[i] >= 0 else i)
        link = next((page.attrs[j]["href"] for j in [i, *page.above(i), named[0]] if page.tags[j] == "a" and page.attrs[j].get("href")), None)
        first = lambda picks: next((page.words(j) for j in page.within(box, picks)), "")  # noqa: B023, E731
        links = [page.attrs[j]["href"] for j in range(box, page.last[box] + 1) if page.tags[j] == "a" and page.attrs[j].get("href")]
        out.append({
            "name": name, "source_url": link, "address": first(rules.address), "phone_texts": [page.words(j) for j in page.within(box, rules.phone)],
            "website": next((page.attrs[j].get("href") for j in page.within(box, rules.site) if page.attrs[j].get("href")), None), "category": first(rules.category), "text": page.words(box), "links": links,
        })
    return out


#: What a messenger's link holds.
_MESSENGERS = (("vk", "vk.com", None), ("telegram", "t.me", "share"), ("whatsapp", "wa.me", None), ("instagram", "instagram.com", None))


def messengers_of(links: Column) -> Column:
    """The first link of each messenger, by its name."""

    def first(part: str, without: str | None) -> Column:
        return F.get(F.filter(links, lambda u: u.contains(part) & (~u.contains(without) if without else F.lit(True))), F.lit(0))

    found = [(k, first(part, without)) for k, part, without in _MESSENGERS]
    return F.map_from_entries(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in found))))


def landed_cards(pages: DataFrame, key: str, html: str, rules: CardRules, phones: PhoneRules = DEFAULT) -> DataFrame:
    """(key, ordinal, name, source_url, address, phones, website, emails, messengers, category) of the cards of landed pages. SRC8, SRC9.

    Pages without cards, empty and null ones give no rows; cards without a name of three characters are none. Names may
    repeat: operators.base.one_per_name keeps one card a name.
    """
    kind = pages.schema[key].dataType.simpleString()
    fields = (("name", pa.string()), ("source_url", pa.string()), ("address", pa.string()), ("phone_texts", pa.list_(pa.string())), ("website", pa.string()), ("category", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):  # cards repeat much of a page's text
                b = whole.slice(at, 100)
                found = [(i, n, c) for i, h in enumerate(b.column(1).to_pylist()) if h for n, c in enumerate(page_cards(h, rules))]
                keys, order = b.column(0).take(pa.array([i for i, _, _ in found], pa.int32())), pa.array([n for _, n, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays([keys, order, *(pa.array([c[f] for _, _, c in found], t) for f, t in fields)], ["key", "ordinal", *(f for f, _ in fields)])

    schema = f"key {kind}, ordinal int, name string, source_url string, address string, phone_texts array<string>, website string, category string, text string, links array<string>"
    cards = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, schema)
    numbers = normalize_phones(F.col("phone_texts") if rules.phone else extract_phones(F.col("text"), phones), phones)
    return cards.select(F.col("key").alias(key), "ordinal", "name", "source_url", "address", numbers.alias("phones"), "website", extract_emails(F.col("text")).alias("emails"), messengers_of(F.col("links")).alias("messengers"), "category")


#: SRC8: a card is a link to a company, its contacts lie in the box around it.
LINK_CARDS = CardRules(card=(Pick("a", "href", "/firm/"),), container=("searchCard", "card", "list__item"), phone=())
#: SRC9: a card is a box with the name in a heading or a named link.
BOX_CARDS = CardRules(
    card=(Pick(attr="class", part="company-card"), Pick(attr="class", part="listing-item"), Pick(attr="class", part="search-card"), Pick(attr="class", part="org-card"), Pick("a", "href", "/company/")),
    name=(Pick("a", inside="h3"), Pick("a", inside="h2"), Pick("a", "class", "name"), Pick("a", "class", "title"), Pick("span", "class", "name"), Pick("a", "class", "company")),
    category=(Pick(attr="class", part="category"), Pick(attr="class", part="rubric"), Pick("span", "class", "tag")),
)
