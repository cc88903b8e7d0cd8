"""Cards of landed pages, against a plain tree of the page."""

import xml.etree.ElementTree as ET

from leadflow.operators.base import one_per_name
from leadflow.sources import cards

BOX = """<html><body><div class="listing-item x"><h3><a href="/company/1">Alpha &amp; Co</a></h3>
<span class="address">Main st. 5</span><a href="tel:1">+7 (903) 123-45-67</a><span class="phone-2">8 903 765 43 21</span>
<a class="website" href="https://alpha.ru">site</a> info@alpha.ru <a href="https://t.me/alpha">t</a><a href="https://t.me/share/x">s</a><a href="https://vk.com/a">v</a><span class="tag">Stone</span></div>
<div class="org-card"><h2><a href="/c/2">Be</a></h2></div>
<div class="search-card"><p>first<p>second<br>line<ul><li>one<li>two</ul><a class="title" href="/c/3">Gamma</a></div>
<script>var x = "<div class='org-card'><h2><a>Not one</a></h2></div>";</script>
<div class="org-card"><span class="name">ALPHA &amp; co</span></div></body></html>"""


def test_box_cards(spark):
    df = spark.createDataFrame([(1, BOX), (2, ""), (3, None), (4, "<p>no cards"), (5, "</div></b><a href='/company/9'>Open <b>Delta")], "page_id long, html string")
    got = cards.landed_cards(df, "page_id", "html", cards.BOX_CARDS).orderBy("page_id", "ordinal").collect()
    a = got[0]
    assert (a.name, a.source_url, a.address, a.website, a.category) == ("Alpha & Co", "/company/1", "Main st. 5", "https://alpha.ru", "Stone")
    assert a.phones == ["79031234567", "79037654321"] and a.emails == ["info@alpha.ru"]
    assert a.messengers == {"telegram": "https://t.me/alpha", "vk": "https://vk.com/a"}
    assert [r.name for r in got] == ["Alpha & Co", "Gamma", "ALPHA & co"]
    assert sorted(r.name for r in one_per_name(cards.landed_cards(df, "page_id", "html", cards.BOX_CARDS), "ordinal").collect()) == ["Alpha & Co", "Gamma"]


def test_link_cards_take_contacts_from_around(spark):
    page = '<div class="_searchCard_1"><div><a href="/firm/7">Omega</a></div><i>+7 903 123-45-67 mail@omega.ru</i><div class="address">Far street 10</div><a href="https://wa.me/79031234567">w</a></div><p><a href="/firm/8">Psi</a> +7 (903) 765-43-21</p>'
    got = cards.landed_cards(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h", cards.LINK_CARDS).orderBy("ordinal").collect()
    assert [(r.name, r.source_url, r.phones, r.emails, r.address) for r in got] == [("Omega", "/firm/7", ["79031234567"], ["mail@omega.ru"], "Far street 10"), ("Psi", "/firm/8", ["79037654321"], [], "")]
    assert got[0].messengers == {"whatsapp": "https://wa.me/79031234567"}


def test_references_cut_off_stay_text(spark):
    from dataclasses import replace

    page = "<div class='org-card'><h2><a href='/c?a=1&amp;copy=2&lt'>Stone &lt;&amp;lt; &copy; wood&amp</a></h2></div>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    rules = replace(cards.BOX_CARDS, entities=("lt", "gt", "quot", "amp"))
    [r] = cards.landed_cards(df, "page_id", "html", rules).collect()
    assert (r.name, r.source_url) == ("Stone <&lt; &copy; wood&amp", "/c?a=1&copy=2&lt")
    [r] = cards.landed_cards(df, "page_id", "html", cards.BOX_CARDS).collect()
    assert r.name == "Stone <&lt; © wood&"


def test_cut_titles_of_pages_as_in_sql(spark, tmp_path):
    from leadflow.plans.textual import landed_cards

    rows = [(1, "<article><h1>Stone ## wood&amp</h1><p>x</p></article>"), (2, "<article><h1>A &amp;&lt;b&gt; c&quo</h1></article>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.name for r in landed_cards(spark, str(tmp_path)).collect()} == {1: "Stone ## wood&amp", 2: "A &<b> c&quo"}


def _plain(html):
    """Elements with their text and what they contain, by a tree."""

    def text(e):
        inner = (e.text or "") + "".join(text(x) + (x.tail or "") for x in e)
        return f" {inner} " if e.tag in ("div", "section") else inner

    return [(e.tag, text(e).split(), len(list(e.iter())) - 1) for e in ET.fromstring(html).iter()]


def test_stretches_match_a_tree():
    import random

    rng = random.Random(1)

    def node(depth):
        tag = rng.choice(["div", "span", "b", "section"])
        inner = "".join(rng.choice([node(depth - 1) if depth else "leaf", "text ", "&amp;"]) for _ in range(rng.randrange(4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(50):
        html = f"<div>{node(4)}{node(3)}</div>"
        page = cards.Page(html)
        assert [(t, page.words(i).split(), page.last[i] - i) for i, t in enumerate(page.tags)] == _plain(html)
