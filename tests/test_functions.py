"""Scalar functions, as tables of inputs and results."""

import pytest
from pyspark.sql import functions as F

from leadflow.functions import cities, emails, html, names, phones, templates, urls


def _map(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_phone(spark):
    given = ["+79031234567", "89031234567", "9031234567", "8 (903) 123 45 67", "", "abc", "123", "1234567890", "80001234567", "88001234567", "77777777777", None]
    assert _map(spark, phones.normalize_phone, given) == ["79031234567"] * 4 + [None] * 8


def test_phone_lists_and_text(spark):
    got = _map(spark, phones.normalize_phones, [["89031234567", "bad", "+7 903 123-45-67", "84951112233"], None, []], "array<string>")
    assert got == [["79031234567", "74951112233"], [], []]
    text = "call +7(903)123-45-67 or 7 903 123 45 67, not 8 903 1"
    assert _map(spark, phones.extract_phones, [text, None]) == [["79031234567"], []]
    us = lambda c: phones.extract_phones(c, phones.NORTH_AMERICA)
    assert _map(spark, us, ["at +1 (523) 555-1055 or 4111111111111111"]) == [["15235551055"]]


def test_phone_problems_and_places(spark):
    given = [None, "", "123", "89031234567", "70001234567", "78001234567", "77777777777", "79031234567"]
    assert _map(spark, phones.phone_problem, given) == ["empty", "empty", "wrong_length:3", "wrong_prefix", "invalid_def:000", "suspicious_def:800", "all_same_digits", "ok"]
    df = spark.createDataFrame([("74951234567", "Омск"), ("74951234567", "Москва"), ("78121234567", "Санкт-Петербург"), ("78121234567", "Москва"), ("78001234567", "Омск"), ("79031234567", "Омск"), ("123", "Омск"), (None, None)], "p string, c string")
    assert [r[0] for r in df.select(phones.is_non_local_phone(F.col("p"), F.col("c"))).collect()] == [True, False, False, True, False, False, False, False]


def test_emails(spark):
    text = "a@b.com, Photo@X.com x@2x.png y@z.jpg test@q.ru ..d@e.ru A@b.com info@site.ru."
    assert _map(spark, emails.extract_emails, [text, None, ""]) == [["a@b.com", "test@q.ru", "a@b.com", "info@site.ru"], [], []]
    assert _map(spark, emails.validate_emails, [[" a@b.com", "bad", "a@b.com"]], "array<string>") == [["a@b.com"]]
    given = [None, "x", "@b.ru", "a@b", "ab@b.ru", "abc@b.png", "photo@b.ru", "abc..d@b.ru", ".abc@b.ru", "abc@2x.ru", "good@b.ru"]
    want = ["empty", "no_at", "empty_part", "no_dot_in_domain", "too_short_local", "fake_tld:.png", "fake_local:photo", "double_dot", "leading/trailing_dot", "img_pattern", "ok"]
    assert _map(spark, emails.email_problem, given) == want
    assert _map(spark, emails.masked, ["john@x.ru", "x"]) == ["j***@x.ru", "***"]
    df = spark.createDataFrame([(["a@mail.ru", "b@other.ru", "c@my.site.ru"], "site.ru"), (["a@mail.ru", "b@other.ru"], None)], "e array<string>, s string")
    assert [r[0] for r in df.select(emails.by_priority(F.col("e"), F.col("s"))).collect()] == [["c@my.site.ru", "b@other.ru", "a@mail.ru"], ["a@mail.ru", "b@other.ru"]]


def test_urls(spark):
    assert _map(spark, urls.extract_domain, ["https://www.A.ru:80/x", "site.ru/p", "http://u@h.ru", "", None]) == ["a.ru:80", "site.ru", "u@h.ru", None, None]
    assert _map(spark, urls.base_domain, ["https://a.b.site.ru/", "site.ru", "https://vk.com/x", "https://localhost/"]) == ["site.ru", None, None, None]
    assert _map(spark, urls.website_root, [" https://Site.ru/a?b", "site.ru", "https://vk.com/x", "nodot", ""]) == ["https://site.ru/", "https://site.ru/", None, None, None]
    safe = ["https://a.ru/", "ftp://a.ru", "http://127.0.0.1/", "http://10.1.2.3", "http://172.20.0.1", "http://172.32.0.1", "http://localhost", "http://169.254.1.1", "http://8.8.8.8/", None]
    assert _map(spark, urls.is_safe_url, safe) == [True, False, False, False, False, True, False, False, True, False]
    tg = lambda c: urls.normalize_messenger(c, "telegram")
    assert _map(spark, tg, ["https://t.me/https://t.me/user", "@user", "tg://resolve?domain=u", "", "https://t.me/"]) == ["https://t.me/user", "https://t.me/user", "https://t.me/u", "", ""]
    wa = lambda c: urls.normalize_messenger(c, "whatsapp")
    assert _map(spark, wa, ["https://wa.me/89031234567", "https://wa.me/x"]) == ["https://api.whatsapp.com/send?phone=79031234567", ""]
    assert _map(spark, urls.classify_messenger, ["https://T.me/x", "https://vk.com/a", "https://wa.me/1", "https://youtu.be/1", "https://a.ru"]) == ["telegram", "vk", "whatsapp", None, None]
    assert _map(spark, urls.host_suffixes, ["a.b.ru"]) == [["ru", "b.ru", "a.b.ru"]]
    assert _map(spark, lambda c: urls.has_suffix(c, ("b.ru",)), ["a.b.ru", "b.ru", "ab.ru", None]) == [True, True, False, False]
    assert _map(spark, urls.for_logs, ["https://a.ru/x?phone=1#f", None]) == ["https://a.ru/x", "<no url>"]


def test_names(spark):
    given = ["КУПИТЬ окна", "Гранит", "", None, "x" * 30, "ab", "Мастерская Иванова", "памятникиназаказнедорого", "http://very-long-address.example"]
    assert _map(spark, names.is_seo_title, given) == [True, False, True, True, True, True, False, True, True]
    assert _map(spark, names.is_aggregator_name, [" Zoon ", "Ромашка", None]) == [True, False, False]
    assert _map(spark, names.block_key, ["ООО Ритуал", "ип Иванов", "1С", " ", "ООО "]) == ["р", "и", "#", None, "о"]
    assert _map(spark, names.extract_street, ["г. Омск, ул. Ленина, 45", "проспект Маркса 12", "Дом", "a, b", None]) == ["ленина", "маркса", "дом", "a", ""]
    assert _map(spark, names.slugify, ["Санкт-Петербург", "Йошкар Ола!", None]) == ["sankt-peterburg", "yoshkar-ola", ""]
    assert _map(spark, names.safe_filename, ["Омск / Центр", ""]) == ["omsk_tsentr", "unnamed"]
    assert _map(spark, names.pick_longest, [[" ab ", "cd", None], []], "array<string>") == ["ab", ""]
    df = spark.createDataFrame([("a b c", "b c d"), ("", "a"), ("x y", "y x")], "a string, b string")
    assert [r[0] for r in df.select(names.word_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]


def test_similarity_against_a_plain_table(spark):
    def plain(a, b):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 200.0 * t[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(12))) for _ in range(2))
        assert names.token_sort_similarity(a, b) == pytest.approx(plain(a, b))


PAGE = """<html><head><title> Acme | Doors </title><meta name="generator" content="Joomla! 3"><script>var t="</p>x@y.ru"</script></head>
<body><h1>Acme <b>doors</b></h1><a href="/about">About</a><a href="/contact.html">c</a><a href="https://t.me/share?x">s</a><a href="https://t.me/acme/">t</a>
<a href="mailto:Boss@acme.ru?x=1">m</a><a href="tel:+79031234567">p</a><p>info@acme.ru &amp; 8<img src="a@2x.png"><!-- no@acme.ru --></p><a href="https://wa.me/">w</a></body></html>"""


def test_pages(spark):
    one = lambda f: _map(spark, f, [PAGE])[0]
    base = F.lit("https://acme.ru/x")
    assert one(html.title) == "Acme | Doors" and one(html.heading) == "Acme doors" and one(html.page_name) == "Acme"
    assert one(html.links) == ["/about", "/contact.html", "https://t.me/share?x", "https://t.me/acme/", "https://wa.me/"]
    assert one(lambda c: html.useful_links(c, base)) == ["https://acme.ru/about"]
    assert one(lambda c: html.contact_link(c, base)) == "https://acme.ru/contact.html"
    assert one(lambda c: html.social_link(c, "telegram")) == "https://t.me/acme"
    assert one(html.page_emails) == ["Boss@acme.ru", "boss@acme.ru", "info@acme.ru"]
    assert one(html.page_phones) == ["+79031234567"]
    assert one(html.detect_cms) == "joomla"
    assert _map(spark, html.detect_cms, ["<x wp-content>", "", None]) == ["wordpress", "unknown", "unknown"]
    assert html.plain_text("<p>a &amp; b</p><script>x</script><style>y</style> <b>c</b>") == "a & b\nc" and html.plain_text(None) == ""
    assert _map(spark, lambda c: html.tech_signals(c, {"own": ("Own Works",), "gear": ("cnc",)}), ["we OWN works", "x"]) == [["own"], []]
    assert _map(spark, html.linkified, ["<a>\nhttps://x.ru"]) == ['&lt;a&gt;<br><a href="https://x.ru">https://x.ru</a>']


def test_cities(spark):
    places = spark.createDataFrame([(0, "Хакасия", "Абакан"), (1, "Пермский край", "Пермь"), (2, "A", "Кировск"), (3, "B", "Кировск"), (4, "C", "Орск")], "pos int, region string, name string")
    g = cities.gazetteer(places)
    assert {(r.name, r.region, r.is_doppelganger) for r in g.collect()} >= {("Кировск", "A", True), ("Абакан", "Хакасия", False)}
    roots = cities.city_roots(g)
    texts = ["Мастерская в Абакане", "ул. Мира, 7, Абакан", "абаканский район", "Памятники Кировск", "офис в Перми", None, "Абакан, но из Перми"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert {r.id: r.city for r in cities.detect_cities(df, "id", "t", roots).collect()} == {0: "Абакан", 1: "Абакан", 4: "Пермь", 6: "Пермь"}
    assert cities.expand(g, "Хакасия").collect()[0][0] == "Абакан" and cities.expand(g, "Nowhere").collect()[0][0] == "Nowhere" and cities.expand(g, "all").count() == 4
    pairs = spark.createDataFrame([("Омск", "омск"), ("Новосибирск", "Новосиб"), ("Москва", "Москве"), ("Омск", "Томск"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(cities.is_local(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_templates(spark):
    df = spark.createDataFrame([("Hi {name}, {x}", "<A>", None)], "t string, n string, x string")
    r = df.select(templates.render(F.col("t"), {"name": F.col("n"), "x": F.col("x")}, html=True).alias("h"), templates.render(F.col("t"), {"name": F.col("n")}).alias("p")).first()
    assert (r.h, r.p) == ("Hi &lt;A&gt;, ", "Hi <A>, {x}")
    assert _map(spark, templates.header_email, ["Ann <Ann@X.ru>", "nobody"]) == ["ann@x.ru", None]
    assert _map(spark, templates.dsn_code, ["Status: 5.1.1 (x)", "ok"]) == ["5.1.1", None]
    assert _map(spark, templates.final_recipient, ["a\nFinal-Recipient: rfc822; <Bob@X.ru>\n"]) == ["bob@x.ru"]
    assert _map(spark, templates.retry_count, ["x [retry:2]", None]) == [2, 0]
    assert _map(spark, lambda c: templates.with_retry(c, F.lit(3)), ["x [retry:2]", None]) == ["x [retry:3]", "[retry:3]"]
    assert _map(spark, templates.error_kind, ["Read timeout", "captcha page", "other", None]) == ["network", "parsing", "data", "data"]
    assert _map(spark, templates.capitalised_city, ["ростов-на-дону"]) == ["Ростов-На-Дону"]
    t = spark.createDataFrame([("a", "s", "b"), ("a", "s", "b"), (None, "s", "b")], "name string, subject string, body string")
    assert {(r.name, r.problem) for r in templates.template_problems(t, ("a", "z")).collect()} == {(None, "no_name"), ("a", "repeated"), ("z", "missing")}
