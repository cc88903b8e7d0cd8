"""One search over everything, city moves and their guards, listing matches against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from leadflow.functions import cities, urls
from leadflow.functions.names import token_sort_similarity
from leadflow.operators import quality
from leadflow.operators.company_query import CompanyQuery, find, find_page

COMPANY = "id long, name string, website string, phones array<string>, emails array<string>, sources array<string>, segment string, deleted_at string"


def test_search_looks_everywhere(spark):
    rows = [
        (1, "Alpha 100%", None, ["+7 903"], ["x@a.ru"], [], "A", None), (2, "Beta", "https://alpha.ru", [], None, None, "A", None), (3, "Gamma", None, None, ["ALPHA@g.ru"], [], "A", None),
        (4, "Delta", None, [], [], [], "A", None), (5, "Eps", None, [], [], [], "A", None), (6, "Alpha gone", None, [], [], ["avito"], "A", "2024"), (7, None, None, None, None, None, None, None),
    ]
    c = spark.createDataFrame(rows, COMPANY)
    mails = spark.createDataFrame([(4, "my_alpha@k.ru"), (4, "alpha@k.ru"), (9, "alpha@k.ru"), (None, "alpha@k.ru")], "company_id long, email string")
    raw = spark.createDataFrame([(2, None, "yell"), (77, 4, "yell"), (5, None, "avito")], "id long, merged_into long, source string")
    ids = lambda **q: sorted(r.id for r in find(c, CompanyQuery(**q), mails, raw).collect())
    assert ids(search="alpha") == [1, 2, 3, 4]
    assert [ids(search="alpha", field=f) for f in ("name", "domain", "email", "phone")] == [[1], [2], [3, 4], []]
    assert ids(search="0%") == [1] and ids(search="7(903)", field="phone") == []  # a % is a letter; the number has a space in it
    assert ids(source="yell") == [2, 4]  # no live company lists sources
    own = c.withColumn("sources", F.when(F.col("id") == 3, F.array(F.lit("yell"))).otherwise(F.col("sources")))
    assert [r.id for r in find(own, CompanyQuery(source="yell"), mails, raw).collect()] == [3]
    with pytest.raises(ValueError, match="source"):
        find(c, CompanyQuery(source="nowhere"))
    p = find_page(c, CompanyQuery(search="alpha", sort="name", descending=True, page=2, per_page=2), mails, raw)
    assert [(r.id, r.total) for r in p.collect()] == [(2, 4), (1, 4)] and p.columns == [*c.columns, "total"]
    assert find_page(c, CompanyQuery(search="zzz"), mails).collect() == []


def test_moves_and_guards(spark):
    rows = [
        (1, "a", "Томск", "ул. Ленина 1, г. Омск", None), (2, "b", "Томск", "ул. 5", None), (3, "c", "Томск", "https://ул.ру/Омск", None), (4, "d", "Томск", "Омск, центр", None),
        (5, "e", "Томск", "ул. Ленина 1, Омск", "https://x.ru/томск"), (6, "f", "Томск", "ул. Ленина 1, Омск", "https://tomsk.x.ru"), (7, "g", "Томск", "ул. Мира, Томск", None),
        (8, "h", "Томск", "ул. Мира, Чужой", None), (9, "i", "Томск", None, None), (10, "j", "Томск", "ул. Мира, Чужой", "https://te.ru"),
    ]
    c = spark.createDataFrame(rows, "id long, name string, city string, address string, website string")
    known = spark.createDataFrame([("Омск", "Омская"), ("Томск", "Томская")], "name string, region string")
    roots = spark.createDataFrame([("омск", "Омск"), ("томск", "Томск"), ("чужой", "Чужой")], "root string, city string")
    moves = cities.city_moves(c, known, roots)
    assert {(r.id, r.new_city, r.region) for r in moves.collect()} == {(1, "Омск", "Омская"), (8, "Чужой", None), (10, "Чужой", None)}
    full = c.withColumn("region", F.lit("Томская")).withColumn("review_reason", F.lit(None).cast("string"))
    after = {r.id: r for r in cities.reassigned(full, moves).collect()}
    assert (after[1].city, after[1].region, after[1].review_reason) == ("Омск", "Омская", "city_reassigned_from_Томск") and after[8].city == "Томск" and len(after) == 10
    assert [tuple(r) for r in cities.unmatched_cities(moves).collect()] == [("Чужой", 2, "h")]


def test_automata_of_many_parts_agree(spark):
    rng = random.Random(2)
    words = ["омск", "томск", "новый город", "новый", "пермь", "город на реке"]
    texts = [(i, " ".join(rng.choice([*words, "в", "для", ",", "и", "заомск", "пермьский"]) for _ in range(rng.randrange(12)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    roots = spark.createDataFrame([(w, w.upper(), str(len(w) % 2)) for w in words], "root string, city string, region string")
    one, many = ({(r.id, r.city) for r in cities.detect_cities(df, "id", "t", roots, most=m).collect()} for m in (100, 2))
    assert one == many and len(one) > 50

    def foreign(t):
        return any((at == 0 or not t[at - 1].isalpha()) for w in words if len(w) % 2 for at in range(len(t)) if t.startswith(w, at))

    for m in (100, 2):
        assert sorted(r.id for r in cities.names_foreign_city(df, "id", "t", roots, "0", most=m).collect()) == [i for i, t in texts if t and foreign(t)]


def test_best_listing_matches_all_pairs(spark):
    rng = random.Random(7)
    name = lambda: " ".join(rng.choice(["basalt", "stone", "memorial", "art", "plus", "master", "house"]) + rng.choice(["", "s", "ov", "a"]) for _ in range(rng.randrange(1, 4)))
    names = [(i, rng.choice("AB"), name().title()) for i in range(60)] + [(100, "A", None), (101, "A", "")]
    listings = [(i, rng.choice("AB"), name()) for i in range(90)] + [(0, "A", names[0][2]), (500, "A", None)]
    got = {r.id: (r.listing_id, round(r.score, 6)) for r in quality.best_listing(spark.createDataFrame(names, "id long, city string, name string"), spark.createDataFrame(listings, "listing_id long, city string, name string")).collect()}
    want = {}
    for i, c, n in names:
        scored = [(token_sort_similarity((n or "").lower().strip(), (m or "").lower().strip()), j) for j, d, m in listings if c == d]
        score, j = max((s for s in scored if s[0] >= 80), default=(0, None))
        if score:
            want[i] = (j, round(score, 6))
    assert got == want and len(want) > 20


def test_hosts_that_begin_like_private_ones(spark):
    bad = ["http://127.1/", "http://10.example.com", "http://192.168.x", "http://169.254.1", "http://0.0", "http://172.16.evil.com", "http://172.31/", "http://100.64.x.y", "http://100.127/"]
    good = ["http://172.15.evil.com", "http://172.32/", "http://100.63.x", "http://100.128.x", "http://1270.com", "http://example.com", "http://11.example.com"]
    df = spark.createDataFrame([(u,) for u in bad + good], "u string")
    assert [r[0] for r in df.select(urls.is_safe_url(F.col("u"))).collect()] == [False] * len(bad) + [True] * len(good)
