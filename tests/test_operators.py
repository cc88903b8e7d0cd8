"""Operators on small invented relations: clusters, merges, networks, scores, recipients, state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadflow.operators import company_query, crm, networks, quality, relations, resolution, scoring, stats
from leadflow.operators.components import connected_components

RAW = "id long, name string, phones array<string>, address string, website string, emails array<string>, messengers map<string,string>, source string, city string, needs_review boolean, review_reason string"
P = [f"+7903{1000000 + 1357 * i}" for i in range(40)]


def _raw(spark, *rows):
    base = {"name": "Ромашка", "phones": [], "address": None, "website": None, "emails": [], "messengers": None, "source": "web", "city": "Омск", "needs_review": False, "review_reason": ""}
    return spark.createDataFrame([tuple((base | r | {"id": r.get("id", i)})[k.split()[0]] for k in RAW.split(", ")) for i, r in enumerate(rows)], RAW)


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_components_are_the_closure_in_any_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    for seed in (1, 2):
        random.Random(seed).shuffle(edges)
        df = spark.createDataFrame(edges, "src long, dst long").repartition(seed + 1)
        assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def test_phone_clusters(spark):
    rows = _raw(spark, {"phones": [P[0]]}, {"phones": [P[0], P[1]]}, {"phones": [P[1]]}, {"phones": [P[2]]}, {}, {"phones": [P[0]], "city": "Томск"})
    assert _groups(resolution.clusters(rows, resolution.phone_edges(rows))) == [[0, 1, 2], [3], [4], [5]]


def test_hub_phone_ties_nobody(spark):
    rows = _raw(spark, *({"phones": [P[0]]} for _ in range(15)))
    assert len(_groups(resolution.clusters(rows, resolution.phone_edges(rows)))) == 15


def test_site_clusters(spark):
    rows = _raw(spark, {"website": "https://www.a.ru/x"}, {"website": "a.ru"}, {"website": "https://m.b.ru"}, {"website": "https://b.ru"}, {"website": "https://vk.com/1"}, {"website": "https://m.vk.com/2"})
    assert _groups(resolution.clusters(rows, resolution.site_edges(rows))) == [[0, 1], [2, 3], [4], [5]]


def test_name_clusters(spark):
    rows = _raw(spark, {"name": "Гранит Мастер"}, {"name": "мастер гранит"}, {"name": "ООО Ритуал"}, {"name": "Ритуал"}, {"name": "Совсем другое"}, {"name": "Гранит Мастер", "city": "Томск"}, {"name": " "})
    got = _groups(resolution.clusters(rows, resolution.name_edges(rows)))
    assert got == [[0, 1], [2], [3], [4], [5], [6]]
    same = _raw(spark, {"name": "Alpha Beta"}, {"name": "alpha beta "}, {"name": "Alpha Betas"})
    assert _groups(resolution.clusters(same, resolution.name_edges(same, 80))) == [[0, 1, 2]]


def test_merge(spark):
    rows = _raw(
        spark, {"id": 20, "name": "Купить окна недорого", "phones": [P[1]], "emails": ["x@mail.ru"], "website": "https://a.ru", "source": "b"},
        {"id": 10, "name": "Ромашка", "phones": [P[0], P[1]], "emails": ["Y@a.ru "], "messengers": {"telegram": "t1"}, "address": "ул. Ленина, 5", "source": "a"},
        {"id": 30, "name": "Zoon", "messengers": {"telegram": "t2", "vk": "v"}, "source": "a"},
    )
    m = resolution.merge_clusters(rows, rows.select("id", F.lit(1).alias("cluster"))).first()
    assert m.merged_from == [10, 20, 30] and m.name_best == "Ромашка" and m.sources == ["a", "b"]
    assert m.phones == ["7" + P[0][2:], "7" + P[1][2:]] and m.emails == ["y@a.ru", "x@mail.ru"]
    assert m.messengers == {"telegram": "t1", "vk": "v"} and m.website == "https://a.ru" and not m.needs_review and m.review_reason == ""


def test_merge_names_without_a_brand(spark):
    for given, want in ((["Купить окна", "Купить окна и двери недорого"], "Купить окна"), (["Дом", "Дом и сад"], "Дом и сад"), (["Zoon", "Zoon"], "Zoon")):
        rows = _raw(spark, *({"name": n} for n in given))
        assert resolution.merge_clusters(rows, rows.select("id", F.lit(1).alias("cluster"))).first().name_best == want


def test_review_flags(spark):
    rows = _raw(spark, *({"phones": [P[2 * i], P[2 * i + 1]], "city": "Омск" if i else "Томск"} for i in range(4)))
    m = resolution.merge_clusters(rows, rows.select("id", F.lit(1).alias("cluster"))).first()
    assert len(m.phones) == 6 and m.review_reason == "contacts_over_limit different_cities" and m.needs_review
    rows = _raw(spark, {"name": "Альфа", "address": "ул. Ленина, 1", "phones": ["84951234567"]}, {"name": "Бета", "address": "ул. Мира, 2"})
    m = resolution.merge_clusters(rows, rows.select("id", F.lit(1).alias("cluster"))).first()
    assert m.review_reason == "different_names_different_addresses all_non_local_phones"
    rows = _raw(spark, {"address": "ул. Ленина, 1"}, {"address": "ул. Мира, 2"})
    assert resolution.merge_clusters(rows, rows.select("id", F.lit(1).alias("cluster"))).first().review_reason == "same_name_diff_address"


def test_aggregators(spark):
    df = spark.createDataFrame([(1, "https://n.ru", "A", []), (2, "https://n.ru", "B", []), (3, "https://n.ru", "C", []), (4, "https://x.zoon.ru", "A", []), (5, "https://s.ua", "A", []), (6, None, "A", ["a@b.ua"]), (7, "https://o.ru", "A", [])], "id long, website string, city string, emails array<string>")
    got = {r.id: (r.is_network, r.is_spam) for r in resolution.aggregator_scan(df).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True), 5: (False, True), 6: (False, True), 7: (False, False)}


LIVE = "id long, name string, city string, website string, emails array<string>, phones array<string>, score long, segment string"


def test_networks(spark):
    live = spark.createDataFrame([(1, "N", "A", "https://x.n.ru", ["a@n.ru"], [P[0]], 10, "D"), (2, "N", "B", "https://y.n.ru", ["b@n.ru"], [], 20, "D"), (3, "M", "C", "https://lone.ru", ["c@mail.ru"], [], 5, None), (4, "M", "C", None, ["d@mail.ru"], [], None, None)], LIVE)
    m = networks.detect_networks(live)
    t = networks.network_table(live, m).collect()
    assert len(t) == 1 and (t[0].base_domain, t[0].company_count, t[0].city_count, t[0].avg_score, t[0].segment_dist, t[0].network_type) == ("n.ru", 2, 2, 15.0, {"D": 2}, "franchise")
    assert t[0].subdomains == ["x.n.ru", "y.n.ru"] and t[0].emails == ["a@n.ru", "b@n.ru"]
    flagged = networks.assign_networks(live.withColumn("is_network", F.lit(True)), m)
    assert {r.id: r.is_network for r in flagged.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r.id: r.emails for r in networks.shared_emails(live, m).collect()} == {1: ["a@n.ru", "b@n.ru"], 2: ["a@n.ru", "b@n.ru"]}


def test_members_meet_one_list_a_set_of_networks(spark):
    live = spark.range(600).selectExpr("id", "case when id = 3 then array() else array(concat('u', id, '@x.ru')) end as emails")
    m = spark.range(600).selectExpr("explode(array('a', if(id % 2 = 0, 'b', 'a'))) as key", "id").distinct().where("id <> 1").union(spark.createDataFrame([("none", 3)], "key string, id long"))
    m = m.where("id <> 3 or key = 'none'")
    seen = spark.sparkContext.accumulator(0)
    got = networks.shared_emails(live, m).collect()
    every = sorted(f"u{i}@x.ru" for i in range(600) if i not in (1, 3))
    assert len(got) == 598 and all(r.emails == every for r in got)
    # a list is made once for each of the two sets of networks, not once a member
    count = F.udf(lambda e: (seen.add(1), ",".join(e))[1], "string").asNondeterministic()
    rows = networks.shared_emails(live, m, count).collect()
    assert {r.emails for r in rows} == {",".join(every)} and len(rows) == 598 and seen.value <= 8


def test_network_types(spark):
    df = spark.createDataFrame([(1, 0, 0), (3, 3, 3), (3, 2, 3), (3, 1, 3), (0, 0, 0)], "c int, t int, n int")
    got = [r[0] for r in df.select(networks.network_type(F.col("c"), F.col("t"), F.col("n"))).collect()]
    assert got == ["local", "regional", "franchise", "franchise", "local"]
    assert df.select(networks.network_type(F.col("c"), F.col("t"), F.col("n"), "phone")).collect()[3][0] == "aggregator"


def test_scores(spark):
    kinds = "name string, website string, cms string, has_marquiz boolean, messengers map<string,string>, trust_score int, is_bot boolean, phones array<string>, emails array<string>, is_network boolean, city string, address string"
    rows = [
        (None,) * 12,
        ("Мастер", "https://a.ru", "bitrix", True, {"telegram": "t", "whatsapp": "w"}, 2, False, [P[0], P[1]], ["a@b.ru"], True, "Омск", "ул. Мира"),
        ("X Y Z", "https://a.com", "flexbe", None, {}, None, None, [], [], False, "Омск", ""),
        ("Купить", None, None, None, {"telegram": "t"}, -2, True, ["74951234567"], None, None, "Омск", None),
    ]
    got = [(r.score, r.segment) for r in scoring.scored(spark.createDataFrame(rows, kinds)).collect()]
    assert got == [(0, "spam"), (5 + 10 + 4 + 15 + 6 + 10 + 5 + 5 + 5 + 5, "A"), (5, "D"), (0, "spam")]
    assert scoring.ScoreRules(levels=(1, 2, 3)).problems() and not scoring.PRODUCTION.problems()


def test_search_and_presets(spark):
    rows = [(1, "Омск Гранит", None, "A", 10, ["7903"], ["a@b.ru"], {"telegram": "t"}, None), (2, "50% off_er", "https://x.ru", None, None, [], [], {}, None), (3, "Spam", None, "spam", 0, [], [], None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id long, name string, website string, segment string, score int, phones array<string>, emails array<string>, messengers map<string,string>, deleted_at timestamp")
    ids = lambda **q: [r.id for r in company_query.search(df, company_query.CompanyQuery(**q)).orderBy("id").collect()]
    assert ids() == [1, 2] and ids(include_deleted=True, spam=2) == [3] and ids(include_deleted=True, spam=1) == [1, 2, 3]
    assert ids(search="ГРАНИТ") == [1] and ids(search="50%") == [2] and ids(search="f_e") == [2] and ids(search="a@B") == [1] and ids(search="+7 (903)") == [1]
    assert ids(has_email=True) == [1] and ids(has_email=False) == [2] and ids(messengers={"telegram": False}) == [2] and ids(score=(5, None)) == [1]
    page = company_query.page(df, company_query.CompanyQuery(spam=1, include_deleted=True, sort="score", descending=True, page=2, per_page=1)).collect()
    assert [r.id for r in page] == [3]
    known, unknown = company_query.preset_filter("telegram IS NOT NULL AND crm_score >= 5 AND segment='A' AND weird > 1")
    assert len(known) == 3 and unknown == ["weird > 1"] and company_query.preset_filter("1=1") == ([], [])


def _t(h):
    return datetime(2024, 1, 1) + timedelta(hours=h)


def test_fold_of_touches(spark):
    rows = [(1, 1, _t(0), "email", "outgoing"), (2, 1, _t(1), "tg", "outgoing"), (3, 1, _t(2), "wa", "outgoing"), (4, 2, _t(0), "wa", "outgoing"), (5, 2, _t(1), "tg", "outgoing"), (6, 3, _t(5), "email", "outgoing"), (7, 3, _t(1), "email", "incoming")]
    df = spark.createDataFrame(rows, "touch_id long, company_id long, at timestamp, channel string, direction string")
    got = {r.company_id: (r.funnel_stage, r.contact_count, r.stop_automation) for r in crm.fold_touches(df).collect()}
    assert got == {1: ("tg_sent", 3, False), 2: ("wa_sent", 2, False), 3: ("replied", 2, True)}


def test_opens(spark):
    sends = spark.createDataFrame([("a", _t(0)), ("b", _t(0)), ("c", _t(0))], "tracking_id string, sent_at timestamp")
    opens = spark.createDataFrame([("a", _t(0) + timedelta(seconds=29), "x"), ("a", _t(0) + timedelta(seconds=31), "x"), ("b", _t(0) + timedelta(seconds=5), "x"), ("c", _t(1), "GoogleBot")], "tracking_id string, at timestamp, agent string")
    got = {r.tracking_id: (r.opened_at, r.suspicious) for r in crm.first_valid_opens(opens, sends).collect()}
    assert got == {"a": (_t(0) + timedelta(seconds=31), True), "b": (None, True)}


def test_recipients(spark):
    kinds = "ordinal long, company_id long, name string, email string, stop_automation boolean, email_sent_count int, last_email_sent_at timestamp"
    rows = [
        (1, 1, "A", "a@x.ru", False, 0, None), (2, 2, "B", "A@x.ru ", False, 0, None), (3, 3, "C", "s@x.ru", False, 0, None), (4, 4, "D", "d@x.ru", False, 1, None), (5, 5, "E", "bad", False, 0, None),
        (6, 6, "F", "ы@x.ru", False, 0, None), (7, 7, "G", "g@agg.ru", False, 0, None), (8, 8, "H", "h@blk.ru", False, 0, None), (9, 9, "I", "i@x.ru", True, 0, None), (10, 10, " ", "j@x.ru", None, None, None),
        (11, 11, "x" * 81, "k@x.ru", False, 0, None), (12, 12, "L", "l@x.ru", False, 0, _t(0) - timedelta(minutes=10)), (13, 13, "M", "m@x.ru", False, 0, _t(-5)),
    ]
    sent, blocked = spark.createDataFrame([("S@x.ru",)], "email string"), spark.createDataFrame([("blk.ru",)], "domain string")
    got = {r.company_id: r.reason for r in crm.recipient_reasons(spark.createDataFrame(rows, kinds), sent, blocked, F.lit(_t(0)), ("agg.ru",)).collect()}
    assert got == {1: None, 2: "duplicate_email", 3: "already_mailed", 4: "contact_mailed", 5: "bad_format", 6: "not_ascii", 7: "aggregator", 8: "blocked_domain", 9: "stopped", 10: "no_name", 11: "long_name", 12: "too_soon", 13: None}


def test_claims_go_to_the_first_company_that_passes(spark):
    rows = [(1, 1, True, True, ["a@x.ru"]), (2, 2, True, False, ["a@x.ru", "b@x.ru"]), (3, 3, True, False, ["A@x.ru"]), (4, 4, False, False, ["c@x.ru"]), (5, 5, True, False, [])]
    df = spark.createDataFrame(rows, "ordinal long, company_id long, live boolean, stopped boolean, emails array<string>")
    got = {(r.company_id, r.email): r.reason for r in crm.add_recipients(df, df.where("false"), spark.createDataFrame([("b@x.ru",)], "email string")).collect()}
    assert got == {(1, None): "stopped", (2, "a@x.ru"): None, (2, "b@x.ru"): "already_mailed", (3, "a@x.ru"): "claimed", (4, None): "missing", (5, None): "no_email"}


def test_bounces_and_replies(spark):
    c = spark.createDataFrame([(1, "email_sent", False), (2, "email_sent", False), (3, "interested", False), (4, "new", False)], "company_id long, funnel_stage string, stop_automation boolean")
    b = spark.createDataFrame([(1, 1, "5.1.1"), (1, 1, "5.1.1"), (2, 2, "5.7.1"), (3, 3, "5.2.2")], "log_id long, company_id long, code string")
    assert {r.company_id: (r.funnel_stage, r.stop_automation) for r in crm.apply_bounces(c, b).collect()} == {1: ("unreachable", False), 2: ("email_sent", True), 3: ("interested", False), 4: ("new", False)}
    r = spark.createDataFrame([(1, False, False), (3, False, False), (4, True, False), (2, False, True)], "company_id long, is_bounce boolean, is_out_of_office boolean")
    assert {r.company_id: (r.funnel_stage, r.stop_automation) for r in crm.apply_replies(c, r).collect()} == {1: ("replied", True), 2: ("email_sent", False), 3: ("interested", True), 4: ("new", False)}


def test_rewrites(spark):
    c = spark.createDataFrame([(1, ["p"], ["e"], ["b"], [7], 1, None), (2, ["q", "p"], None, ["a"], [], 2, None), (3, [], [], [], [], 5, None)], "id long, phones array<string>, emails array<string>, sources array<string>, merged_from array<long>, contact_count long, merged_into long")
    got = {r.id: r for r in relations.merge_into(c, spark.createDataFrame([(2, 1), (3, 3)], "source long, target long")).collect()}
    assert (got[1].phones, got[1].sources, got[1].merged_from, got[1].contact_count, got[1].merged_into) == (["p", "q"], ["a", "b"], [7, 2], 3, None)
    assert got[2].merged_into == 1 and got[3].merged_into is None and got[3].contact_count == 5
    m = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"}), (None, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(relations.map_fill(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}]


def test_quality_reports(spark):
    rows = spark.createDataFrame([(["123", "79031234567"], ["photo@b.ru", "good@b.ru"])], "phones array<string>, emails array<string>")
    assert {(r.field, r.reason, r.n) for r in quality.contact_problems(rows, "t").collect()} == {("phones", "wrong_length", 1), ("emails", "fake_local", 1)}
    kept = quality.without_placeholders(rows).first()
    assert kept.emails == ["good@b.ru"] and kept.n_removed == 1
    names = spark.createDataFrame([(1, "A", "alpha beta")], "id long, city string, name string")
    listings = spark.createDataFrame([(5, "A", "beta alpha"), (6, "A", "beta alpha"), (7, "B", "alpha beta")], "listing_id long, city string, name string")
    assert quality.best_listing(names, listings).first().listing_id == 6


def test_funnel_has_every_stage(spark):
    df = spark.createDataFrame([("new",), (None,), ("replied",), ("odd",)], "s string")
    got = {r.stage: r.n for r in stats.funnel(df, "s").collect()}
    assert len(got) == 9 and got["new"] == 2 and got["replied"] == 1 and sum(got.values()) == 3
    drift = stats.schema_drift(df, {"s": "int", "x": "string"}).collect()
    assert {(r.column, r.expected, r.found) for r in drift} == {("s", "int", "string"), ("x", "string", None)}
