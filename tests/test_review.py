"""Review decisions, groups, merge switches and the repair chain."""

from datetime import datetime

from pyspark.sql import functions as F

from leadflow.operators import relations, review

NOW = datetime(2024, 5, 1)
FULL = "id long, name string, city string, website string, address string, phones array<string>, emails array<string>, sources array<string>, merged_from array<long>, contact_count long, merged_into long, segment string, status string, needs_review boolean, review_reason string, is_network boolean, deleted_at timestamp, score long"


def _row(i, **kw):
    base = dict(id=i, name="n", city="c", website=f"https://a{i}.ru", address="", phones=[f"p{i}"], emails=[f"e{i}@x.ru"], sources=[f"s{i}"], merged_from=[], contact_count=i, merged_into=None, segment="A", status="open", needs_review=True, review_reason="r", is_network=False, deleted_at=None, score=1)
    return tuple((base | kw).values())


def test_decisions_and_refusals(spark):
    c = spark.createDataFrame([_row(1), _row(2), _row(3, deleted_at=datetime(2020, 1, 1)), _row(4), _row(5), _row(6, segment=None)], FULL)
    asked = [(1, "approve", None, None), (2, "spam", "junk", None), (3, "duplicate", None, 1), (4, "duplicate", None, 1), (5, "duplicate", None, 5), (6, "spam", "", None), (9, "approve", None, None)]
    d = spark.createDataFrame(asked, "id long, action string, reason string, target_id long")
    v = review.judged(c, d)
    assert {r.id: r.refusal for r in v.collect()} == {1: None, 2: None, 3: "deleted", 4: None, 5: "itself", 6: "no_reason", 9: "missing"}
    assert {r.id for r in review.judged(c, spark.createDataFrame([(3, "approve", None, None)], d.schema), batch=True).where("refusal = 'deleted'").collect()} == {3}
    out = {r.id: r for r in review.reviewed(c, v, F.lit(NOW)).collect()}
    assert (out[1].needs_review, out[1].review_reason) == (False, "") and out[5] == c.where("id = 5").first()
    assert (out[2].segment, out[2].status, out[2].review_reason) == ("spam", "spam", "mark-spam:junk:prev_segment=A") and out[2].deleted_at
    assert (out[4].merged_into, out[4].review_reason, out[4].phones) == (1, "duplicate_of:1", ["p4"])
    assert {r.company_id: r.note for r in review.review_touches(v, F.lit(NOW)).collect()} == {1: "resolve-review: approved", 2: "resolve-review: spam, reason=junk", 4: "resolve-review: duplicate, target=1"}
    contacts = spark.createDataFrame([(2, None), (4, False)], "company_id long, stop_automation boolean")
    assert {r.company_id: r.stop_automation for r in review.stopped_as_spam(contacts, v).collect()} == {2: True, 4: False}


def test_groups(spark):
    c = spark.createDataFrame([_row(i) for i in range(1, 6)] + [_row(6, deleted_at=datetime(2020, 1, 1)), _row(7), _row(8)], FULL)
    members = spark.createDataFrame([("g", 1), ("g", 2), ("d", 3), ("d", 4), ("d", 6), ("x", 7), ("x", 8)], "group_id string, id long")
    said = spark.createDataFrame([("g", "network", None), ("d", "duplicate", 3), ("x", "duplicate", 1)], "group_id string, action string, target_id long")
    out = {r.id: r for r in review.groups_resolved(c, members, said, F.lit(NOW)).collect()}
    assert out[1].is_network and out[2].is_network and not out[1].needs_review
    assert (sorted(out[3].phones), out[3].merged_from, out[3].sources, out[3].contact_count, out[3].needs_review) == (["p3", "p4"], [4], ["s3", "s4"], 3, False)
    assert (out[4].merged_into, out[4].review_reason) == (3, "merged_into_3") and out[4].deleted_at and out[6].merged_into is None
    assert out[7] == c.where("id = 7").first() and out[5] == c.where("id = 5").first()


def test_merge_switches(spark):
    c = spark.createDataFrame([_row(1, phones=["z"], is_network=True), _row(2, phones=["a", "z"], is_network=True), _row(3)], FULL)
    plan = spark.createDataFrame([(2, 1)], "source long, target long")
    get = lambda **kw: {r.id: r for r in relations.merge_into(c, plan, **kw).collect()}
    assert get()[1].phones == ["z", "a"] and get(ordered=True)[1].phones == ["a", "z"]
    assert get(contacts=False)[1].contact_count == 1 and get()[1].contact_count == 3 and get(sources=False)[1].sources == ["s1"]
    assert [get(clear_network=("target",))[i].is_network for i in (1, 2, 3)] == [False, True, False]
    assert [get(clear_network=("target", "source"))[i].is_network for i in (1, 2, 3)] == [False, False, False]


def test_single_city_plan(spark):
    site = "https://one.ru"
    c = spark.createDataFrame([_row(1, website=site, emails=[]), _row(2, website=site), _row(3, website="https://two.ru"), _row(4, website="https://two.ru", city="d"), _row(5, website="https://three.ru", name="m"), _row(6, website="https://three.ru"), _row(7, website=""), _row(8, website="")], FULL)
    assert [tuple(r) for r in review.single_city_plan(c).collect()] == [(1, 2)]


def test_repair_is_one_chain(spark):
    rows = [_row(i, website=f"https://shop{i}.net.ru" if i > 2 else "https://bad.ru", emails=["x@net.ru"], messengers=None) for i in range(1, 6)]
    c = spark.createDataFrame([r[:18] for r in rows], FULL)
    out = {r.id: r for r in review.repaired(c, domains=("bad.ru",)).collect()}
    assert all(out[i].status == "spam" and out[i].score == 0 and out[i].segment == "spam" and not out[i].is_network for i in (1, 2))
    assert all(out[i].is_network and out[i].score > 0 for i in (3, 4, 5))
    diff = review.repair_plan(c)
    assert {r.id for r in diff.where("column = 'is_network'").collect()} >= {3, 4, 5}
    assert review.repair_plan(c, spam=False, nets=False, scores=False).count() == 0
