"""Folds and places over ordered rows, with one key that holds most of them; streams against batches."""

import itertools
import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from leadflow.functions.values import STAGES
from leadflow.operators import crm
from leadflow.plans.ordered import carried, placed
from leadflow.streaming import contacts as streams

T0 = datetime(2024, 1, 1)
TOUCHES = "touch_id long, company_id long, at timestamp, channel string, direction string"


def plain_stage(stage, channel, incoming):
    """One touch at a time."""
    decided = stage in ("interested", "not_interested")
    if incoming:
        return stage if decided else "replied"
    if channel == "email":
        return "email_sent" if stage == "new" else stage
    if channel == "tg":
        return "tg_sent" if stage in ("new", "email_sent", "email_opened") else stage
    if channel == "wa":
        return stage if decided or stage in ("replied", "tg_sent") else "wa_sent"
    return stage


def test_every_short_history_from_every_stage(spark):
    kinds = [("email", "outgoing"), ("tg", "outgoing"), ("wa", "outgoing"), ("email", "incoming"), ("call", "outgoing"), ("wa", None)]
    rows, want = [], {}
    for i, h in enumerate(h for n in (1, 2, 3, 4) for h in itertools.product(kinds, repeat=n)):
        rows += [(10 * i + j, i, T0 + timedelta(minutes=j // 2), *k) for j, k in enumerate(h)]  # pairs at one time go by touch_id
        want[i] = h
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TOUCHES)
    for start in STAGES:
        got = {r.company_id: r.funnel_stage for r in crm.fold_touches(df, start).collect()}
        for i, h in want.items():
            stage = start
            for channel, direction in h:
                stage = plain_stage(stage, channel, direction == "incoming")
            assert got[i] == stage, (start, h)


def test_no_touches_are_gathered(spark):
    df = spark.createDataFrame([(1, 1, T0, "tg", "outgoing")], TOUCHES)
    plan = crm.fold_touches(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def _requests(n=6000):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 9, 40])
        rows.append(("hot" if rng.random() < 0.8 else f"k{rng.randrange(30)}", i, T0 + timedelta(seconds=t)))
    return [*rows, ("hot", n, None), (None, n + 1, T0), (None, n + 2, T0 + timedelta(seconds=1))]


def _plain_limit(rows, most, window):
    out, log = {}, {}
    for k, i, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[1])):
        if at is None:
            out[i] = False
            continue
        mine = [x for x in log.get(k, []) if x > at - timedelta(seconds=window)]
        out[i] = len(mine) < most
        log[k] = mine + [at] * out[i]
    return out


def test_limits_of_a_hot_key_over_many_ranges(spark):
    rows = _requests()
    df = spark.createDataFrame(rows, "ip string, request_id long, at timestamp").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for most, window in ((2, 60), (5, 7200), (1, 10)):  # states that forget soon, and ones that do not
            got = streams.rate_limited(df, "ip", most, window).withColumn("_task", F.spark_partition_id())
            each = got.collect()
            assert {r.request_id: r.admitted for r in each} == _plain_limit(rows, most, window)
            assert len({r._task for r in each if r.key == "hot"}) > 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert streams.rate_limited(df.limit(0), "ip", 2, 60).collect() == []


def test_a_fold_that_never_forgets(spark):
    df = spark.range(3000).selectExpr("'one' as k", "id as i", "id % 7 as v").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)

    def total(k, rows, state):
        out, s = [], (state or [0])[0]
        for v in rows["v"]:
            s += v
            out.append(s)
        return out, [s]

    got = carried(df, "k", ["i"], total, "total", "long", pa.int64()).orderBy("i").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.total for r in got] == list(itertools.accumulate(i % 7 for i in range(3000)))


def test_places_of_a_group_over_many_tasks(spark):
    rows = [("a" if i % 5 else None if i % 2 else f"g{i % 40}", (i * 7919) % 1000, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, score long, id long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = placed(df, ["g"], [F.desc("score"), "id"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((-s, i) for h, s, i in rows if h == g))}
    assert {r.id: r.pos for r in got} == want
    assert placed(df.limit(0), ["g"], ["id"]).collect() == []


def test_recent_failures_as_of_each_attempt(spark):
    rng = random.Random(5)
    when = lambda: T0 + timedelta(seconds=rng.randrange(40_000))
    attempts = [(rng.choice(["a", "a", "a", "b", None]), when()) for _ in range(500)] + [("a", None), ("a", T0), ("a", T0)]
    failures = [(rng.choice(["a", "b", "c", None]), when()) for _ in range(120)] + [("a", T0), ("a", None)]
    got = streams.failed_recently(spark.createDataFrame(attempts, "domain string, at timestamp"), spark.createDataFrame(failures, "domain string, failed_at timestamp"), 600)
    near = lambda d, t: t is not None and d is not None and any(d == e and f is not None and f <= t and (t - f).total_seconds() < 600 for e, f in failures)
    assert sorted(map(tuple, got.collect()), key=str) == sorted({(d, t, near(d, t)) for d, t in attempts}, key=str)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_recent_failures_count_parts_of_a_second(spark):
    at = lambda micros: T0 + timedelta(microseconds=micros)
    ttl = 600_000_000
    failures = [(d, at(900_000)) for d in "abc"]
    attempts = [("a", at(900_000 + ttl - 1)), ("b", at(900_000 + ttl)), ("c", at(899_999))]
    got = streams.failed_recently(spark.createDataFrame(attempts, "domain string, at timestamp"), spark.createDataFrame(failures, "domain string, failed_at timestamp"), 600)
    assert {r.domain: r.skip for r in got.collect()} == {"a": True, "b": False, "c": False}


def _stream(spark, rows, schema, path, parts):
    """rows as a stream of one file a batch, in the order given."""
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(out, name, mode, tmp_path):
    spark = out.sparkSession
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(300)
    return spark.table(name).collect()


def test_funnel_of_touches_out_of_order(spark, tmp_path):
    kinds = [("email", "outgoing"), ("tg", "outgoing"), ("wa", "outgoing"), ("email", "incoming")]
    rows = [(i, i % 6, T0 + timedelta(minutes=i), *kinds[(i * 7 + i // 3) % (3 if i % 6 < 4 else 4)]) for i in range(90)]
    random.Random(2).shuffle(rows)
    df, src = _stream(spark, rows, TOUCHES, tmp_path / "in", 4)
    last = {}
    for r in _run(streams.funnel_stream(src), "funnel_out_of_order", "update", tmp_path):
        last[r.company_id] = max(last.get(r.company_id, (0, "")), (r.contact_count, r.funnel_stage))
    assert {(k, s, n) for k, (n, s) in last.items()} == {tuple(r) for r in streams.funnel_stream(df).collect()}


def test_first_opens_of_a_stream_come_once(spark, tmp_path):
    rng = random.Random(4)
    sends = spark.createDataFrame([(f"t{i}", T0) for i in range(20)], "tracking_id string, sent_at timestamp")
    rows = [(f"t{rng.randrange(18)}", T0 + timedelta(seconds=rng.randrange(5, 3000)), rng.choice(["Mozilla", "Mozilla", "SomeBot", None])) for _ in range(150)]
    rows += rows[:40] + [("t18", T0 + timedelta(seconds=3), "Mozilla"), ("t-unknown", T0, "Mozilla")]
    rng.shuffle(rows)
    late = [("t3", T0 + timedelta(seconds=31), "Mozilla")] * 2  # behind the watermark: changes nothing
    end = [("t19", T0 + timedelta(hours=9), "Mozilla")]
    df, src = _stream(spark, rows, "tracking_id string, at timestamp, agent string", tmp_path / "in", 5)
    for more in (end, late, end):
        spark.createDataFrame(more, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = _run(streams.first_opens(src, sends), "first_opens", "append", tmp_path)
    want = {(r.tracking_id, r.opened_at) for r in streams.first_opens(df, sends).collect()}
    assert len(got) == len(want) and {(r.tracking_id, r.opened_at) for r in got} == want


def test_registry_of_a_stream_is_exact(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(12)}", rng.choice(["Omsk", "OMSK", "Tomsk", "Perm", "Ufa", None]) if i % 3 else "Omsk") for i in range(120)] + [("lonely", "Omsk"), ("empty", None)]
    df, src = _stream(spark, rows, "domain string, city string", tmp_path / "in", 5)
    got = _run(streams.domain_registry(src), "registry", "update", tmp_path)
    last = {}
    for r in got:
        last[r.domain] = max(last.get(r.domain, (0, False)), (r.n_cities, r.flagged))
    want = {r.domain: (min(r.n_cities, 3), r.flagged) for r in streams.domain_registry(df).collect()}
    assert last == want and len(got) <= 3 * len(want) + 3
