"""A round of sending against the loop it stands for."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadflow.operators import sending

NOW = datetime(2024, 5, 2)


def _plain(campaigns, queue, sent_today, per_run, per_day):
    """One message at a time."""
    plan, status = {}, {}
    for c, _, state in sorted(campaigns, key=lambda x: (x[1], x[0])):
        status[c] = state
        if state != "running":
            continue
        mine = sorted((q for q in queue if q[0] == c), key=lambda q: q[1])
        status[c] = "paused" if len(mine) > per_run else "completed"
        for i, q in enumerate(mine[:per_run]):
            if not q[4]:
                plan[q[:2]] = "error"
            elif sent_today >= per_day:
                status[c] = "paused_daily_limit"
                plan |= {x[:2]: "day_limit" for x in mine[i:per_run]}
                break
            else:
                plan[q[:2]] = "send"
                sent_today += 1
    return plan, status


@pytest.mark.parametrize("seed", range(4))
def test_round_matches_the_loop(spark, seed):
    rng = random.Random(seed)
    campaigns = [(i, rng.randrange(3), rng.choice(["running", "running", "paused"])) for i in range(8)]
    queue = [(rng.choice([0, 0, 0, *range(8)]), i, i, f"e{i % 40}@x.ru", rng.random() < 0.7) for i in range(120)]
    logs = [(NOW - timedelta(hours=rng.randrange(60)),) for _ in range(30)] + [(None,)]
    today = sum(t is not None and t >= NOW - timedelta(hours=24) for (t,) in logs)
    c = spark.createDataFrame(campaigns, "campaign_id long, priority long, status string").withColumn("total_sent", F.lit(None).cast("long")).withColumn("total_errors", F.lit(1).cast("long"))
    q = spark.createDataFrame(queue, "campaign_id long, ordinal long, company_id long, email string, has_contact boolean")
    log = spark.createDataFrame(logs, "sent_at timestamp")
    for per_run, per_day in ((6, today + 15), (30, today + 1), (3, today), (200, 1000)):
        plan = sending.send_plan(c, q, log, F.lit(NOW), per_run, per_day)
        want, status = _plain(campaigns, queue, today, per_run, per_day)
        assert {(r.campaign_id, r.ordinal): r.decision for r in plan.collect()} == want
        after = {r.campaign_id: r for r in sending.campaigns_after(c, q, plan).collect()}
        assert {k: r.status for k, r in after.items()} == status
        assert sum(r.total_sent for r in after.values()) == sum(x == "send" for x in want.values()) <= max(0, per_day - today)


def test_round_of_nothing(spark):
    c = spark.createDataFrame([], "campaign_id long, priority long, status string")
    q = spark.createDataFrame([], "campaign_id long, ordinal long, company_id long, email string, has_contact boolean")
    assert sending.send_plan(c, q, spark.createDataFrame([], "sent_at timestamp"), F.lit(NOW)).collect() == []
