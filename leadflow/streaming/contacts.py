"""Streams of contact events: limits, funnels, opens, registries, counters. Survey: ST1-ST7, T1, T2, T10.

Each operator takes any DataFrame, streaming or not, that has an event time of type timestamp; a batch and a stream
over the same rows give the same result, once a stream has seen them all. Operators with state of their own run on
transformWithState and need the state store of leadflow.session (RocksDB).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leadflow.operators.crm import first_valid_opens, fold_touches
from leadflow.plans.ordered import carried


def admitted(times: list[int], log: list[int], most: int, window: int) -> tuple[list[bool], list[int]]:
    """Admission of each time in order under at most `most` admissions in any window; log: the last admissions so far."""
    out, last = [], deque(log)
    for t in times:
        while last and last[0] <= t - window:
            last.popleft()
        out.append(len(last) < most)
        if out[-1]:
            last.append(t)
    return out, list(last)


def rate_limited(requests: DataFrame, key: str, most: int, window_seconds: float) -> DataFrame:
    """requests (key, request_id, at) with `admitted`, in time order. ST3.

    Admission depends on earlier admissions, of which the last `most` are all that counts: a stream keeps them by key, a
    batch carries them from range to range of the ordered requests, so no key is gathered and a hot one is many tasks.
    A request without a time is refused.
    """
    window = round(window_seconds * 1_000_000)
    named = requests.select(F.col(key).cast("string").alias("key"), "request_id", "at", F.unix_micros("at").alias("_t"))
    if not requests.isStreaming:

        def fold(k: object, rows: dict[str, list], log: list) -> tuple[list, list]:
            timeless = sum(t is None for t in rows["_t"])  # nulls come first
            ok, log = admitted(rows["_t"][timeless:], log, most, window)
            return [False] * timeless + ok, log

        return carried(named, "key", ["_t", "request_id"], fold, "admitted", "boolean", pa.bool_()).select("key", "request_id", "at", "admitted")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["_t", "request_id"])
        there = pdf["_t"].notna()
        ok, log = admitted(pdf["_t"][there].astype("int64").tolist(), log, most, window)
        state.update((log,))
        pdf["admitted"] = False
        pdf.loc[there, "admitted"] = ok
        yield pdf[["key", "request_id", "at", "admitted"]]

    return named.groupBy("key").applyInPandasWithState(step, "key string, request_id long, at timestamp, admitted boolean", "log array<long>", "append", GroupStateTimeout.NoTimeout)


def funnel_stream(touches: DataFrame) -> DataFrame:
    """company_id, funnel_stage and contact_count from touches; a stream emits a company whenever it changes. ST7, T1, T2.

    The fold is one aggregate whose state does not depend on the order of arrival, so late touches count in their place.
    """
    return fold_touches(touches).select("company_id", "funnel_stage", "contact_count")


def rolling_counts(events: DataFrame, key: str, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) of sliding windows; streams drop rows later than `late`. ST4, A11, A12."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    return rows.groupBy(F.window("at", length, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """One row for each key; streams remember keys for `late`. ST1."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def opens_with_sends(opens: DataFrame, sends: DataFrame, guard_seconds: int = 30) -> DataFrame:
    """opens (tracking_id, at, agent) joined with static sends, robots removed, with `suspicious`. ST2, T10."""
    people = opens.where(~F.coalesce(F.col("agent").rlike("(?i)bot|crawler|spider|preview|proxy"), F.lit(False)))
    j = people.join(sends, "tracking_id")
    return j.withColumn("suspicious", F.unix_timestamp("at") - F.unix_timestamp("sent_at") <= guard_seconds)


_EPOCH = pd.Timestamp(0)


class _FirstOpen(StatefulProcessor):
    """Holds the earliest valid open of a tracking id until no earlier one can come, gives it once, and forgets it after a while."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "opened_us long, suspicious boolean, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.state.get() if self.state.exists() else (None, False, False)
        first, suspicious, done = had
        mark = _EPOCH + pd.Timedelta(milliseconds=max(0, timerValues.getCurrentWatermarkInMs()))
        for pdf in rows:
            pdf = pdf[pdf["at"] >= mark]  # what comes later than the watermark allows is not there
            suspicious = bool(suspicious or pdf["suspicious"].any())
            if not done and len(valid := pdf.loc[~pdf["suspicious"], "at"]):
                at = int((valid.min() - _EPOCH) // pd.Timedelta(microseconds=1))
                first = at if first is None else min(first, at)
        self.state.update((first, suspicious, done))
        if not done and first is not None and had[0] != first:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(first // 1000 + 1)
        elif first is None and not had[1]:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.keep_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, suspicious, done = self.state.get()
        if done or first is None:
            self.state.clear()
            return
        self.state.update((first, suspicious, True))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.keep_ms)
        yield pd.DataFrame({"tracking_id": [key[0]], "opened_at": [_EPOCH + pd.Timedelta(microseconds=first)], "suspicious": [suspicious]})

    def close(self) -> None:
        pass


def first_opens(opens: DataFrame, sends: DataFrame, guard_seconds: int = 30, late: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """(tracking_id, opened_at, suspicious) of each send that was opened validly: its first counted open, given once. ST2, T10.

    opens: tracking_id, at, agent; sends (static): tracking_id, sent_at. A stream keeps one value and a timer an id: it
    gives an id's open when the watermark (`late` behind the newest event) has passed it, so opens may come in any order
    within that; repeated and later ones change nothing, and the id is forgotten after `keep_days`.
    """
    if not opens.isStreaming:
        return first_valid_opens(opens, sends, guard_seconds).where("opened_at is not null")
    joined = opens_with_sends(opens.withWatermark("at", late), sends, guard_seconds).select("tracking_id", "at", "suspicious")
    kind = opens.schema["tracking_id"].dataType.simpleString()
    return joined.groupBy("tracking_id").transformWithStateInPandas(_FirstOpen(keep_days * 86_400_000), f"tracking_id {kind}, opened_at timestamp, suspicious boolean", "append", "EventTime")


class _Registry(StatefulProcessor):
    """Holds the different cities of a domain until they are enough, then only that they were."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cities = handle.getValueState("cities", "names array<string>, flagged boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, flagged = self.cities.get() if self.cities.exists() else ([], False)
        if flagged:
            return
        known = set(names or [])
        for pdf in rows:
            for city in pdf["city"].dropna().unique():
                if len(known) < self.least:
                    known.add(city)
        if len(known) == len(names or []) and self.cities.exists():
            return
        flagged = len(known) >= self.least
        self.cities.update(([] if flagged else sorted(known), flagged))
        yield pd.DataFrame({"domain": [key[0]], "n_cities": [len(known)], "flagged": [flagged]})

    def close(self) -> None:
        pass


def domain_registry(sightings: DataFrame, least: int = 3) -> DataFrame:
    """(domain, n_cities, flagged) from sightings (domain, city): whether a domain was seen in `least` cities or more. ST5.

    A batch counts all cities. A stream emits a domain when it changes and counts up to `least`: its state is a set of
    fewer names, given up once the domain is flagged, so `flagged` is exact in both and n_cities is up to `least`.
    """
    low = sightings.select("domain", F.lower("city").alias("city"))
    if sightings.isStreaming:
        return low.groupBy("domain").transformWithStateInPandas(_Registry(least), "domain string, n_cities long, flagged boolean", "update", "None")
    return low.groupBy("domain").agg(F.countDistinct("city").alias("n_cities")).withColumn("flagged", F.col("n_cities") >= least)


def failed_recently(attempts: DataFrame, failures: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """(domain, at, skip) of different attempts (domain, at): a failure of the domain (domain, failed_at) lies less than the TTL back. ST6.

    An as-of join in one ordered pass: time is cut into slices as long as the TTL, each of which starts with the last
    failure of the slice before, so every attempt finds its last failure within its own slice. Rows move once, a domain
    is as many tasks as it has slices, and no attempt meets more than the one failure. Without a time nothing is recent.
    """
    row = lambda df, at, asked, shift=0: df.select("domain", F.col(at).alias("at"), F.lit(asked).alias("_asked"), (F.floor(F.unix_timestamp(at) / ttl_seconds) + shift).alias("_slice"))
    last = failures.groupBy("domain", F.floor(F.unix_timestamp("failed_at") / ttl_seconds).alias("_s")).agg(F.max("failed_at").alias("failed_at"))
    rows = row(attempts, "at", True).unionByName(row(failures, "failed_at", False)).unionByName(row(last, "failed_at", False, 1))
    before = Window.partitionBy("domain", "_slice").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.max(F.when(~F.col("_asked"), F.col("at"))).over(before)
    back = F.unix_micros("at") - F.unix_micros(failed)  # whole seconds would lose what is less than one short of the TTL
    skip = F.coalesce(back < ttl_seconds * 1_000_000, F.lit(False)) & F.col("domain").isNotNull()
    return rows.withColumn("skip", skip).where("_asked").dropDuplicates(["domain", "_slice", "at"]).select("domain", "at", "skip")
