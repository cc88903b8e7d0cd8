"""Counts, funnels, rates and audits. Survey: A1-A40, W1-W7, L1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.values import STAGES


def funnel(rows: DataFrame, stage: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """stage, n for each stage of the list, zero where no row has it; a null stage counts as the first, others drop out. A2."""
    counts = rows.groupBy(F.coalesce(F.col(stage), F.lit(stages[0])).alias("stage")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return every.join(F.broadcast(counts.where(F.col("stage").isin(*stages))), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(rows: DataFrame, column: str, other: str | None = None) -> DataFrame:
    """Rows by value; nulls count with `other` where given. A3, A19, A25, A34."""
    c = F.col(column) if other is None else F.coalesce(F.col(column), F.lit(other))
    return rows.groupBy(c.alias(column)).agg(F.count("*").alias("n"))


def top(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value. A4."""
    return histogram(rows, column).orderBy(F.desc("n"), column).limit(k)


def top_per_group(rows: DataFrame, group: str, column: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value. A14, W6."""
    counts = rows.groupBy(group, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), column))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's row with the largest order; one hash aggregate, no window. J7, W1-W3."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Rows by value of `row`, one count column for each of values. A7."""
    return rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def rate(part: Column, whole: Column, places: int = 1) -> Column:
    """100 * part / whole, rounded; 0 where whole is 0. A9, A10."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, places)).otherwise(F.lit(0.0))


def ab_variant(key: Column) -> Column:
    """A where the MD5 of the id as text is even, else B. X41."""
    return F.when(F.conv(F.right(F.md5(key.cast("string")), F.lit(1)), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def ab_stats(sends: DataFrame, key: str, opened: Column, replied: Column) -> DataFrame:
    """variant, sent, opened, replied, open_rate, reply_rate. A9."""
    by = sends.groupBy(ab_variant(F.col(key)).alias("variant")).agg(F.count("*").alias("sent"), F.count_if(opened).alias("opened"), F.count_if(replied).alias("replied"))
    return by.withColumn("open_rate", rate(F.col("opened"), F.col("sent"))).withColumn("reply_rate", rate(F.col("replied"), F.col("sent")))


def blocked_domains(bounces: DataFrame, domain: str, at: str, now: Column, hours: int = 24, least: int = 5) -> DataFrame:
    """domain, n: domains with at least `least` bounces in the hours before now. A11."""
    recent = bounces.where(F.col(at) >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.groupBy(F.lower(domain).alias("domain")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def duplicate_names(rows: DataFrame, key: str, name: str, city: str) -> DataFrame:
    """name_key, city, n, ids (ascending, comma-joined) of names met more than once in a city. A23."""
    by = rows.groupBy(F.lower(F.trim(name)).alias("name_key"), F.col(city).alias("city"))
    return by.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("ids")).where("n > 1")


def health(score: str) -> list[Column]:
    """Aggregates of an audit: rows, rows without score, mean score. A20, A21."""
    n, zero = F.count("*"), F.count_if(F.coalesce(F.col(score), F.lit(0)) == 0)
    return [n.alias("n"), zero.alias("n_zero"), rate(zero, n).alias("pct_zero"), F.round(F.avg(score), 1).alias("avg_score")]


def health_bucket(pct: Column) -> Column:
    """Name of a city's share of rows without score: under 25, 30, 35 per cent, or more. A27."""
    return F.when(pct < 25, "good").when(pct < 30, "fair").when(pct < 35, "poor").otherwise("critical")


def stage_of_progress(raw: Column, companies: Column, enriched: Column) -> Column:
    """start, scraped, deduped or enriched from the row counts of a city. A8, T15."""
    return F.when(enriched > 0, "enriched").when(companies > 0, "deduped").when(raw > 0, "scraped").otherwise("start")


def progress(done: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(done / of, 3)).otherwise(F.lit(0.0))


def schema_drift(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """column, expected, found of every column that differs from what is declared. A40."""
    have = dict(df.dtypes)
    rows = [(c, expected.get(c), have.get(c)) for c in sorted(have.keys() | expected) if have.get(c) != expected.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")
