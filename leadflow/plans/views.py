"""The driver's tables as leads, touches, signals, sites and texts: projections only, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.urls import hostname


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, d: str) -> DataFrame:
    """nation_key, city, region: 25 rows at any scale factor."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("city"), F.col("r_name").alias("region"))


def leads(spark: SparkSession, d: str) -> DataFrame:
    """company_id, name, city, region, segment, balance and score (a hundredth of the balance, at least 0)."""
    c = table(spark, d, "customer")
    out = c.join(F.broadcast(geography(spark, d)), c.c_nationkey == F.col("nation_key"))
    return out.select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), "city", "region", F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)).cast("long").alias("score"),
    )


def touches(spark: SparkSession, d: str) -> DataFrame:
    """touch_id, company_id, at, channel, status, value from orders."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("touch_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, company_id, at, kind, value, k (the number in the event's properties)."""
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("company_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def last_time(df: DataFrame, column: str) -> Column:
    """The largest time of a column as a literal: queries take `now` from their data."""
    return F.timestamp_micros(F.lit(df.agg(F.max(F.unix_micros(column))).first()[0]))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, host (lower-cased, no www.), base (last two labels) and html."""
    host = F.regexp_replace(hostname(F.col("url")), r"^www\.", "")
    return table(spark, d, "pages").select("page_id", "url", host.alias("host"), F.substring_index(host, ".", -2).alias("base"), "html")


def line_signals(spark: SparkSession, d: str, least: int = 40) -> DataFrame:
    """doc_id and each distinct trimmed line of `least` characters or more."""
    line = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("signal")
    return table(spark, d, "documents").select("doc_id", line).where(F.length("signal") >= least)


def companies(spark: SparkSession, d: str) -> DataFrame:
    """leads with sites, phones, addresses and messengers derived from their ids: the relation that company operators take."""
    k = F.col("company_id")
    s = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    ending = F.when(k % 5 == 0, ".com").when(k % 5 == 1, ".net").otherwise(".ru")
    mobile = F.concat(F.lit("+7"), s(F.lit(9031000000) + (k * 7919) % 99999))
    office = F.concat(F.lit("8495"), F.lpad(s((k * 31) % 10000000), 7, "0"))
    info = F.concat(F.lit("info"), s(k % 50), F.lit("@site"), s(k % 97), F.lit(".ru"))
    telegram = F.when(k % 5 == 0, F.concat(F.lit("https://t.me/u"), s(k)))
    whatsapp = F.when(k % 7 == 0, F.concat(F.lit("https://wa.me/7"), s(k)))
    pairs = F.array_compact(F.array(F.when(telegram.isNotNull(), F.struct(F.lit("telegram").alias("k"), telegram.alias("v"))), F.when(whatsapp.isNotNull(), F.struct(F.lit("whatsapp").alias("k"), whatsapp.alias("v")))))
    return leads(spark, d).select(
        k.alias("id"), "name", "city", "region", "segment", "score",
        F.when(k % 4 != 0, F.concat(F.lit("https://www.s"), s(k % 3), F.lit(".site"), s(k % 97), ending, F.lit("/about"))).alias("website"),
        F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(mobile)).otherwise(F.array(mobile, office)).alias("phones"),
        F.when(k % 2 == 0, none).when(k % 6 == 1, F.array(info, F.concat(F.lit("user"), s(k), F.lit("@mail.ru")))).otherwise(F.array(info)).alias("emails"),
        F.map_from_entries(pairs).alias("messengers"),
        F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("ul. Street"), s(k % 20), F.lit(", "), s(k % 100))).alias("address"),
        F.when(k % 6 == 0, "bitrix").when(k % 6 == 1, "wordpress").when(k % 6 == 2, "tilda").otherwise("unknown").alias("cms"),
        (k % 11 == 0).alias("has_marquiz"), (k % 17 == 0).alias("deleted"), (k % 13 == 0).alias("is_network"),
    )
