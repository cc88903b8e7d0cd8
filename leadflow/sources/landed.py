"""Landed listings as raw rows: directory JSON-LD, maps API JSON, detail pages, mail files. Survey: SRC1-SRC11, SRC16, SRC18, SNK6.

Fetching is ingestion and happens elsewhere; these readers parse what was landed.
"""

from __future__ import annotations

from datetime import UTC
from email import message_from_string, policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from leadflow.functions.phones import DEFAULT, PhoneRules, normalize_phones
from leadflow.functions.urls import classify_messenger, extract_domain
from leadflow.sources.snapshots import Store

RAW = "source string, source_url string, name string, phones array<string>, address string, website string, emails array<string>, lat double, lon double, city string"
_ITEM = "struct<url:string,name:string,telephone:string,email:string,sameAs:array<string>,address:struct<streetAddress:string,addressLocality:string>,geo:struct<latitude:string,longitude:string>>"
_LIST = f"`@type` string, itemListElement array<struct<item:{_ITEM}>>"


def directory_listings(pages: DataFrame, html: str = "html", source: str = "directory") -> DataFrame:
    """Raw rows of the ItemList blocks of landed directory pages, one for each listing address. SRC2, SRC3."""
    blocks = F.explode(F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1)))
    items = pages.select(blocks.alias("j")).select(F.from_json("j", _LIST).alias("l")).where(F.col("l.@type") == "ItemList").select(F.explode("l.itemListElement.item").alias("i"))
    none = F.array().cast("array<string>")
    rows = items.select(
        F.lit(source).alias("source"), F.col("i.url").alias("source_url"), F.trim("i.name").alias("name"),
        F.when(F.col("i.telephone").isNotNull(), F.transform(F.split("i.telephone", "[,;]"), lambda x: F.trim(x))).otherwise(none).alias("phones"), F.col("i.address.streetAddress").alias("address"),
        F.get("i.sameAs", F.lit(0)).alias("website"), F.when(F.col("i.email").isNotNull(), F.array(F.lower(F.trim("i.email")))).otherwise(none).alias("emails"),
        F.col("i.geo.latitude").try_cast("double").alias("lat"), F.col("i.geo.longitude").try_cast("double").alias("lon"), F.col("i.address.addressLocality").alias("city"),
    )
    return rows.where("source_url is not null").dropDuplicates(["source_url"])


_CONTACT = "struct<type:string,value:string,url:string>"
_PLACE = f"id string, name string, address_name string, city string, point struct<lat:double,lon:double>, contact_groups array<struct<contacts:array<{_CONTACT}>>>"


def map_places(items: DataFrame, body: str = "body", source: str = "maps") -> DataFrame:
    """Raw rows of landed maps API items (JSON text): contacts by type, first website, all phones and mails. SRC7."""
    j = items.select(F.from_json(body, _PLACE).alias("p")).where(F.col("p.name").isNotNull())
    contacts = F.flatten(F.transform(F.coalesce("p.contact_groups", F.array().cast(f"array<struct<contacts:array<{_CONTACT}>>>")), lambda g: F.coalesce(g["contacts"], F.array().cast(f"array<{_CONTACT}>"))))
    of = lambda kind: F.transform(F.filter("c", lambda x: x["type"] == kind), lambda x: F.coalesce(x["url"], x["value"]) if kind == "website" else x["value"])
    j = j.withColumn("c", contacts)
    return j.select(
        F.lit(source).alias("source"), F.col("p.id").alias("source_url"), F.col("p.name").alias("name"), F.array_distinct(of("phone")).alias("phones"), F.col("p.address_name").alias("address"),
        F.get(of("website"), F.lit(0)).alias("website"), F.array_distinct(F.transform(of("email"), F.lower)).alias("emails"), F.col("p.point.lat").alias("lat"), F.col("p.point.lon").alias("lon"), F.col("p.city").alias("city"),
    )


def detail_contacts(html: Column) -> Column:
    """Struct of site and messengers from the base64 links of a detail page. SRC4."""
    links = F.transform(F.regexp_extract_all(html, F.lit('data-link="([A-Za-z0-9+/=]+)"'), F.lit(1)), lambda b: F.decode(F.try_to_binary(b, F.lit("base64")), "utf-8"))
    links = F.filter(links, lambda u: u.rlike("(?i)^https?://"))
    site = F.get(F.filter(links, lambda u: classify_messenger(u).isNull()), F.lit(0))
    found = F.transform(F.filter(links, lambda u: classify_messenger(u).isNotNull()), lambda u: F.struct(classify_messenger(u).alias("k"), u.alias("v")))
    first = F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["k"]), x["k"]) == i + 1)
    return F.struct(site.alias("website"), F.map_from_entries(first).alias("messengers"))


def without_seen(new: DataFrame, old: DataFrame, r: PhoneRules = DEFAULT) -> DataFrame:
    """Rows of new whose address, site and phones are all unknown to old: three anti joins. SRC18."""
    out = new.join(old.select("source_url").where("source_url is not null").distinct(), "source_url", "left_anti")
    d = old.select(extract_domain(F.col("website")).alias("_d")).where("_d is not null").distinct()
    out = out.withColumn("_d", extract_domain(F.col("website"))).join(d, "_d", "left_anti").drop("_d")
    known = old.select(F.explode(normalize_phones(F.col("phones"), r)).alias("_p")).distinct()
    hit = out.select("source_url", F.explode(normalize_phones(F.col("phones"), r)).alias("_p")).join(known, "_p", "left_semi").select("source_url").distinct()
    return out.join(hit, "source_url", "left_anti").select(*new.columns)


def replace_cities(store: Store, rows: DataFrame, cities: tuple[str, ...] = ()) -> int:
    """A new version of the store's raw rows: the cities that rows has, and those named, hold just these rows; others stay. SNK6."""
    return store.replace_parts("raw", rows, "city", cities)


def declared_complete(got: DataFrame, declared: DataFrame, share: float = 0.9) -> DataFrame:
    """(city, n, declared_total, complete): whether a scrape holds enough of what its site declares. SRC3."""
    n = got.groupBy("city").agg(F.count("*").alias("n"))
    j = declared.join(n, "city", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("city", "n", "declared_total", (F.col("n") >= share * F.col("declared_total")).alias("complete"))


def mail_parts(raw: pd.Series) -> pd.DataFrame:
    """Headers and text of raw messages; multipart bodies give their plain parts, delivery reports their status too."""
    out = []
    for text in raw:
        m = message_from_string(text or "", policy=policy.default)
        body = m.get_body(("plain", "html"))
        content = body.get_content() if body else ""
        report = [str(x) for part in m.walk() if part.get_content_type() == "message/delivery-status" for x in part.get_payload()]
        at = m.get("Date").datetime if m.get("Date") is not None else None
        at = at.astimezone(UTC).replace(tzinfo=None) if at is not None and at.tzinfo else at
        out.append((str(m.get("From", "")), str(m.get("To", "")), str(m.get("Subject", "")), "\n".join([content, *report]), at, str(m.get("Auto-Submitted", "no"))))
    out = pd.DataFrame(out, columns=["sender", "recipient", "subject", "body", "at", "auto_submitted"])
    return out.assign(at=pd.to_datetime(out["at"]))


_MAIL = StructType([*(StructField(c, StringType()) for c in ("sender", "recipient", "subject", "body")), StructField("at", TimestampType()), StructField("auto_submitted", StringType())])

#: MIME needs a parser: Arrow batches of raw messages in, structs out. SRC16, X39.
parse_mail = F.pandas_udf(mail_parts, _MAIL)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Landed message files as path, sender, recipient, subject, body, at and auto_submitted."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parse_mail("value").alias("m"))
    return raw.select("path", "m.*")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing files (a JSON object a line) at any path that Spark reads; broken lines are no listings. SRC1."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    x = lines.select(F.from_json("value", RAW + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x")).where("x._broken is null").select("x.*").drop("_broken")
    none = F.array().cast("array<string>")
    return x.withColumn("phones", F.coalesce("phones", none)).withColumn("emails", F.coalesce("emails", none))
