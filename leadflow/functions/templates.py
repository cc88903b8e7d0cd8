"""Message templates, export text and mail headers. Survey: X37, X39, X40, X43, X44, SRC15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(template: Column, values: dict[str, Column], html: bool = False) -> Column:
    """template with each {key} replaced by its value (null: empty); values are escaped in HTML."""
    for k, v in values.items():
        v = F.coalesce(v.cast("string"), F.lit(""))
        template = F.replace(template, F.lit(f"{{{k}}}"), html_escaped(v) if html else v)
    return template


def markdown_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([|\\`*_\[\]<>])", r"\\$1")


def capitalised_city(c: Column) -> Column:
    """Each part of a hyphenated name with a capital."""
    return F.array_join(F.transform(F.split(F.lower(F.trim(c)), "-"), F.initcap), "-")


def header_email(h: Column) -> Column:
    """Address of a From header, lower-cased, null without one."""
    e = F.lower(F.regexp_extract(h, r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", 1))
    return F.when(e != "", e)


def dsn_code(text: Column) -> Column:
    """Status code of a delivery report, null without one."""
    c = F.regexp_extract(text, r"\b([245]\.\d{1,3}\.\d{1,3})\b", 1)
    return F.when(c != "", c)


def final_recipient(text: Column) -> Column:
    e = F.lower(F.regexp_extract(text, r"(?im)^Final-Recipient:\s*rfc822;\s*<?([^\s>]+)", 1))
    return F.when(e != "", e)


def is_bounce(sender: Column, subject: Column) -> Column:
    return F.coalesce(F.lower(sender).rlike("mailer-daemon|postmaster"), F.lit(False)) | F.coalesce(F.lower(subject).rlike("undeliver|delivery status|failure notice|returned mail"), F.lit(False))


def is_out_of_office(subject: Column, headers: Column) -> Column:
    auto = F.lower(F.coalesce(F.try_element_at(headers, F.lit("Auto-Submitted")), F.lit("no")))
    return (auto != "no") | F.coalesce(F.lower(subject).rlike("out of office|automatic reply|autoreply|автоответ|вне офиса"), F.lit(False))


def retry_count(note: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(note, F.lit("")), r"\[retry:(\d+)\]", 1).try_cast("int"), F.lit(0))


def with_retry(note: Column, n: Column) -> Column:
    """note with its retry mark replaced by n."""
    return F.trim(F.concat_ws(" ", F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s*\[retry:\d+\]", "")), F.concat(F.lit("[retry:"), n.cast("string"), F.lit("]"))))


def error_kind(message: Column) -> Column:
    """network, parsing or data."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("timeout|connection|network|ssl|dns"), "network").when(m.rlike("403|captcha|blocked|parse|json"), "parsing").otherwise("data")


def template_problems(templates: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """(name, problem) of templates (name, subject, body): missing or repeated names, missing required ones. SRC15."""
    none = templates.where(F.trim(F.coalesce("name", F.lit(""))) == "").select("name", F.lit("no_name").alias("problem"))
    twice = templates.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("repeated").alias("problem"))
    want = templates.sparkSession.createDataFrame([(r,) for r in required], "name string")
    gone = want.join(templates.select("name").distinct(), "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    return none.union(twice).union(gone)
