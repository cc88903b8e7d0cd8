"""Exports and snapshots. Survey: SNK1-SNK10, P1-P6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.templates import markdown_escaped
from leadflow.functions.urls import is_safe_link
from leadflow.operators.company_query import preset_filter
from leadflow.plans.ordered import placed


def _yes(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit(False)), "Yes").otherwise("No").alias(c)


def _joined(c: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ").alias(c)


def _messenger(kind: str) -> Column:
    return F.coalesce(F.try_element_at("messengers", F.lit(kind)), F.lit("")).alias(kind)


def csv_rows(companies: DataFrame) -> DataFrame:
    """Rows as exports show them: arrays joined, flags in words, messengers as columns. P3."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return companies.select("id", text("name"), _joined("phones"), text("address"), text("website"), _joined("emails"), *(_messenger(k) for k in ("telegram", "whatsapp", "vk")), text("cms"), _yes("has_marquiz"), _yes("is_network"), "score", "segment", text("city"))


def export_rows(companies: DataFrame, preset: str | None = None) -> DataFrame:
    """Rows with a score, in no order; with a preset also its conditions and no spam. SNK1-SNK3."""
    out = companies.where(F.col("score") > 0)
    if preset is not None:
        out = out.where((F.col("segment") != "spam") | F.col("segment").isNull())
        for c in preset_filter(preset)[0]:
            out = out.where(c)
    return out


#: Rows of a file.
FILE_ROWS = 500_000


def _in_order(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """rows in tasks by ranges of (group, order), so that a group is many tasks and its files, by name, keep the order."""
    by = [*group, *order]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def write_csv(companies: DataFrame, path: str, preset: str | None = None) -> None:
    """One folder of CSV files a city, best rows first over its files by name; each file begins with a byte-order mark and the header. SNK1, SNK5."""
    rows = _in_order(csv_rows(export_rows(companies, preset)), ["city"], [F.desc("score"), "id"])
    write = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).write.mode("overwrite")
    write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("city").option("header", True).csv(path)


def write_csv_presets(companies: DataFrame, path: str, presets: dict[str, str]) -> None:
    """A folder for each preset, by its name. SNK5."""
    for name, filters in presets.items():
        write_csv(companies, f"{path}/{name}", filters)


def _report_rows(companies: DataFrame) -> DataFrame:
    """(city, segment, score, id, line) of a report; unknown and spam segments go to D."""
    seg = F.when(F.col("segment").isin("A", "B", "C"), F.col("segment")).otherwise(F.lit("D"))
    cell = lambda c: markdown_escaped(F.coalesce(c.cast("string"), F.lit("")))
    link = F.when(is_safe_link(F.col("website")), F.concat(F.lit("["), cell(F.col("website")), F.lit("]("), F.col("website"), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), cell(F.col("score")), F.array_join("phones", ", "), F.array_join("emails", ", "), link), F.lit(" |"))
    return companies.select("city", seg.alias("segment"), "score", "id", line.alias("line"))


def markdown_lines(companies: DataFrame) -> DataFrame:
    """(city, segment, pos, line): a report's table rows by segment, best first. SNK4.

    Places come from ranges and their counts: no city is one task, or gathered into one value.
    """
    return placed(_report_rows(companies), ["city", "segment"], [F.desc("score"), "id"]).select("city", "segment", "pos", "line")


def write_markdown(companies: DataFrame, path: str) -> None:
    """A report's lines as text, a folder a city and segment, best first over its files by name. SNK4."""
    lines = _in_order(_report_rows(companies), ["city", "segment"], [F.desc("score"), "id"]).select("city", "segment", F.col("line").alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("city", "segment").text(path)


def conflict_lines(clusters: DataFrame) -> DataFrame:
    """(cluster, pos, label, line) of records in review: labels A to Z, AA and on. SNK7."""
    each = clusters.select("cluster", F.posexplode("records").alias("pos", "r"))
    letter = lambda n: F.char(F.lit(65) + n % 26)
    label = F.when(F.col("pos") < 26, letter(F.col("pos"))).otherwise(F.concat(letter(F.floor(F.col("pos") / 26) - 1), letter(F.col("pos"))))
    line = F.concat_ws(" ", F.lit("- [ ]"), label, F.coalesce("r.name", F.lit("")), F.coalesce("r.address", F.lit("")))
    return each.select("cluster", "pos", label.alias("label"), line.alias("line"))


def write_report(df: DataFrame, path: str) -> None:
    """A result as JSON lines, in as many files as its partitions need. SNK8, SNK9."""
    df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).json(path)


def write_registry(sightings: DataFrame, path: str, least: int = 3) -> None:
    """The registry of domains seen in `least` cities or more (domain, n_cities), as a small table. SNK10."""
    seen = sightings.groupBy(F.lower("domain").alias("domain")).agg(F.countDistinct(F.lower("city")).alias("n_cities")).where(F.col("n_cities") >= least)
    seen.write.mode("overwrite").parquet(path)


def company_card(companies: DataFrame, emails: DataFrame) -> DataFrame:
    """Companies with their active addresses and all addresses as structs, primary first. P1."""
    e = emails.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("o"), "id", "email", "is_active", "is_primary"))).alias("_e")
    ).select(F.col("company_id").alias("id"), "_e")
    none = F.array().cast("array<struct<o:boolean,id:bigint,email:string,is_active:boolean,is_primary:boolean>>")
    j = companies.drop("emails").join(e, "id", "left").withColumn("_e", F.coalesce("_e", none))
    return j.withColumn("emails", F.transform(F.filter("_e", lambda x: x["is_active"]), lambda x: x["email"])).withColumn("company_emails", F.transform("_e", lambda x: F.struct(x["id"].alias("id"), x["email"].alias("email"), x["is_active"].alias("is_active"), x["is_primary"].alias("is_primary")))).drop("_e")


def enrichment_preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after, has_changes): whether the name differs or an array grows. P6, E4."""
    pack = lambda df, name: df.select("id", F.struct("name", "phones", "emails").alias(name))
    j = pack(before, "before").join(pack(after, "after"), "id")
    grew = (F.size("after.phones") > F.size("before.phones")) | (F.size("after.emails") > F.size("before.emails"))
    return j.withColumn("has_changes", ~F.col("before.name").eqNullSafe(F.col("after.name")) | grew)
