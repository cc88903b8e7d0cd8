"""Landed mail as a stream whose effects are applied once. Survey: ST1, SRC16, T8, T9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadflow.functions.templates import dsn_code, final_recipient, header_email, is_bounce, is_out_of_office
from leadflow.operators.effects import bounce_effects, reply_effects
from leadflow.sources.landed import parse_mail
from leadflow.sources.snapshots import Store

#: Tables of the store that mail changes.
TABLES = ("logs", "campaigns", "contacts", "tasks", "touches")


def mail_kind(sender: Column, subject: Column, headers: Column) -> Column:
    """bounce, absence (an automatic answer) or reply."""
    return F.when(is_bounce(sender, subject), "bounce").when(is_out_of_office(subject, headers), "absence").otherwise("reply")


def classified(mail: DataFrame) -> DataFrame:
    """(path, kind, email, code, at, subject, body) of parsed mail: email is who bounced, else who wrote.

    A bounce without a status code counts as one of an unknown mailbox; mail without an address is left out.
    """
    kind = mail_kind(F.col("sender"), F.col("subject"), F.create_map(F.lit("Auto-Submitted"), F.coalesce("auto_submitted", F.lit("no"))))
    email = F.when(F.col("kind") == "bounce", final_recipient(F.col("body"))).otherwise(header_email(F.col("sender")))
    out = mail.withColumn("kind", kind).withColumn("email", email).withColumn("code", F.coalesce(dsn_code(F.col("body")), F.lit("5.1.1")))
    return out.where("email is not null").select("path", "kind", "email", "code", "at", "subject", "body")


def mail_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Message files of a folder, each once, as they come: the query's checkpoint knows those that were seen. SRC16."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), parse_mail("value").alias("m")).select("path", "m.*")


def apply_mail(store: Store, mail: DataFrame, batch: int, source: str = "mail") -> bool:
    """Bounces and replies of one batch as one new version of the store's tables; False if the batch is in already.

    The version carries the number of the last batch of its source, so the batch and its mark come in together or not at
    all: a batch that is run again after a crash finds either nothing or its mark.
    """
    base = store.manifest()
    if base["applied"].get(source, -1) >= batch:
        return False
    logs, campaigns, contacts, tasks, touches = (store.read(t, base["version"]) for t in TABLES)
    seen = classified(mail)
    logs, campaigns, contacts = bounce_effects(logs, campaigns, contacts, seen.where("kind = 'bounce'").select("email", "code", "at"))
    after = reply_effects(logs, campaigns, contacts, tasks, seen.where("kind = 'reply'").select("email", "at", "subject", "body"))
    after["touches"] = touches.unionByName(after["touches"], allowMissingColumns=True)
    store.put(after, applied={source: batch}, base=base)
    return True


def follow_mail(store: Store, mail: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of mail to a store, each batch once; trigger as in DataStreamWriter.trigger. ST1."""

    def each(batch: DataFrame, number: int) -> None:
        apply_mail(store, batch, number)

    return mail.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 hour"})).start()
