"""A query over mail accounts: conversations written as the folder of five mailboxes, read through the mail source, with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.sources import mail
from leafloom.sources.shared import shared_folder

BOXES, SOUGHT = 5, "the"


def mailboxes(conversations: DataFrame) -> DataFrame:
    """(account_id, value): each turn as a provider's message, in one of BOXES accounts: the role writes, the text is subject, snippet and body."""
    text = F.coalesce("text", F.lit(""))
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    body = F.struct(F.translate(F.base64(F.encode(text, "utf-8")), "+/\n\r", "-_").alias("data"))
    payload = F.struct(F.lit("text/plain").alias("mimeType"), F.array(head("From", F.col("role")), head("Subject", F.substring(text, 1, 30))).alias("headers"), body.alias("body"))
    ms = (F.col("turn") * 60_000).cast("string")
    raw = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), ms.alias("internalDate"), F.substring(text, 1, 50).alias("snippet"), payload.alias("payload")))
    return conversations.select(F.concat(F.lit("box "), F.pmod(F.col("conv_id"), F.lit(BOXES)).cast("string")).alias("account_id"), raw.alias("value"))


def mail_by_account(conversations: DataFrame) -> DataFrame:
    """Two accounts' messages whose subject holds a word: how many, from how many writers, and how long they are."""
    spark = conversations.sparkSession
    path = f"{shared_folder(spark)}/mail-{uuid.uuid4().hex}"
    mail.write_folder(mailboxes(conversations), path)
    got = mail.read_mail(spark, path).where(F.col("account_id").isin("box 1", "box 2") & F.contains("subject", F.lit(SOUGHT)))
    return got.groupBy("account_id").agg(F.count("*").alias("messages"), F.count_distinct("sender").alias("writers"), F.sum(F.length("body")).alias("chars"), F.max(F.unix_seconds("date")).alias("latest_s"))


MAIL_SQL = f"""SELECT 'box ' || conv_id % {BOXES} AS account_id, count(*) AS messages, count(DISTINCT role) AS writers, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(max(turn) * 60 AS BIGINT) AS latest_s
FROM conversations WHERE conv_id % {BOXES} IN (1, 2) AND contains(substr(coalesce(text, ''), 1, 30), '{SOUGHT}') GROUP BY 1"""
