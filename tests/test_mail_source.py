"""The mail source over folders made from conversations: partitions, pushed filters, and streams with offsets."""

import base64

import pytest
from pyspark.sql import functions as F

from leafloom.plans import mail_queries
from leafloom.sources import mail


def messages(spark, sf):
    """Mailboxes, with what each message was made from."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return mail_queries.mailboxes(c.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("m", F.try_parse_json("value")).selectExpr(
        "account_id", "value", "variant_get(m, '$.id', 'string') AS id", "variant_get(m, '$.payload.headers[0].value', 'string') AS role", "decode(unbase64(translate(variant_get(m, '$.payload.body.data', 'string'), '-_', '+/')), 'utf-8') AS text"
    )


@pytest.fixture(scope="module")
def box(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mail"))
    mail.write_folder(messages(spark, sf), path)
    return path


def test_all_accounts(spark, sf, box):
    got = mail.read_mail(spark, box)
    assert got.columns == ["account_id", "id", "sender", "subject", "date", "snippet", "body"] and got.rdd.getNumPartitions() == 5
    want = sorted((r.account_id, r.id, r.role, r.text) for r in messages(spark, sf).collect())
    assert sorted((r.account_id, r.id, r.sender, r.body) for r in got.collect()) == want


def test_pushed_filters(spark, sf, box):
    every = mail.read_mail(spark, box).cache()
    one = mail.read_mail(spark, box).where("account_id = 'box 3'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == every.where("account_id = 'box 3'").count() > 0
    two = mail.read_mail(spark, box).where(F.col("account_id").isin("box 1", "box 2", "none") & F.contains("subject", F.lit("the")))
    assert two.rdd.getNumPartitions() == 2
    assert sorted(r.id for r in two.collect()) == sorted(r.id for r in every.where("account_id in ('box 1', 'box 2') and contains(subject, 'the')").collect())
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan.split("BatchScan")[0]
    some = every.first()
    found = mail.read_mail(spark, box).where((F.col("account_id") == some.account_id) & (F.col("id") == some.id)).collect()
    assert [r.body for r in found] == [some.body]
    assert mail.read_mail(spark, box).where("account_id = 'box 1' and account_id = 'box 2'").count() == 0
    assert mail.read_mail(spark, box).where("id = 'no such'").count() == 0


def test_what_is_no_message_is_passed_over(spark, tmp_path):
    home = tmp_path / "account_id=a"
    home.mkdir()
    text = base64.urlsafe_b64encode("<p>Hé</p>".encode()).decode()
    (home / "x.txt").write_text('not json\n[1]\n{"id": "1"}\n{"id": "2", "payload": {"parts": [{"mimeType": "text/html", "body": {"data": "%s"}}]}}\n' % text)
    got = {r.id: r.body for r in mail.read_mail(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2"} and got["2"].strip() == "Hé" and got["1"] == ""


def test_stream_takes_what_is_new(spark, sf, tmp_path):
    path, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), messages(spark, sf)
    parts = [seen.where("account_id <= 'box 1'"), seen.where("account_id >= 'box 1'")]
    counts = []
    for part in parts:
        mail.write_folder(part, path)
        q = mail.stream_mail(spark, path).select("account_id", "id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts == [parts[0].count(), parts[0].count() + parts[1].count()]
