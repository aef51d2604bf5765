"""Streams over five micro-batches give what the batch forms give over the whole table, and forget who is idle."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from leafloom.operators import events as E
from leafloom.plans import catalog, log_queries
from leafloom.streaming import live

DAYS = 24 * live.HOUR_MS
NEVER = 4_000 * DAYS


@pytest.fixture(scope="module")
def log(spark, sf):
    """The events table read as a log, with times."""
    times = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    return catalog._log(spark, sf).select("user_id", "seq", "type", "action", "phase", "condition", "doc_label", "tree_id").join(times, "seq").cache()


@pytest.fixture(scope="module")
def fed(spark, log, tmp_path_factory):
    """The log as a stream of five files in the order of time, and two last events that move the watermark on."""
    path = tmp_path_factory.mktemp("feed")
    rows = [r.asDict() for r in log.orderBy("ts", "seq").collect()]
    assert [r["seq"] for r in rows] == sorted(r["seq"] for r in rows)  # the table's ids rise with time
    rows = [{**r, "ts": r["ts"].strftime("%Y-%m-%d %H:%M:%S.%f")} for r in rows]
    size = -(-len(rows) // 5)
    for k in range(5):
        (path / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k * size : (k + 1) * size])))
    for k in (5, 6):  # the watermark that the sixth file sets holds from the seventh on
        (path / f"{k}.json").write_text(json.dumps({**rows[-1], "user_id": -1, "type": "dial", "event_type": "view", "seq": 10**9 + k, "ts": f"209{k}-01-01 00:00:00"}))
    for k in range(7):  # files come in the order of their times
        os.utime(path / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    schema = "user_id long, seq long, type string, action string, phase string, condition string, doc_label string, tree_id string, ts timestamp, value double, event_type string"
    return lambda: live.event_stream(spark, str(path), schema, files_per_trigger=1)


def run(spark, stream, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    q = live.append_to(stream, out, checkpoint)
    q.awaitTermination()
    return spark.read.parquet(out), q.recentProgress


def same(got, want):
    cols = want.columns
    a, b = (sorted(map(repr, x.select(cols).collect())) for x in (got, want))
    assert a == b and a


def state_rows(progress):
    return [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]


def test_carried_state(spark, log, fed, tmp_path):
    got, progress = run(spark, live.carry_stream(fed(), ts="ts", idle_ms=NEVER), tmp_path)
    want = E.carry_experiment(log, ["user_id"]).select("user_id", "seq", "type", "phase_of", "condition_of", "label_of")
    assert len(progress) >= 6
    same(got.where("user_id >= 0"), want)


def test_idle_users_are_forgotten(spark, fed, tmp_path):
    _, progress = run(spark, live.carry_stream(fed(), ts="ts", idle_ms=1), tmp_path)
    kept = state_rows(progress)
    assert max(kept) > 0 and kept[-1] <= 2  # what the last events' own user may hold


def test_state_may_end_by_the_clock(spark, log, fed, tmp_path):
    want = log.where("type <> 'experiment'").count() + 2
    q = live.append_to(live.carry_stream(fed(), ttl_ms=live.HOUR_MS), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "1 second")
    try:
        for _ in range(60):  # by the clock there is always another batch: it is stopped once all is told
            time.sleep(1)
            if sum(p.numInputRows for p in q.recentProgress) >= log.count() + 2:
                break
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_latest_mark(spark, log, fed, tmp_path):
    is_mark = F.col("event_type") == "signup"
    got, progress = run(spark, live.as_of_stream(fed(), is_mark, F.col("value")), tmp_path)
    marks = log.where(is_mark).select("user_id", "ts", "value")
    want = E.as_of(log.where(~is_mark).select("user_id", "seq", "ts"), marks, "user_id", "ts", "value", 4 * 3_600).select("user_id", "seq", "value")
    same(got.where("user_id >= 0").select("user_id", "seq", F.when(~F.isnan("value"), F.col("value")).alias("value")), want)
    assert state_rows(progress)[-1] <= 2


def test_sessions(spark, log, fed, tmp_path):
    kind = log_queries._kind()
    z = F.col("seq") % 100 / 100
    got, progress = run(spark, live.reading_session_stream(fed().withColumns({"type": kind, "z_to": z}), idle_ms=NEVER // 4), tmp_path)
    want = E.reading_sessions(log.withColumns({"type": kind, "z_to": z}))
    same(got.where("user_id >= 0").selectExpr("user_id", "island", "session_ms", "first_zoom_ms", "source_checks", "max_z"), want.selectExpr("user_id", "island", "cast(session_ms as double) session_ms", "cast(first_zoom_ms as double) first_zoom_ms", "source_checks", "max_z"))
    assert state_rows(progress)[-1] <= 2


def test_a_batch_is_written_once(spark, log, fed, tmp_path):
    out = str(tmp_path / "kept")
    live.write_once(fed().select("user_id", "seq"), out, str(tmp_path / "checkpoint")).awaitTermination()
    every = live.read_batches(spark, out)
    assert every.count() == log.count() + 2 and every.select("batch").distinct().count() == 7
    again = every.where("batch = 2").drop("batch")
    assert not live.put_batch(again.unionAll(again), 2, out)  # noted: the same batch again changes nothing
    assert live.read_batches(spark, out).count() == log.count() + 2
    # a batch that was written but not noted is no reader's, and is written anew
    again.write.parquet(f"{out}/data/batch=7")
    assert live.read_batches(spark, out).count() == log.count() + 2
    assert live.put_batch(again, 7, out) and live.read_batches(spark, out, after=6).count() == again.count()
    with pytest.raises(ValueError):
        live.read_batches(spark, out, after=7)

