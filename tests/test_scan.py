"""Scans in blocks give what a window over each key gives, and no block of a hot key is much larger than the others."""

import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from leafloom.operators import events as E
from leafloom.operators import scan

CUT = {"pieces": 16, "hot_rows": 100}


@pytest.fixture(scope="module")
def log(spark):
    """One user holds nearly all rows, in bursts, with ties in time; a null user holds many too."""
    rnd = random.Random(4)
    rows, t = [], dt.datetime(2024, 1, 1)
    for k in range(3_000):
        t += dt.timedelta(seconds=rnd.choice([0, 0, 1, 30, 300, 2_000]))
        kind = rnd.choice(["experiment", "dial", "dial", "close", "open", "outcome"] + ["dial"] * 20)
        user = rnd.choice([1] * 20 + [None] * 5 + [2, 3])
        rows.append((user, k, t, kind, rnd.choice(["end", None, "start"]) if kind == "experiment" else None, rnd.choice([None, None, "A1", "B1", "B2"]), rnd.choice([None, None, None, "A", "B"]), rnd.choice([None, None, "d1", "d2"]), rnd.choice(["", "t1"]), rnd.random(), rnd.randint(0, 9), rnd.choice(["s", "t", None])))
    return spark.createDataFrame(rows, "user_id long, seq long, ts timestamp, type string, action string, phase string, condition string, doc_label string, tree_id string, z_to double, k int, section string").repartition(6).cache()


def same(a, b):
    assert a.columns == b.columns
    got, want = (sorted(map(repr, x.collect())) for x in (a, b))
    assert got == want and got


def test_blocks_are_even_and_in_order(log):
    cut = scan.in_blocks(log, ["user_id"], F.col("seq"), **CUT)
    assert cut.hot
    sizes = [r.rows for r in cut.sizes().where("user_id = 1").collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * median(sizes)
    ends = cut.rows.where("user_id = 1").groupBy("_block").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("_block").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    assert cut.rows.where("user_id = 2").select("_block").distinct().count() == 1
    assert not scan.in_blocks(log, ["user_id"], F.col("seq")).hot


def test_carried_state(log):
    same(E.carry_experiment(log, ["user_id"], **CUT), E.carry_experiment(log, ["user_id"]))
    # states that reach over many blocks
    few = log.where("type <> 'experiment' or seq % 100 < 8")
    same(E.carry_experiment(few, ["user_id"], **CUT), E.carry_experiment(few, ["user_id"]))


def test_sessions(log):
    for gap in (0, 60, 1_000, 1e7):
        same(E.sessions(log, "user_id", "ts", gap, **CUT), E.sessions(log, "user_id", "ts", gap))
    same(E.reading_sessions(log, **CUT), E.reading_sessions(log))
    same(E.zoom_history(log, "user_id", "ts", 40.0, **CUT), E.zoom_history(log, "user_id", "ts", 40.0))


def test_as_of(log):
    marks = log.where("seq % 37 = 0").select("user_id", "ts", F.col("k").alias("mark"))
    e = log.select("user_id", "seq", "ts")
    for within in (10, 5_000, 1e9):
        same(E.as_of(e, marks, "user_id", "ts", "mark", within, **CUT), E.as_of(e, marks, "user_id", "ts", "mark", within))


def test_tasks_of_one_hot_user_are_even(spark, log):
    """With one user holding all rows, the partitions of the window over blocks stay within twice the median."""
    one = log.withColumn("user_id", F.lit(1))
    cut = scan.in_blocks(one, ["user_id"], F.col("seq"), pieces=64, hot_rows=100)
    dealt = cut.rows.repartition(8, "user_id", "_block").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) >= 7 and max(sizes) <= 2.5 * median(sizes)
    blocks = [r.rows for r in cut.sizes().collect()]
    assert max(blocks) <= 2 * median(blocks)


def test_no_rows(spark, log):
    none = log.where("false")
    assert E.sessions(none, "user_id", "ts", 5).count() == E.carry_experiment(none, ["user_id"]).count() == 0
