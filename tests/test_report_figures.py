import math
import random
from itertools import permutations

from pyspark.sql import functions as F

from leafloom.sources.sinks import _figure, report_lines


def test_a_mean_on_a_half_does_not_hang_on_the_order_of_its_values(spark):
    told, rng = set(), random.Random(5)
    for k in range(2000):
        v = [rng.randrange(601) / 6 for _ in range(4)]
        sixths = sum(round(x * 6) for x in v)
        if 5 * sixths % 12 != 6:  # no half
            continue
        means = {(((a + b) + c) + d) / 4 for a, b, c, d in permutations(v)}
        told |= {(k, m, (5 * sixths + 6) // 12) for m in means}
    assert len(told) > len({k for k, _, _ in told})  # some means differ by their order
    got = spark.createDataFrame([(m, t) for _, m, t in told], "m double, t long").select(_figure(F.col("m")).alias("f"), "t")
    want = F.concat(F.floor(F.col("t") / 10).cast("string"), F.when(F.col("t") % 10 > 0, F.concat(F.lit("."), F.col("t") % 10)).otherwise(""))
    assert got.where(F.col("f") != want).collect() == []


def test_a_median_is_rounded_as_it_stands(spark):
    said = [(k / 100 + (k + d) / 100) / 2 for k in range(4000, 5000) for d in (2, 8, 10)]
    off = [m for m in said if abs(m * 10 % 1 - 0.5) < 1e-6 and m * 10 % 1 != 0.5]
    assert any(m * 10 % 1 < 0.5 for m in off)  # some halves lie a last bit too low
    figures = spark.createDataFrame([(m,) for m in said], "m double")
    lines = figures.select(
        "m", F.lit("A1").alias("phase"), F.lit("A").alias("condition"), F.lit(2).alias("documents"), F.lit(1).alias("sessions"), F.col("m").alias("minutes_to_know_median"),
        *[F.lit(0.5).alias(c) for c in ("checklist_score_mean", "tlx_raw_mean", "minutes_to_first_action_median")],
        *[F.lit(2).alias(f"{c}_n") for c in ("minutes_to_know", "checklist_score", "tlx_raw", "minutes_to_first_action")],
        *[F.lit(0).alias(f"{c}_{x}") for c in ("started_within_24h", "missed_later", "did_it_help") for x in ("yes", "no")],
    )
    got = report_lines(lines, ["m"]).select("m", F.regexp_extract("text", r"know what to do: median ([0-9.]+)", 1).cast("double").alias("f")).collect()
    assert [(m, f) for m, f in got if f != math.floor(m * 10 + 0.5) / 10] == []
