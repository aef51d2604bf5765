"""Exact medians of groups of any size, by narrowing ranges.

F.median keeps every distinct value of a group in one task's memory. Here a group is first only its count, least and largest value. Then
its range is cut into PIECES, each counted with its own least and largest value before anything is moved, and the piece that holds the
middle rank is the next range, until it holds one value. A pass over the rows narrows the range by the number of pieces: numbers of any
size take nine passes at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.sources.shared import written

PIECES, BROADCAST_GROUPS = 4096, 100_000


def _piece(v: Column, lo: Column, hi: Column, pieces: int) -> Column:
    """Which part of [lo, hi] v lies in: signs are told apart first, then zero, then a wide range of one sign by logarithms, then evenly.
    It never falls as v rises, lo is in the first part and hi in the last."""
    part = lambda x, a, b: F.least(F.lit(pieces - 1), F.floor((x - a) / (b - a) * pieces))
    size = lambda x: F.log(F.abs(x))
    wide = F.greatest(F.abs(lo), F.abs(hi)) / 4 > F.least(F.abs(lo), F.abs(hi))
    by_size = F.when(lo > 0, part(size(v), size(lo), size(hi))).otherwise(part(-size(v), -size(lo), -size(hi)))
    two = lambda c: F.when(c, 0).otherwise(pieces - 1)
    return F.when((lo < 0) & (hi >= 0), two(v < 0)).when(lo == 0, two(v == 0)).when(wide, by_size).otherwise(part(v / 2, lo / 2, hi / 2)).cast("int")


def exact_medians(rows: DataFrame, by: list[str], value: str, pieces: int = PIECES) -> DataFrame:
    """(by, n, median) of a column's values that are finite; for an even number the mean of the two in the middle.

    Groups without such a value are left out. Null keys are a group of their own.
    """
    x = rows.select(*by, F.col(value).cast("double").alias("_v")).where("abs(_v) < double('infinity')")
    every = written(x.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    # two middle ranks, from 1, of which an odd number has the same twice
    ranks = F.array(*[F.struct(F.lit(w).alias("_w"), F.expr(f"(n + {w}) div 2").alias("_r")) for w in (1, 2)])
    now = every.select(*by, "_lo", "_hi", F.inline(ranks))
    while True:
        now = written(now, "ranges")
        wide = now.where("_lo < _hi")
        left = wide.count()
        if not left:
            break
        t = wide.withColumnsRenamed({c: f"_t{k}" for k, c in enumerate(by)})
        t = F.broadcast(t) if left <= BROADCAST_GROUPS else t
        on = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for k, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"_t{k}"))
        piece = _piece(F.col("_v"), F.col("_lo"), F.col("_hi"), pieces)
        cut = x.join(t, on).groupBy(*by, "_w", "_r", piece.alias("_p")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = cut.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "_w").orderBy("_p")))  # PIECES rows of a group
        held = upto.where("_upto >= _r and _upto - _n < _r").select(*by, "_lo", "_hi", "_w", (F.col("_r") - F.col("_upto") + F.col("_n")).alias("_r"))
        now = now.where("_lo >= _hi").select(*by, "_lo", "_hi", "_w", "_r").unionByName(held)
    return now.groupBy(*by).agg(F.avg("_lo").alias("median")).alias("m").join(every.alias("g"), [F.col(f"m.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]).select(*[F.col(f"g.{c}") for c in by], "n", "median")
