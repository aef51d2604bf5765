"""Running values over the ordered rows of each key, where one key may hold most of the table.

A window sorts a key in one task. Here the rows of a key that holds too many are first cut into blocks of about equal size at
quantiles of what orders them. A block is folded to one row, the rows of a key's blocks are scanned (there are no more than PIECES
of them), and every block starts from what the blocks before it leave. Windows then run over (key, block). That needs values that
can be folded: sums, last and largest values, and state changes, which compose.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafloom.functions.ordered import places_below

#: Blocks of a hot key at most, and rows that any task takes without being cut.
PIECES, HOT_ROWS = 256, 1_000_000


def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of few (a row for a key at most, and few enough to broadcast), null keys being equal."""
    names = {k: f"_of_{k}" for k in keys}
    few = few.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & rows[k].eqNullSafe(few[n])
    return rows.join(F.broadcast(few), on, "left").drop(*names.values())


@dataclass
class Blocks:
    """rows with `_block`: 0 where a key is not cut, else blocks in order. `hot`: whether any key is cut."""

    rows: DataFrame
    by: list[str]
    hot: bool

    def windows(self, *order) -> WindowSpec:
        return Window.partitionBy(*self.by, "_block").orderBy(*order)

    def sizes(self) -> DataFrame:
        return self.rows.groupBy(*self.by, "_block").agg(F.count("*").alias("rows"))

    def carried(self, rows: DataFrame, folded: list[Column], scan: Callable[[DataFrame, WindowSpec], DataFrame], *made: str) -> DataFrame:
        """rows (those of this table with more columns) with the columns `made`, which scan() makes of the folded blocks, given a key's blocks in order.

        Only cut keys have folded rows: PIECES + 1 for each at most, and no more hot keys than twice the partitions, so they are
        broadcast. All is null for other keys.
        """
        if not self.hot:
            return rows.withColumns({n: F.lit(None) for n in made})
        few = rows.where("_cut").groupBy(*self.by, "_block").agg(*folded)
        return beside(rows, scan(few, Window.partitionBy(*self.by).orderBy("_block")).select(*self.by, "_block", *made), [*self.by, "_block"])


def in_blocks(rows: DataFrame, by: list[str], at: Column, pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> Blocks:
    """Blocks of rows by `at`, a long that orders a key's rows; rows of one key at one `at` stay together, and null comes first.

    A key is cut if it has more than hot_rows rows and more than the share of half a task. The counts are a job of their own; the
    bounds of the hot keys (never more keys than twice the partitions) come to the driver, so that every use of the rows cuts alike.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*by).agg(F.count("*").alias("_rows"))
    total, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    least = max(hot_rows, (total or 0) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= least:
        return Blocks(rows.withColumns({"_cut": F.lit(False), "_block": F.lit(0)}), by, False)
    hot = counts.where(F.col("_rows") > least).select(*by, F.lit(True).alias("_hot"))
    shares = [k / pieces for k in range(1, pieces)]
    held = beside(rows.withColumn("_at", at), hot, by).where("_hot")
    bounds = held.groupBy(*by).agg(F.percentile_approx("_at", shares, 20 * pieces).alias("_bounds"))
    kept = spark.createDataFrame(bounds.collect(), bounds.schema)
    below = places_below(F.col("_bounds"), F.col("_at"), pieces)
    out = beside(rows.withColumn("_at", at), kept, by).withColumn("_cut", F.col("_bounds").isNotNull())
    return Blocks(out.withColumn("_block", F.when(F.col("_cut"), below).otherwise(0)).drop("_bounds", "_at"), by, True)


def before(w: WindowSpec) -> WindowSpec:
    """The blocks before."""
    return w.rowsBetween(Window.unboundedPreceding, -1)
