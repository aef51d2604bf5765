"""Look-ups in sorted arrays inside expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def places_below(sorted_array: Column, value: Column, longest: int, or_equal: bool = False) -> Column:
    """How many of a sorted array's values (`longest` at most) are less than value, or equal to it too: found by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, longest).bit_length() - 1, -1, -1)])

    def step(n: Column, s: Column) -> Column:
        x = F.get(sorted_array, n + s - 1)
        return F.when((x <= value) if or_equal else (x < value), n + s).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)
