"""Neighbours in an order within keys, without gathering a key's rows in one task.

The order column is cut into a bounded number of blocks at sketched quantiles. Windows run within
(key, block); what crosses a block comes from one row per key and block.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a block may hold of one key, and the bounds of the number of blocks.
BLOCK_ROWS, LEAST, MOST = 1 << 20, 8, 1 << 10


def boundaries(df: DataFrame, order: Column, blocks: int | None = None) -> list[Any]:
    """Cuts of ``order`` into blocks of about BLOCK_ROWS rows; they steer the load, never the result.

    One partial aggregation counts the rows and sketches MOST quantiles, of which evenly spaced ones are
    kept; ``blocks`` overrides their number.
    """
    row = df.agg(F.count(order).alias("n"), F.percentile_approx(order, [i / MOST for i in range(1, MOST)], 4 * MOST).alias("c")).first()
    every = row["c"] or []
    blocks = blocks or min(MOST, max(LEAST, 1 << (row["n"] // BLOCK_ROWS).bit_length()))
    return sorted({every[i * MOST // blocks - 1] for i in range(1, blocks)}) if every else []


def block_of(order: Column, cuts: list[Any]) -> Column:
    """Number of the block in which a value lies: how many cuts are below it, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order > F.lit(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts)).cast("int")
