"""Places of rows in an order over all rows, without a window that holds them all.

Rows are counted by cell, a coarse step of the order; cells by groups of cells. A row's place is the rows of earlier
groups, of earlier cells of its group, and before it in its own cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step(value: Column, bits: int) -> Column:
    """A whole number's place on a scale whose steps widen as it grows: it keeps the order, is exact below 2**bits, and has at most 64 * 2**bits values of either sign."""
    size = F.abs(value.cast("bigint"))
    width = F.length(F.bin(size))
    code = F.shiftleft(width.cast("bigint"), bits) + F.call_function("shiftright", size, F.greatest(F.lit(0), width - bits))
    return F.when(value < 0, -code).otherwise(code)


def cell_starts(rows: DataFrame, by: list[str], cell: str, n: str, bits: Sequence[int]) -> DataFrame:
    """``by``, ``cell`` and ``before``: how many rows of the same ``by`` lie in smaller cells. ``n`` counts the rows that a row stands for.

    Cells that differ in their lowest ``bits[0]`` bits only are one group, groups that differ in the next ``bits[1]`` one group of groups,
    and so on; so a window holds the cells of one group, and the last one the outermost groups of a ``by``.
    """
    cells = rows.groupBy(*by, cell).agg(F.sum(n).alias("n"))
    earlier = lambda keys: F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not bits:
        return cells.withColumn("before", earlier(by or [F.lit(0)])).drop("n")
    group = f"{cell}_"
    cells = cells.withColumn(group, F.shiftright(cell, bits[0]))
    outer = cell_starts(cells, by, group, "n", bits[1:]).withColumnRenamed("before", "outer")
    inside = cells.withColumn("inner", earlier([*by, group]))
    return inside.join(outer, [*by, group]).select(*by, cell, (F.col("outer") + F.col("inner")).alias("before"))
