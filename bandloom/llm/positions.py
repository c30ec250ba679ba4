"""Running sums inside groups of any size, without one group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys are the first 15 hexadecimal digits of a digest.
KEY_BITS = 60
CELL_ROWS = 256


def order_key(*parts: Column) -> Column:
    """A seeded place in [0, 2^60) from the values of `parts`; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cell_widths(rows: int) -> list[int]:
    """Key bits of the cells, coarse to fine, so that a cell holds about CELL_ROWS rows.

    The depth grows with the logarithm of the rows; the widest group needs at most
    the square root of its cells in one task of the upper level.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1) / CELL_ROWS)))
    return [bits // 2, bits] if bits > 1 else []


def running_sum(
    df: DataFrame, group: Sequence[str], key: str, value: str, out: str, widths: Sequence[int], ties: Sequence[str] = ()
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group that come before by (key, ties).

    Rows are dealt by the leading bits of the key. Sums of the cells are added up
    first (recursively over `widths`), so a group that holds most of the table is
    spread like any other.
    """
    group = list(group)
    if not widths:
        before = Window.partitionBy(*group).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint")))
    level, shift = len(widths), KEY_BITS - widths[-1]
    cell, amount, at, start = (f"_{name}{level}" for name in ("cell", "amount", "at", "start"))
    df = df.withColumn(cell, F.shiftright(key, shift))
    cells = df.groupBy(*group, cell).agg(F.sum(value).alias(amount)).withColumn(at, F.shiftleft(cell, shift))
    starts = running_sum(cells, group, at, amount, start, widths[:-1]).select(*group, cell, start)
    inside = Window.partitionBy(*group, cell).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.join(starts, [*group, cell])
    summed = summed.withColumn(out, F.col(start) + F.coalesce(F.sum(value).over(inside), F.lit(0).cast("bigint")))
    return summed.drop(cell, start)
