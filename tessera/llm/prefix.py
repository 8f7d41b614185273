"""Running sums inside groups of any size without one task per group.

A group is cut into cells that follow its order; sums inside a cell need
only that cell's rows, and a cell's offset comes from the table of cell
totals, which is summed in two steps (cells of a band, then bands of the
group), so no task sees more than one band's cells or one group's bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import same


def prefix_sum(df: DataFrame, group: list[str], band: list[str], cell: list[str],
               order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (a long) over the rows of the same
    ``group`` up to and including this one, in the order (band, cell, order).

    ``band`` and ``cell`` must be monotone in the wanted order.  ``df`` is
    read twice, so it should be a stored table.  Rows equal in every order
    column take their places in any order.
    """
    keys = [*group, *band, *cell]
    rows_so_far = Window.unboundedPreceding, Window.currentRow
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    in_band = Window.partitionBy(*group, *band).orderBy(*cell).rowsBetween(*rows_so_far)
    cells = totals.withColumn("__cell_start", F.sum("__total").over(in_band) - F.col("__total"))
    bands = totals.groupBy(*group, *band).agg(F.sum("__total").alias("__band_total"))
    in_group = Window.partitionBy(*group).orderBy(*band).rowsBetween(*rows_so_far)
    bands = bands.withColumn("__band_start",
                             F.sum("__band_total").over(in_group) - F.col("__band_total"))
    starts = cells.join(bands, same(cells, bands, [*group, *band])).select(
        *[cells[k] for k in keys],
        (F.col("__cell_start") + F.col("__band_start")).alias("__start"))
    in_cell = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows_so_far)
    local = df.withColumn("__local", F.sum(value).over(in_cell))
    return local.join(starts, same(local, starts, keys)).select(
        *[local[c] for c in df.columns], (F.col("__local") + F.col("__start")).alias(out))
