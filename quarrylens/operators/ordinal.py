"""Dense ordinals and running sums inside keys that may hold most of the data.

A window over a hot key sorts that key in one task.  Both forms here first split
the key into bounded cells, number rows inside each cell, and add the size of the
cells before it; only cell totals meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

CELL_ROWS = 1 << 20


def _number_cells(df: DataFrame, keys: Sequence[str], cell: str, order: list, name: str):
    totals = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    )
    base = totals.select(
        *keys, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside)).join(base, [*keys, cell])
    return numbered.withColumn(name, (F.col("_base") + F.col("_rn") - 1).cast("bigint")).drop(
        "_base", "_rn", cell
    )


def ordinal_by_unique(
    df: DataFrame, keys: Sequence[str], column: str, name: str, cell_width: int = CELL_ROWS
) -> DataFrame:
    """0-based position by an integer ``column`` that is unique inside the keys.

    A cell of ``cell_width`` consecutive values holds at most that many rows.
    """
    cells = df.withColumn("_cell", F.floor(F.col(column) / cell_width))
    return _number_cells(cells, keys, "_cell", [F.col(column)], name)


def ordinal_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """0-based position by any total order, through a range partitioning.

    The partitioned rows are written once, so the partition of a row cannot change
    between counting and numbering.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
        "_cell", F.spark_partition_id()
    )
    return _number_cells(cut(ranged), keys, "_cell", list(order), name)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "_rank"
) -> DataFrame:
    """First ``k`` rows per key; Spark limits each partition before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
