"""Spreading rows that are expensive to work on over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 1 << 16


def spread_rows(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    One document is a single task however many cores wait.  Where the input has enough splits of
    its own, nothing is moved.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *columns)


def spread_file_rows(df: DataFrame, *columns: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows of files over the cores, at most about ``task_rows`` in a task.

    A file has as many splits as its size asks for, but all rows of a row group are in one of
    them, so rows are counted for each split, which reads no column.  Where no split holds much
    more than its part, nothing is moved.
    """
    held = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total, most = held.agg(F.sum("n"), F.max("n")).first()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // task_rows))
    return df if (most or 0) <= 2 * (total or 0) / wanted else df.repartition(wanted, *columns)


def spread_counted(df: DataFrame, rows: int, *columns: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, counted to have so many ``rows``, by ``columns`` over tasks of about ``task_rows`` of them.

    Adaptive execution bounds the compressed bytes of a task, which may be any number of rows.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return df.repartition(wanted, *columns)
