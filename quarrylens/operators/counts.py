"""Row counts of several frames as one row, from one union instead of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_counts(frames: dict[str, DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, metric, n): counts of every frame, each pre-aggregated."""
    parts = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit(name).alias("metric"), "n")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def spread(tagged: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One column per metric name, zero where a metric has no rows."""
    return tagged.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in names
        ]
    )


def count_rows(**frames: DataFrame) -> DataFrame:
    return spread(tagged_counts(frames), list(frames))


def count_rows_by(keys: tuple[str, ...], frames: dict[str, DataFrame]) -> DataFrame:
    return spread(tagged_counts(frames, keys), list(frames), keys)
