"""Equi joins of two sides that both grow with the input.

Spark broadcasts a side whose estimated size is small, and the estimate is a guess: it takes
2 KB for every VARIANT, so a plan that drops one looks tens of times smaller than its rows,
and a checkpoint keeps the guess of the plan it was made by.  A side of millions of rows is
then collected on the driver.  These joins say that both sides are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_ROWS = 4096


def shuffle_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` with neither side broadcast; skewed keys are split by adaptive execution."""
    return left.join(right.hint("merge"), list(on) if isinstance(on, list | tuple) else on, how)


def counted_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, rows: int, how: str = "inner") -> DataFrame:
    """The same, for a ``right`` of a known number of ``rows``: a few are sent to every task instead."""
    if rows > FEW_ROWS:
        return shuffle_join(left, right, on, how)
    return left.join(F.broadcast(right), list(on) if isinstance(on, list | tuple) else on, how)
