"""First and last values in file order, as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_where(value: Column, order: Column, condition: Column | None = None) -> Column:
    """Last non-null ``value`` by ``order`` among rows meeting ``condition``."""
    keep = value.isNotNull() if condition is None else condition & value.isNotNull()
    return F.max_by(value, F.when(keep, order))


def first_where(value: Column, order: Column, condition: Column | None = None) -> Column:
    """First non-null ``value`` by ``order`` among rows meeting ``condition``."""
    keep = value.isNotNull() if condition is None else condition & value.isNotNull()
    return F.min_by(value, F.when(keep, order))
