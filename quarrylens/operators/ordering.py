"""Orderings written as names: ``-name`` descending, ``#name`` as a number."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(name: str) -> Column:
    if name.startswith("-"):
        return F.col(name[1:]).desc_nulls_last()
    if name.startswith("#"):
        return F.col(name[1:]).try_cast("double").asc_nulls_first()
    return F.col(name).asc_nulls_first()


def ordering(names: Iterable[str]) -> tuple[Column, ...]:
    return tuple(_key(name) for name in names)
