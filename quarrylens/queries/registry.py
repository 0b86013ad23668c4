"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# The events table as trace events, in SQL; the same as star_events.base_rows.
EVENTS = """e AS (
  SELECT event_id AS idx, 'u' || (user_id % 4) AS trace_id, user_id % 8 AS pid,
         user_id % 16 AS tid, user_id AS uid, epoch_us(ts) AS ts,
         CAST(round(value * 60000000) AS BIGINT) AS span, value, event_type AS et,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def with_events(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{EVENTS}{sql}"
