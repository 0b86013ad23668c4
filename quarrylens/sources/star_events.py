"""The star-schema test tables seen as trace events, so trace operators run on them.

Every row of ``events`` becomes one trace event.  A *mapping* names the trace event
each event type stands for and builds its ``args``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.spreading import spread_file_rows

MICROS_PER_MINUTE = 60_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become documents or events, spread by its first column."""
    rows = read_table(spark, sf_dir, name)
    return spread_file_rows(rows, rows.columns[0])


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    seconds = F.unix_date(F.to_date(ts)) * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds.cast("bigint") * 1_000_000 + (
        F.extract(F.lit("SECOND"), ts) * 1_000_000
    ).cast("bigint")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rawIndex, trace_id, pid, tid, uid, ts, minutes, et, k."""
    return spread_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rawIndex"),
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("trace_id"),
        (F.col("user_id") % 8).alias("pid"),
        (F.col("user_id") % 16).alias("tid"),
        F.col("user_id").alias("uid"),
        epoch_micros(F.col("ts")).alias("ts"),
        F.round(F.col("value") * MICROS_PER_MINUTE).cast("bigint").alias("span"),
        F.col("value"),
        F.col("event_type").alias("et"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def by_type(values: Mapping[str, Column | str]) -> Column:
    """A value per event type, NULL for the others."""
    out = None
    for et, value in values.items():
        column = F.lit(value) if isinstance(value, str) else value
        test = F.col("et") == et
        out = F.when(test, column) if out is None else out.when(test, column)
    return out


def trace_of(
    spark: SparkSession,
    sf_dir: str,
    names: Mapping[str, str],
    phases: Mapping[str, str],
    args: Callable[[], Column],
    *,
    cat: Callable[[], Column] | None = None,
    name: Callable[[], Column] | None = None,
    event_id: Callable[[], Column] | None = None,
    scope: Callable[[], Column] | None = None,
) -> DataFrame:
    """An events frame; only slices (phase X) have a duration."""
    text = F.lit(None).cast("string")
    phase = by_type(phases)
    # Unpacking from an array keeps the built value from being copied into every
    # expression that reads it.
    packed = F.explode(F.array(F.to_variant_object(args()))).alias("args")
    return base_rows(spark, sf_dir).select(
        "trace_id",
        "rawIndex",
        (cat() if cat else F.lit("devtools.timeline")).alias("cat"),
        (name() if name else by_type(names)).alias("name"),
        phase.alias("ph"),
        "pid",
        "tid",
        "ts",
        F.when(phase == "X", F.col("span")).alias("dur"),
        (event_id() if event_id else text).cast("variant").alias("id"),
        (scope() if scope else text).cast("variant").alias("s"),
        packed,
    )
