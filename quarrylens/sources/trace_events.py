"""Trace documents to one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p


def event_columns(event: Column) -> list[Column]:
    """Typed columns of one event held as VARIANT."""
    return [
        p.v_str(event, "$.cat").alias("cat"),
        p.v_str(event, "$.name").alias("name"),
        p.v_str(event, "$.ph").alias("ph"),
        p.v_long(event, "$.pid").alias("pid"),
        p.v_long(event, "$.tid").alias("tid"),
        p.v_num(event, "$.ts").alias("ts"),
        p.v_num(event, "$.dur").alias("dur"),
        F.try_variant_get(event, "$.id", "variant").alias("id"),
        F.try_variant_get(event, "$.s", "variant").alias("s"),
        F.try_variant_get(event, "$.args", "variant").alias("args"),
    ]


def trace_events(documents: DataFrame) -> DataFrame:
    """Events of documents that are an event array or hold ``traceEvents``."""
    doc = F.col("doc")
    items = F.coalesce(p.v_array(doc, "$"), p.v_array(doc, "$.traceEvents"))
    exploded = documents.select("trace_id", F.posexplode(items).alias("rawIndex", "event"))
    return exploded.select(
        "trace_id", F.col("rawIndex").cast("bigint").alias("rawIndex"), *event_columns(F.col("event"))
    )


def trace_metadata(documents: DataFrame) -> DataFrame:
    """(trace_id, metadata): JSON text of the metadata object, as it was written.

    A trace without one uses all its other top-level keys.
    """
    doc = F.col("doc")
    root = p.v_object(doc, "$")
    rest = F.to_json(F.to_variant_object(F.map_filter(root, lambda k, v: k != "traceEvents")))
    has_own = p.v_object(doc, "$.metadata").isNotNull()
    return documents.select(
        "trace_id",
        F.when(root.isNull(), F.lit("{}"))
        .when(has_own, F.get_json_object("text", "$.metadata"))
        .otherwise(rest)
        .alias("metadata"),
    )
