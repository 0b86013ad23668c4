"""Members of event arguments as typed columns of their own.

Most tables read one or two members of ``args``, which is a VARIANT of any size.  Ingest writes
the members that tables ask for beside it; a plan over such rows reads those columns, with their
Parquet statistics, and never the whole.  Over rows without them the same members are taken out
of ``args``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p

PREFIX = "arg_"


def _headers(args: Column) -> Column:
    objects = F.filter(
        F.transform(p.v_array(args, "$.data.headers"), lambda h: p.v_object(h, "$")),
        lambda h: h.isNotNull(),
    )

    def member(h: Column, name: str) -> Column:
        text = F.try_variant_get(F.try_element_at(h, F.lit(name)), "$", "string")
        return F.coalesce(text, F.lit("")).alias(name)

    # An entry of another type is left out, as one without members would be.
    return F.transform(objects, lambda h: F.struct(member(h, "name"), member(h, "value")))


# Name -> the value taken out of ``args``.
ARGUMENTS = {
    "frameId": lambda a: p.first_text(a, "$.data.frame", "$.frame", "$.beginData.frame"),
    "requestId": lambda a: p.v_text(a, "$.data.requestId"),
    "url": lambda a: p.first_text(a, "$.data.url", "$.url", "$.data.script_url", "$.data.final_response_url"),
    "scriptId": lambda a: p.v_id(a, "$.data.scriptId"),
    "interactionId": lambda a: p.v_num_text(a, "$.data.interactionId"),
    "frameSeqId": lambda a: p.first_num_text(a, "$.frameSeqId", "$.frame_sequence", "$.data.frameSeqId"),
    "nodeId": lambda a: p.first_num_text(a, "$.data.nodeId", "$.endData.nodeId"),
    "workerId": lambda a: p.v_id(a, "$.data.workerId", "$.workerId"),
    "layerId": lambda a: p.v_id(a, "$.data.layerId", "$.layerId"),
    "sampleTraceId": lambda a: p.v_id(a, "$.data.sampleTraceId", "$.data.traceId", "$.traceId"),
    "dataUrl": lambda a: p.v_text(a, "$.data.url"),
    "requestMethod": lambda a: p.v_text(a, "$.data.requestMethod"),
    "statusCode": lambda a: p.v_num(a, "$.data.statusCode").cast("int"),
    "mimeType": lambda a: p.v_text(a, "$.data.mimeType"),
    "protocol": lambda a: p.v_text(a, "$.data.protocol"),
    "fromCache": lambda a: p.v_bool(a, "$.data.fromCache"),
    "fromServiceWorker": lambda a: p.v_bool(a, "$.data.fromServiceWorker"),
    "headers": lambda a: F.when(p.v_array(a, "$.data.headers").isNotNull(), _headers(a)),
    "timing": lambda a: F.when(p.v_object(a, "$.data.timing").isNotNull(), F.try_variant_get(a, "$.data.timing", "string")),
    # The length of a script's text in UTF-16 units; the text itself stays in ``args``.
    "sourceUnits": lambda a: (F.octet_length(F.encode(p.v_text(a, "$.data.sourceText"), "UTF-16BE")) / 2).cast("bigint"),
}
# Identifiers that single events are looked up by.
LOOKED_UP = ("frameId", "requestId", "scriptId", "interactionId", "frameSeqId", "nodeId", "workerId", "layerId", "sampleTraceId")


def shred(events: DataFrame) -> DataFrame:
    """Events with a column for each argument."""
    args = F.col("args")
    return events.select("*", *[take(args).alias(PREFIX + name) for name, take in ARGUMENTS.items()])


def argument(rows: DataFrame, name: str) -> Column:
    """An argument of events or facts: its own column where there is one, else taken out of ``args``."""
    column = PREFIX + name
    return F.col(column) if column in rows.columns else ARGUMENTS[name](F.col("args"))


def carried(rows: DataFrame) -> list[str]:
    """The argument columns that rows have."""
    return [c for c in rows.columns if c.startswith(PREFIX)]


def bloom_filters() -> dict[str, str]:
    """Parquet write options: a bloom filter for each identifier."""
    return {f"parquet.bloom.filter.enabled#{PREFIX}{name}": "true" for name in LOOKED_UP}
