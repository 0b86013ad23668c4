"""Event facts: one typed row per trace event, with keys lifted out of ``args``.

Input everywhere is an *events* frame: trace_id, rawIndex, cat, name, ph, pid, tid,
ts, dur, id, s (VARIANT) and args (VARIANT).  All facts are narrow projections and
filters; only the aggregates at the end shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.plans.shredded import argument, carried

INSTANT_PHASES = ("I", "i", "M", "n")
ASYNC_PHASES = ("b", "e", "s", "t", "f", "n")

# Index name -> fact column.
BASIC_INDEXES = {"byName": "name", "byPhase": "phase", "byThread": "threadKey"}
SECONDARY_INDEXES = {
    "byRequestId": "requestId",
    "byScriptId": "scriptId",
    "byInteractionId": "interactionId",
    "byFrameSequenceId": "frameSeqId",
    "byNodeId": "nodeId",
    "byUrl": "url",
}
POSTING_BLOCK = 1 << 16
KEY_ARGUMENTS = (
    "frameId",
    "requestId",
    "url",
    "scriptId",
    "interactionId",
    "frameSeqId",
    "nodeId",
    "workerId",
    "layerId",
    "sampleTraceId",
)

RAW_EVENT_COLUMNS = ("trace_id", "rawIndex", "name", "ph", "pid", "tid", "ts")


def event_id(index: Column | None = None) -> Column:
    return F.concat(F.lit("evt:"), (F.col("rawIndex") if index is None else index).cast("string"))


def split_categories(cat: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(cat, F.lit("")), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def raw_events(events: DataFrame) -> DataFrame:
    """``devtools.raw.events``: events as parsed."""
    return events.select(*RAW_EVENT_COLUMNS)


def event_facts(events: DataFrame, keep_args: bool = True) -> DataFrame:
    """``devtools.facts.events``, and the argument columns of events that have them."""
    dur = F.coalesce(F.col("dur"), F.lit(0))

    def own(name: str) -> Column:
        return argument(events, name).alias(name)

    facts = events.select(
        "trace_id",
        event_id().alias("eventId"),
        "rawIndex",
        "name",
        F.col("ph").alias("phase"),
        split_categories(F.col("cat")).alias("categories"),
        "pid",
        "tid",
        F.concat_ws(":", "pid", "tid").alias("threadKey"),
        F.col("ts").alias("tsUs"),
        dur.alias("durUs"),
        (F.col("ts") + dur).alias("endUs"),
        p.v_id(F.col("id"), "$").alias("id"),
        p.v_id(F.col("s"), "$").alias("flowScope"),
        *[own(name) for name in KEY_ARGUMENTS],
        "args",
        *carried(events),
    )
    return facts if keep_args else facts.drop("args")


def instant_events(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("phase").isin(*INSTANT_PHASES))


def slice_events(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("phase") == "X")


def async_flows(facts: DataFrame) -> DataFrame:
    return facts.filter(
        F.col("phase").isin(*ASYNC_PHASES) | F.col("id").isNotNull() | F.col("flowScope").isNotNull()
    )


def object_lifecycles(facts: DataFrame) -> DataFrame:
    """``devtools.facts.objectLifecycles``: per object id, or flow scope without one.

    Names are counted first, so only one row per distinct name is gathered.
    """
    object_id = F.coalesce("id", "flowScope")
    by_name = (
        facts.filter(object_id.isNotNull())
        .groupBy("trace_id", object_id.alias("objectId"), "name")
        .agg(
            F.min("tsUs").alias("lo"), F.max("endUs").alias("hi"), F.count(F.lit(1)).alias("n")
        )
    )
    return by_name.groupBy("trace_id", "objectId").agg(
        F.min("lo").alias("firstTsUs"),
        F.max("hi").alias("lastTsUs"),
        F.sum("n").alias("eventCount"),
        F.sort_array(F.collect_list("name")).alias("eventNames"),
    )


def trace_bounds(events: DataFrame) -> DataFrame:
    """(trace_id, minTs, maxTs) over timed events; zero for a trace without any."""
    timed = (F.col("ph") != "M") & (F.col("ts") > 0)
    end = F.col("ts") + F.coalesce(F.col("dur"), F.lit(0))
    return events.groupBy("trace_id").agg(
        F.coalesce(F.min(F.when(timed, F.col("ts"))), F.lit(0)).alias("minTs"),
        F.coalesce(F.max(F.when(timed, end)), F.lit(0)).alias("maxTs"),
    )


def _postings(facts: DataFrame, indexes: dict[str, str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("index_name"), F.col(column).cast("string").alias("key"))
            for name, column in indexes.items()
        ]
    )
    return facts.select("trace_id", "rawIndex", F.inline(entries)).filter(F.col("key") != "")


def basic_index(facts: DataFrame) -> DataFrame:
    """(trace_id, rawIndex, index_name, key) by name, phase, thread and category."""
    categories = facts.select(
        "trace_id",
        "rawIndex",
        F.lit("byCategory").alias("index_name"),
        F.explode("categories").alias("key"),
    )
    return _postings(facts, BASIC_INDEXES).unionByName(categories)


def secondary_index(facts: DataFrame) -> DataFrame:
    """(trace_id, rawIndex, index_name, key) by request, script, frame, node, url ..."""
    return _postings(facts, SECONDARY_INDEXES)


def index_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("trace_id", "index_name", "key").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("rawIndex").alias("first_index"),
        F.max("rawIndex").alias("last_index"),
    )


def posting_blocks(postings: DataFrame) -> DataFrame:
    """Event ids per key in blocks, so no list exceeds ``POSTING_BLOCK`` events."""
    block = F.floor(F.col("rawIndex") / POSTING_BLOCK)
    return (
        postings.groupBy("trace_id", "index_name", "key", block.alias("block"))
        .agg(F.sort_array(F.collect_list("rawIndex")).alias("_idx"))
        .select(
            "trace_id",
            "index_name",
            "key",
            "block",
            F.transform("_idx", lambda i: F.concat(F.lit("evt:"), i.cast("string"))).alias("event_ids"),
        )
    )
