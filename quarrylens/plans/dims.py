"""Dimensions of a trace: threads, requests, interactions, scripts, tasks ...

Each is an aggregate with map-side combining; keys start with ``trace_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import blobs
from quarrylens.functions import payload as p
from quarrylens.functions.json_text import source_map_entries
from quarrylens.operators.large_join import shuffle_join
from quarrylens.operators.latest import first_where, last_where
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordinal import ordinal_by_order
from quarrylens.operators.range_join import overlap_join, range_join
from quarrylens.plans.facts import event_id, trace_bounds
from quarrylens.plans.shredded import argument

# Which event type names an interaction, most telling first.
INTERACTION_TYPES = ("click", "keydown", "pointerup", "mouseup", "pointerdown", "mousedown")
TASK_NAMES = ("RunTask", "ThreadControllerImpl::RunTask")


def _numbered(prefix: str, value: Column | None = None) -> Column:
    return F.concat(F.lit(prefix), (F.col("rawIndex") if value is None else value).cast("string"))


def name_metadata(events: DataFrame) -> DataFrame:
    """Naming events: (trace_id, rawIndex, kind, pid, tid, label)."""
    named = events.filter(
        (F.col("ph") == "M") & F.col("name").isin("thread_name", "process_name")
    )
    own = p.v_str(F.col("args"), "$.name")
    label = F.when(own.isNotNull(), own).otherwise(p.v_str(F.col("args"), "$.data.name"))
    return named.select(
        "trace_id", "rawIndex", F.col("name").alias("kind"), "pid", "tid", label.alias("label")
    ).filter(F.col("label") != "")


def thread_names(events: DataFrame) -> DataFrame:
    return (
        name_metadata(events)
        .filter(F.col("kind") == "thread_name")
        .groupBy("trace_id", "pid", "tid")
        .agg(F.max_by("label", "rawIndex").alias("threadName"))
    )


def process_names(events: DataFrame) -> DataFrame:
    return (
        name_metadata(events)
        .filter(F.col("kind") == "process_name")
        .groupBy("trace_id", "pid")
        .agg(F.max_by("label", "rawIndex").alias("processName"))
    )


def threads(events: DataFrame) -> DataFrame:
    counts = events.groupBy("trace_id", "pid", "tid").agg(F.count(F.lit(1)).alias("eventCount"))
    return (
        counts.join(thread_names(events), ["trace_id", "pid", "tid"], "left")
        .join(process_names(events), ["trace_id", "pid"], "left")
        .select(
            "trace_id",
            F.concat_ws(":", "pid", "tid").alias("threadKey"),
            "pid",
            "tid",
            "threadName",
            "processName",
            "eventCount",
        )
    )


def processes(events: DataFrame) -> DataFrame:
    per_thread = events.groupBy("trace_id", "pid", "tid").agg(F.count(F.lit(1)).alias("n"))
    per_process = per_thread.groupBy("trace_id", "pid").agg(
        F.count(F.lit(1)).alias("threadCount"), F.sum("n").alias("eventCount")
    )
    return per_process.join(process_names(events), ["trace_id", "pid"], "left").select(
        "trace_id",
        F.col("pid").cast("string").alias("processId"),
        "pid",
        "processName",
        "threadCount",
        "eventCount",
    )


def frames(facts: DataFrame) -> DataFrame:
    per_thread = (
        facts.filter(F.col("frameId").isNotNull())
        .groupBy("trace_id", "frameId", "threadKey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("url").isNotNull(), F.struct("rawIndex", "url"))).alias("first"),
        )
    )
    return per_thread.groupBy("trace_id", "frameId").agg(
        F.min("first")["url"].alias("url"),
        F.sum("n").alias("eventCount"),
        F.count(F.lit(1)).alias("threadCount"),
    )


def workers(facts: DataFrame, thread_rows: DataFrame) -> DataFrame:
    """Workers named by events, and threads or processes whose name says worker."""
    from_events = facts.filter(F.col("workerId").isNotNull()).select(
        "trace_id", "workerId", "threadKey", "url"
    )
    named = F.coalesce("threadName", F.lit("")).rlike("(?i)worker") | F.coalesce(
        "processName", F.lit("")
    ).rlike("(?i)worker")
    from_threads = thread_rows.filter(named).select(
        "trace_id",
        F.concat(F.lit("thread:"), "threadKey").alias("workerId"),
        "threadKey",
        F.lit(None).cast("string").alias("url"),
    )
    return (
        from_events.unionByName(from_threads)
        .groupBy("trace_id", "workerId")
        .agg(
            F.count_distinct("threadKey").alias("threadCount"),
            F.sort_array(F.collect_set("url")).alias("urls"),
        )
    )


def layers(facts: DataFrame) -> DataFrame:
    by_name = (
        facts.filter(F.col("layerId").isNotNull())
        .groupBy("trace_id", "layerId", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return by_name.groupBy("trace_id", "layerId").agg(
        F.sum("n").alias("eventCount"), F.sort_array(F.collect_list("name")).alias("eventNames")
    )


def requests(facts: DataFrame) -> DataFrame:
    """``devtools.dims.requests``: request lifecycles, later events winning.

    The duration uses the start known when the last finish arrived.  That start
    is decided inside the first aggregate unless sends lie on both sides of the
    finish; only those requests are read a second time.
    """
    rows = facts.filter(F.col("requestId").isNotNull())
    sends = F.col("name") == "ResourceSendRequest"
    answers = F.col("name") == "ResourceReceiveResponse"
    ends = F.col("name") == "ResourceFinish"
    send_at = F.struct("rawIndex", "tsUs")

    def answer(name: str) -> Column:
        return last_where(argument(facts, name), F.col("rawIndex"), answers)

    base = rows.groupBy("trace_id", "requestId").agg(
        F.coalesce(F.min_by(F.col("url"), F.col("rawIndex")), F.lit("")).alias("_firstUrl"),
        last_where(argument(facts, "dataUrl"), F.col("rawIndex"), sends).alias("_sentUrl"),
        F.coalesce(last_where(argument(facts, "requestMethod"), F.col("rawIndex"), sends), F.lit("")).alias("method"),
        F.min_by("tsUs", F.col("rawIndex")).alias("_firstTs"),
        F.min(F.when(sends, send_at)).alias("_firstSend"),
        F.max(F.when(sends, send_at)).alias("_lastSend"),
        F.max(F.when(ends, F.struct("rawIndex", "endUs"))).alias("_finish"),
        *[answer(name).alias(name) for name in ("statusCode", "mimeType", "protocol", "fromCache", "fromServiceWorker")],
        F.coalesce(
            answer("headers"), F.array().cast("array<struct<name:string,value:string>>")
        ).alias("responseHeaders"),
        F.parse_json(answer("timing")).alias("timing"),
    )
    # One row per request; written because it is read twice below.
    base = cut(base)
    finish = F.col("_finish.rawIndex")
    mixed = (F.col("_firstSend.rawIndex") < finish) & (F.col("_lastSend.rawIndex") > finish)
    pending = base.filter(mixed).select("trace_id", "requestId", finish.alias("_at"))
    known = (
        rows.filter(sends)
        .select("trace_id", "requestId", "rawIndex", "tsUs")
        .join(pending, ["trace_id", "requestId"])
        .filter(F.col("rawIndex") < F.col("_at"))
        .groupBy("trace_id", "requestId")
        .agg(F.max_by("tsUs", "rawIndex").alias("_knownTs"))
    )
    start_then = (
        F.when(F.col("_lastSend.rawIndex") < finish, F.col("_lastSend.tsUs"))
        .when(F.col("_knownTs").isNotNull(), F.col("_knownTs"))
        .otherwise(F.col("_firstTs"))
    )
    return base.join(known, ["trace_id", "requestId"], "left").select(
        "trace_id",
        "requestId",
        F.coalesce("_sentUrl", "_firstUrl").alias("url"),
        "method",
        F.coalesce("_lastSend.tsUs", "_firstTs").alias("startTimeUs"),
        F.col("_finish.endUs").alias("endTimeUs"),
        ((F.col("_finish.endUs") - start_then) / 1000).alias("durationMs"),
        "statusCode",
        "mimeType",
        "protocol",
        "fromCache",
        "fromServiceWorker",
        "responseHeaders",
        "timing",
    )


def screenshots(events: DataFrame) -> DataFrame:
    """``devtools.dims.screenshots``, numbered by time within the trace."""
    args = F.col("args")
    shots = events.filter(F.col("name") == "Screenshot").select(
        "trace_id",
        "rawIndex",
        F.col("ts").alias("tsUs"),
        p.v_str(args, "$.snapshot").alias("base64"),
        p.v_num_text(args, "$.frame_sequence").alias("frameSeqId"),
        p.v_long(args, "$.expected_display_time").alias("expectedDisplayTimeUs"),
    )
    shots = shots.filter(F.col("base64").isNotNull())
    # Only the keys are sorted and numbered; the images join them once.
    numbers = ordinal_by_order(
        shots.select("trace_id", "rawIndex", "tsUs"),
        ["trace_id"],
        [F.col("tsUs"), F.col("rawIndex")],
        "index",
    ).drop("tsUs")
    ordered = shuffle_join(shots, numbers, ["trace_id", "rawIndex"])
    padded = F.when(
        F.length(F.col("index").cast("string")) < 4, F.lpad(F.col("index").cast("string"), 4, "0")
    ).otherwise(F.col("index").cast("string"))
    return ordered.join(trace_bounds(events), "trace_id").select(
        "trace_id",
        F.col("index").cast("string").alias("screenshotId"),
        _numbered("artifact:devtools:screenshot:", F.col("index")).alias("artifactId"),
        event_id().alias("eventId"),
        "index",
        "rawIndex",
        "tsUs",
        ((F.col("tsUs") - F.col("minTs")) / 1000).alias("timestampMs"),
        "frameSeqId",
        "expectedDisplayTimeUs",
        F.octet_length(blobs.from_base64(F.col("base64"))).cast("bigint").alias("sizeBytes"),
        F.lit("image/jpeg").alias("mediaType"),
        "base64",
        F.concat(F.lit("screenshot-"), padded, F.lit(".jpg")).alias("filename"),
    )


def interactions(events: DataFrame) -> DataFrame:
    """``devtools.dims.interactions``: event timings grouped by interaction.

    Types are listed by their longest event, so one row per (interaction, type)
    is enough and is what gets gathered.
    """
    args = F.col("args")
    number = p.v_num_text(args, "$.data.interactionId")
    timings = (
        events.filter((F.col("name") == "EventTiming") & p.v_object(args, "$.data").isNotNull())
        .select(
            "trace_id",
            "rawIndex",
            F.col("ts").alias("tsUs"),
            F.coalesce(p.v_text(args, "$.data.type"), F.lit("unknown")).alias("type"),
            number.alias("sourceInteractionId"),
            F.coalesce(p.v_num(args, "$.data.duration"), F.lit(0.0)).alias("dur"),
            p.v_num(args, "$.data.processingStart").alias("processingStartMs"),
            p.v_num(args, "$.data.processingEnd").alias("processingEndMs"),
            p.v_num(args, "$.data.commitFinishTime").alias("commitFinishTimeMs"),
            p.v_num(args, "$.data.timeStamp").alias("timeStampMs"),
        )
        .withColumn(
            "interactionId",
            F.when(F.col("sourceInteractionId") != "0", F.col("sourceInteractionId")).otherwise(
                F.concat("type", F.lit("@"), p.number_text(F.col("tsUs")))
            ),
        )
    )
    best = F.struct(
        F.col("dur"),
        (-F.col("rawIndex")).alias("order"),
        "sourceInteractionId",
        "processingStartMs",
        "processingEndMs",
        "commitFinishTimeMs",
        "timeStampMs",
    )
    per_type = timings.groupBy("trace_id", "interactionId", "type").agg(
        F.max(best).alias("best"),
        F.min("tsUs").alias("lo"),
        F.max(F.col("tsUs") + F.col("dur") * 1000).alias("hi"),
    )
    listed = F.sort_array(
        F.collect_list(
            F.struct((-F.col("best.dur")).alias("d"), (-F.col("best.order")).alias("i"), "type")
        )
    )
    grouped = per_type.groupBy("trace_id", "interactionId").agg(
        F.max("best").alias("primary"),
        F.min("lo").alias("startTsUs"),
        F.max("hi").alias("endTsUs"),
        F.transform(listed, lambda t: t["type"]).alias("eventTypes"),
    )
    chosen = [
        F.when(F.array_contains("eventTypes", t), F.lit(t)) for t in INTERACTION_TYPES
    ]
    return grouped.select(
        "trace_id",
        "interactionId",
        F.col("primary.sourceInteractionId").alias("sourceInteractionId"),
        F.coalesce(*chosen, F.element_at("eventTypes", 1)).alias("type"),
        "eventTypes",
        F.col("primary.dur").alias("durationMs"),
        "startTsUs",
        "endTsUs",
        "primary.processingStartMs",
        "primary.processingEndMs",
        "primary.commitFinishTimeMs",
        "primary.timeStampMs",
    )


def scripts(events: DataFrame, source_maps: DataFrame) -> DataFrame:
    """``devtools.dims.scripts``: last url and last source text per script id."""
    # Only the length of the text travels, not the text.
    seen = events.select(
        "trace_id",
        "rawIndex",
        argument(events, "scriptId").alias("scriptId"),
        argument(events, "dataUrl").alias("url"),
        argument(events, "sourceUnits").alias("units"),
    ).filter(F.col("scriptId").isNotNull())
    grouped = seen.groupBy("trace_id", "scriptId").agg(
        last_where(F.col("url"), F.col("rawIndex")).alias("url"),
        last_where(F.col("units"), F.col("rawIndex")).alias("_units"),
    )
    first_map = source_maps.groupBy("trace_id", "url").agg(
        F.min("mapIndex").alias("_map")
    )
    has_text = F.col("_units").isNotNull()
    return grouped.join(first_map, ["trace_id", "url"], "left").select(
        "trace_id",
        "scriptId",
        "url",
        has_text.alias("hasSourceText"),
        F.when(has_text, F.concat(F.lit("artifact:devtools:script:"), "scriptId")).alias(
            "sourceTextArtifactId"
        ),
        F.coalesce("_units", F.lit(0)).alias("sourceTextBytes"),
        F.when(
            F.col("_map").isNotNull(), F.concat(F.lit("sourcemap:"), F.col("_map").cast("string"))
        ).alias("sourceMapId"),
    )


def script_texts(events: DataFrame) -> DataFrame:
    """(trace_id, scriptId, text): the first source text of each script."""
    args = F.col("args")
    return (
        events.select(
            "trace_id",
            "rawIndex",
            p.v_id(args, "$.data.scriptId").alias("scriptId"),
            p.v_text(args, "$.data.sourceText").alias("text"),
        )
        .filter(F.col("scriptId").isNotNull())
        .groupBy("trace_id", "scriptId")
        .agg(first_where(F.col("text"), F.col("rawIndex")).alias("text"))
        .filter(F.col("text").isNotNull())
    )


def layout_shifts(events: DataFrame) -> DataFrame:
    args = F.col("args")
    shifts = events.filter(
        (F.col("name") == "LayoutShift") & p.v_object(args, "$.data").isNotNull()
    ).withColumn(
        "nodes",
        F.coalesce(p.v_array(args, "$.data.impacted_nodes"), F.array().cast("array<variant>")),
    )
    def node_id(node: Column) -> Column:
        # A non-null node_id is printed as it is when either id is a number.
        numeric = p.v_num_text(node, "$.node_id").isNotNull() | p.v_num_text(node, "$.nodeId").isNotNull()
        printed = F.coalesce(
            p.v_num_text(node, "$.node_id"),
            F.try_variant_get(node, "$.node_id", "string"),
            p.v_num_text(node, "$.nodeId"),
        )
        return F.when(numeric, printed)

    def is_obj(node: Column, path: str) -> Column:
        return p.v_object(node, path).isNotNull()

    moved = F.filter("nodes", lambda n: is_obj(n, "$.old_rect") | is_obj(n, "$.new_rect"))
    return shifts.select(
        "trace_id",
        _numbered("layout-shift:").alias("layoutShiftId"),
        event_id().alias("eventId"),
        "rawIndex",
        F.col("ts").alias("tsUs"),
        F.coalesce(p.v_num(args, "$.data.score"), F.lit(0.0)).alias("score"),
        F.coalesce(p.v_num(args, "$.data.cumulative_score"), F.lit(0.0)).alias("cumulativeScore"),
        p.v_truthy(args, "$.data.had_recent_input").alias("hadRecentInput"),
        F.size("nodes").alias("impactedNodeCount"),
        F.filter(F.transform("nodes", node_id), lambda n: n.isNotNull()).alias("impactedNodeIds"),
        F.transform(
            moved,
            lambda n: F.struct(
                F.try_variant_get(n, "$.old_rect", "string").alias("oldRect"),
                F.try_variant_get(n, "$.new_rect", "string").alias("newRect"),
            ),
        ).alias("impactedRects"),
    )


def main_threads(events: DataFrame) -> DataFrame:
    """(trace_id, threadKey) of threads named as a renderer main thread."""
    names = thread_names(events)
    is_main = F.col("threadName").rlike("(?i)renderer.?main") | (
        F.col("threadName") == "CrRendererMain"
    )
    return names.filter(is_main).select(
        "trace_id", F.concat_ws(":", "pid", "tid").alias("threadKey")
    )


def main_thread_tasks(events: DataFrame) -> DataFrame:
    """``devtools.dims.tasks``: tasks of main threads with the events inside each.

    An event is inside when it starts and ends within the task on the same thread.
    """
    spans = events.select(
        "trace_id",
        F.concat_ws(":", "pid", "tid").alias("threadKey"),
        "rawIndex",
        "name",
        "ph",
        F.col("ts").alias("tsUs"),
        (F.col("ts") + F.coalesce(F.col("dur"), F.lit(0))).alias("endUs"),
        F.col("dur").alias("durUs"),
    ).join(main_threads(events), ["trace_id", "threadKey"], "left_semi")
    tasks = spans.filter(
        F.col("name").isin(*TASK_NAMES) & (F.col("ph") == "X") & (F.col("durUs") > 0)
    ).select(
        "trace_id",
        "threadKey",
        F.col("rawIndex").alias("taskIndex"),
        F.col("tsUs").alias("taskStart"),
        F.col("endUs").alias("taskEnd"),
        F.col("durUs").alias("taskDur"),
    )
    points = spans.select("trace_id", "threadKey", "rawIndex", "name", "tsUs", "endUs")
    inside = range_join(
        points, tasks, ["trace_id", "threadKey"], "tsUs", "taskStart", "taskEnd"
    ).filter((F.col("endUs") <= F.col("taskEnd")) & (F.col("rawIndex") != F.col("taskIndex")))

    def named(name: str) -> Column:
        return F.count_if(F.col("name") == name)

    counts = inside.groupBy("trace_id", "taskIndex").agg(
        F.count(F.lit(1)).alias("childEventCount"),
        named("FunctionCall").alias("functionCalls"),
        named("Layout").alias("layouts"),
        named("Paint").alias("paints"),
        named("UserTiming::Measure").alias("renderMeasures"),
    )
    zero = {
        c: 0 for c in ("childEventCount", "functionCalls", "layouts", "paints", "renderMeasures")
    }
    return (
        tasks.join(counts, ["trace_id", "taskIndex"], "left")
        .fillna(zero)
        .select(
            "trace_id",
            _numbered("task:", F.col("taskIndex")).alias("taskId"),
            event_id(F.col("taskIndex")).alias("eventId"),
            "threadKey",
            F.col("taskIndex").alias("rawIndex"),
            F.col("taskStart").alias("tsUs"),
            (F.col("taskDur") / 1000).alias("durationMs"),
            *zero,
        )
    )


def soft_navigations(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """``devtools.dims.softNavigations``, each with the longest task it overlaps."""
    args = F.col("args")
    end = F.col("ts") + F.coalesce(F.col("dur"), F.lit(0))
    by_name = (
        events.filter(F.col("name").startswith("SoftNavigation"))
        .groupBy(
            "trace_id",
            F.coalesce(p.v_id(args, "$.context.softNavContextId"), _numbered("soft-nav:")).alias(
                "softNavigationId"
            ),
            "name",
        )
        .agg(
            F.min("ts").alias("lo"),
            F.max(F.greatest(F.col("ts"), end)).alias("hi"),
            F.count(F.lit(1)).alias("n"),
            F.max(p.v_num(args, "$.context.domModifications")).alias("mods"),
        )
    )
    navs = by_name.groupBy("trace_id", "softNavigationId").agg(
        F.min("lo").alias("startTsUs"),
        F.max("hi").alias("endTsUs"),
        F.sort_array(F.collect_list("name")).alias("eventTypes"),
        F.sum("n").alias("eventCount"),
        F.greatest(F.max("mods"), F.lit(0)).cast("bigint").alias("domModifications"),
    )
    spans = tasks.select(
        "trace_id",
        "taskId",
        F.col("durationMs").alias("taskMs"),
        F.col("tsUs").alias("taskStart"),
        (F.col("tsUs") + F.col("durationMs") * 1000).alias("taskEnd"),
        F.col("rawIndex").alias("taskIndex"),
    )
    pairs = overlap_join(
        navs.select("trace_id", "softNavigationId", "startTsUs", "endTsUs"),
        spans,
        ["trace_id"],
        ("startTsUs", "endTsUs"),
        ("taskStart", "taskEnd"),
    )
    longest = pairs.groupBy("trace_id", "softNavigationId").agg(
        F.max_by(
            "taskId", F.struct(F.col("taskMs"), -F.col("taskStart"), -F.col("taskIndex"))
        ).alias("taskId")
    )
    return navs.join(longest, ["trace_id", "softNavigationId"], "left").select(
        "trace_id",
        "softNavigationId",
        "startTsUs",
        "endTsUs",
        ((F.col("endTsUs") - F.col("startTsUs")) / 1000).alias("durationMs"),
        "eventTypes",
        "eventCount",
        "domModifications",
        "taskId",
    )


def source_maps(metadata: DataFrame) -> DataFrame:
    """``code.dims.sourceMaps`` from (trace_id, metadata JSON text).

    ``content`` keeps the text of each map, for the artifact made from it.
    """
    entries = source_map_entries(metadata).withColumn("entry", F.parse_json("content"))
    entry = F.col("entry")
    return entries.select(
        "trace_id",
        "mapIndex",
        _numbered("sourcemap:", F.col("mapIndex")).alias("sourceMapId"),
        _numbered("artifact:code:sourcemap:", F.col("mapIndex")).alias("artifactId"),
        p.v_str(entry, "$.url").alias("url"),
        p.v_str(entry, "$.sourceMapUrl").alias("sourceMapUrl"),
        F.coalesce(F.size(p.v_array(entry, "$.sourceMap.sources")), F.lit(0)).alias("sourceCount"),
        p.v_array(entry, "$.sourceMap.sourcesContent").isNotNull().alias("hasSourcesContent"),
        "content",
    )


def sources(source_map_rows: DataFrame) -> DataFrame:
    """``code.dims.sources``: one row per original file of each source map."""
    entry = F.col("entry")
    files = (
        source_map_rows.withColumn("entry", F.parse_json("content"))
        .select(
            "trace_id",
            "mapIndex",
            "sourceMapId",
            p.v_array(entry, "$.sourceMap.sourcesContent").alias("contents"),
            F.posexplode(p.v_array(entry, "$.sourceMap.sources")).alias("sourceIndex", "source"),
        )
        .withColumn("content", p.v_str(F.get("contents", F.col("sourceIndex")), "$"))
    )
    both = F.concat_ws(":", "mapIndex", "sourceIndex")
    has_content = F.col("content").isNotNull()
    return files.select(
        "trace_id",
        F.concat(F.lit("source:"), both).alias("sourceId"),
        F.when(has_content, F.concat(F.lit("artifact:code:source:"), both)).alias("artifactId"),
        "sourceMapId",
        F.col("source").cast("string").alias("sourcePath"),
        F.coalesce(
            (F.octet_length(F.encode("content", "UTF-16BE")) / 2).cast("bigint"), F.lit(0)
        ).alias("sizeBytes"),
        has_content.alias("hasContent"),
        "mapIndex",
        "sourceIndex",
        "content",
    )
