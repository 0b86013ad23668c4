"""Trace reports: dictionaries of frames around one chosen row.

A report picks its row by id, or the first row in the table's order without one,
and reads that single row to the driver, so that every frame below it is a plain
filter with literals that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarrylens.operators.counts import spread
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordering import ordering
from quarrylens.operators.ordinal import top_per_group
from quarrylens.plans.cpu import interaction_cpu_hotspots
from quarrylens.plans.facts import split_categories, trace_bounds

FRAME_MARGIN_US = 16_000
TOP_COMPONENTS = 20
TOP_CODE = 50
TOP_STACKS = 20
TOP_IN_INTERACTION = 20

# Listing order of the tables that reports cut.
CODE_ORDER = ("-totalDurationMs", "-count", "trace_id", "hotspotId")
CPU_ORDER = ("-selfTimeMs", "-sampleCount", "functionName", "trace_id", "nodeId")
STACK_ORDER = ("-totalTimeMs", "-sampleCount", "trace_id", "stackId")
INTERACTION_ORDER = ("-durationMs", "startTsUs", "trace_id", "interactionId")
SCOPED_CPU_ORDER = ("-totalTimeMs", "-sampleCount", "nodeId")

Tables = Callable[[str], DataFrame]
Order = Sequence[Column]

# Summary field -> table counted.
SUMMARY_TABLES = {
    "processes": "devtools.dims.processes",
    "screenshots": "devtools.dims.screenshots",
    "networkRequests": "devtools.dims.requests",
    "networkBodies": "devtools.dims.requestBodies",
    "interactions": "devtools.dims.interactions",
    "scripts": "devtools.dims.scripts",
    "sourceMaps": "code.dims.sourceMaps",
    "sources": "code.dims.sources",
    "frames": "devtools.dims.frames",
    "workers": "devtools.dims.workers",
    "layoutShifts": "devtools.dims.layoutShifts",
    "layoutShiftClusters": "devtools.views.layoutShiftClusters",
    "softNavigations": "devtools.dims.softNavigations",
    "frameReports": "devtools.views.framePipeline",
    "codeHotspots": "devtools.views.codeHotspots",
    "cpuHotspots": "devtools.views.cpuHotspots",
    "cpuSamples": "devtools.facts.cpuSamples",
}


def choose(df: DataFrame, order: Order, wanted: Mapping[str, str | None]) -> Row | None:
    """The row matching the first given value, else the first row in ``order``.

    A given value that matches nothing chooses nothing.
    """
    for column, value in wanted.items():
        if value is not None:
            return df.filter(F.col(column) == value).orderBy(*order).limit(1).first()
    return df.orderBy(*order).limit(1).first()


def _one(df: DataFrame, key: str, row: Row | None) -> DataFrame:
    if row is None:
        return df.limit(0)
    return df.filter((F.col("trace_id") == row["trace_id"]) & (F.col(key) == row[key]))


def within(df: DataFrame, row: Row | None, ts: str, start, end) -> DataFrame:
    """Rows of the same trace with start <= ts <= end."""
    if row is None:
        return df.limit(0)
    return df.filter((F.col("trace_id") == row["trace_id"]) & F.col(ts).between(start, end))


def event_summary(events: DataFrame) -> DataFrame:
    """Per trace: events, duration, distinct categories and threads."""
    bounds = trace_bounds(events)
    counts = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("totalEvents"))
    categories = (
        events.select("trace_id", F.explode(split_categories(F.col("cat"))).alias("c"))
        .distinct()
        .groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("categories"))
    )
    threads = (
        events.select("trace_id", "pid", "tid")
        .distinct()
        .groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("threads"))
    )
    return (
        counts.join(bounds, "trace_id")
        .join(categories, "trace_id", "left")
        .join(threads, "trace_id", "left")
        .select(
            "trace_id",
            "totalEvents",
            ((F.col("maxTs") - F.col("minTs")) / 1000).alias("durationMs"),
            F.coalesce("categories", F.lit(0)).alias("categories"),
            F.coalesce("threads", F.lit(0)).alias("threads"),
            F.col("totalEvents").alias("facts"),
        )
    )


def trace_summary(
    events: DataFrame, tables: Tables, counted: Mapping[str, str] = SUMMARY_TABLES
) -> DataFrame:
    """``devtools.summary``: one row per trace.

    Each count is written on its own; an input that fails counts zero and is named
    in ``error``, and the others are still computed.
    """
    parts: list[DataFrame] = []
    errors: list[str] = []
    for name, table in counted.items():
        try:
            per_trace = tables(table).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
            parts.append(cut(per_trace.select("trace_id", F.lit(name).alias("metric"), "n")))
        except Exception as error:  # noqa: BLE001 - any failed input is reported, not raised
            errors.append(f"{table}: {str(error).splitlines()[0]}")
    base = event_summary(events)
    names = list(counted)
    if parts:
        counts = spread(reduce(DataFrame.unionByName, parts), names, ("trace_id",))
        base = base.join(counts, "trace_id", "left").fillna(0, names)
    else:
        base = base.select("*", *[F.lit(0).alias(n) for n in names])
    return base.withColumn(
        "error", F.lit("; ".join(errors) if errors else None).cast("string")
    )


def trace_capabilities(events: DataFrame, scripts: DataFrame, sources: DataFrame, source_maps: DataFrame, screenshots: DataFrame, bodies: DataFrame) -> DataFrame:
    """Twelve yes/no facts per trace."""

    def has(name: str) -> Column:
        return F.bool_or(F.col("name") == name)

    flags = events.groupBy("trace_id").agg(
        has("ProfileChunk").alias("cpuProfile"),
        has("EventTiming").alias("eventTiming"),
        has("PipelineReporter").alias("framePipeline"),
        has("ResourceSendRequest").alias("networkTiming"),
        F.bool_or(F.array_contains(split_categories(F.col("cat")), "blink.user_timing")).alias(
            "renderUserTiming"
        ),
        has("LayoutShift").alias("layoutShift"),
        has("SoftNavigation").alias("softNavigation"),
    )

    def found(df: DataFrame, name: str, test: Column) -> DataFrame:
        return df.groupBy("trace_id").agg(F.bool_or(test).alias(name))

    yes = F.lit(True)
    parts = [
        found(screenshots, "screenshots", yes),
        found(bodies, "networkBodies", yes),
        found(scripts, "inlineScriptSource", F.col("hasSourceText")),
        found(source_maps, "sourceMaps", yes),
        found(sources, "sourceContents", F.col("hasContent")),
    ]
    for part in parts:
        flags = flags.join(part, "trace_id", "left")
    return flags.fillna(False)


def hotspots_report(code: DataFrame, cpu: DataFrame, stacks: DataFrame) -> dict[str, DataFrame]:
    """``devtools.hotspots``: top-k lists of code, CPU nodes and stacks of each trace."""

    def top(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
        return top_per_group(df, ["trace_id"], ordering(order), k).drop("_rank").orderBy(*ordering(order))

    return {
        "codeHotspots": top(code, CODE_ORDER, TOP_CODE),
        "cpuHotspots": top(cpu, CPU_ORDER, TOP_CODE),
        "cpuCallTrees": top(stacks, STACK_ORDER, TOP_STACKS),
    }


def interaction_report(tables: Tables, interaction_id: str | None = None) -> dict[str, DataFrame]:
    """``devtools.interaction``: everything inside one interaction."""
    interactions = tables("devtools.dims.interactions")
    target = choose(interactions, ordering(INTERACTION_ORDER), {"interactionId": interaction_id})
    start, end = (target["startTsUs"], target["endTsUs"]) if target else (0, 0)

    def inside(name: str, ts: str = "tsUs") -> DataFrame:
        return within(tables(name), target, ts, start, end)

    renders = inside("devtools.views.renderMeasures")
    frames = inside("devtools.views.framePipeline")
    navs = tables("devtools.dims.softNavigations")
    # Only the samples of this window are gathered, not those of every interaction.
    samples = inside("devtools.facts.cpuSamples")
    cpu = interaction_cpu_hotspots(samples, _one(interactions, "interactionId", target))
    code = tables("devtools.views.codeHotspots")
    if target is None:
        navs, code = navs.limit(0), code.limit(0)
    else:
        same = F.col("trace_id") == target["trace_id"]
        navs = navs.filter(same & (F.col("startTsUs") <= end) & (F.col("endTsUs") >= start))
        code = code.filter(same)
    return {
        "interaction": _one(interactions, "interactionId", target),
        "renders": renders.orderBy("rawIndex"),
        "topComponents": renders.groupBy("componentName")
        .count()
        .orderBy(F.col("count").desc(), "componentName")
        .limit(TOP_COMPONENTS),
        "eventDispatches": renders.select("eventId").limit(0),
        "droppedFrames": frames.agg(F.count_if(F.col("state") == "STATE_DROPPED").alias("droppedFrames")),
        "requests": inside("devtools.dims.requests", "startTimeUs").orderBy("startTimeUs", "requestId"),
        "layoutShifts": inside("devtools.dims.layoutShifts").orderBy("rawIndex"),
        "softNavigations": navs.orderBy("startTsUs"),
        "screenshots": inside("devtools.dims.screenshots").orderBy("index"),
        "framePipeline": frames.orderBy("rawIndex"),
        "codeHotspots": code.orderBy(*ordering(CODE_ORDER)).limit(TOP_IN_INTERACTION),
        "cpuHotspots": cpu.orderBy(*ordering(SCOPED_CPU_ORDER)).limit(TOP_IN_INTERACTION),
    }


def _changes(changes: DataFrame, row: Row | None, start, end) -> DataFrame:
    return within(changes, row, "tsUs", start, end).orderBy("tsUs", "sourceOrder", "rawIndex")


def frame_report(
    tables: Tables, frame_sequence: str | None = None, margin_us: int = FRAME_MARGIN_US
) -> dict[str, DataFrame]:
    """``devtools.frame``: a frame, its screenshot, visual changes within 16 ms or ``margin_us``."""
    frames = tables("devtools.views.framePipeline")
    shots = tables("devtools.dims.screenshots")
    order = (F.col("rawIndex"), F.col("trace_id"))
    target = choose(frames, order, {"frameSequence": frame_sequence})
    ts = target["tsUs"] if target else 0
    shown = shots.limit(0)
    if target and target["screenshotArtifactId"]:
        shown = shots.filter(
            (F.col("trace_id") == target["trace_id"])
            & (F.col("artifactId") == target["screenshotArtifactId"])
        )
    return {
        "frame": _one(frames, "frameReportId", target),
        "screenshot": shown,
        "visualChanges": _changes(
            tables("devtools.views.visualChanges"), target, ts - margin_us, ts + margin_us
        ),
    }


def request_report(
    tables: Tables, request_id: str | None = None, url: str | None = None
) -> dict[str, DataFrame]:
    """``devtools.request``: a request and the visual changes while it ran."""
    requests = tables("devtools.dims.requests")
    order = (F.col("startTimeUs"), F.col("requestId"), F.col("trace_id"))
    target = choose(requests, order, {"requestId": request_id, "url": url})
    start = target["startTimeUs"] if target else 0
    end = target["endTimeUs"] if target and target["endTimeUs"] is not None else start
    return {
        "request": _one(requests, "requestId", target),
        "visualChanges": _changes(tables("devtools.views.visualChanges"), target, start, end),
    }


def soft_navigation_report(
    tables: Tables, soft_navigation_id: str | None = None
) -> dict[str, DataFrame]:
    """``devtools.soft-navigation``: a navigation and what happened inside it."""
    navs = tables("devtools.dims.softNavigations")
    order = (F.col("startTsUs"), F.col("trace_id"), F.col("softNavigationId"))
    target = choose(navs, order, {"softNavigationId": soft_navigation_id})
    start, end = (target["startTsUs"], target["endTsUs"]) if target else (0, 0)
    return {
        "softNavigation": _one(navs, "softNavigationId", target),
        "layoutShifts": within(tables("devtools.dims.layoutShifts"), target, "tsUs", start, end),
        "screenshots": within(tables("devtools.dims.screenshots"), target, "tsUs", start, end),
        "requests": within(tables("devtools.dims.requests"), target, "startTimeUs", start, end),
    }


def script_report(
    tables: Tables, script_id: str | None = None, url: str | None = None
) -> dict[str, DataFrame]:
    """``devtools.script``: a script, its source map and sources, its hotspots."""
    scripts = tables("devtools.dims.scripts")
    order = (F.col("scriptId").try_cast("double"), F.col("scriptId"), F.col("trace_id"))
    target = choose(scripts, order, {"scriptId": script_id, "url": url})

    def matching(name: str) -> DataFrame:
        df = tables(name)
        if target is None:
            return df.limit(0)
        match = F.col("scriptId") == target["scriptId"]
        if target["url"]:
            match = match | (F.col("url") == target["url"])
        return df.filter((F.col("trace_id") == target["trace_id"]) & F.coalesce(match, F.lit(False)))

    def mapped(name: str) -> DataFrame:
        df = tables(name)
        if target is None or target["sourceMapId"] is None:
            return df.limit(0)
        return df.filter(
            (F.col("trace_id") == target["trace_id"])
            & (F.col("sourceMapId") == target["sourceMapId"])
        )

    return {
        "script": _one(scripts, "scriptId", target),
        "sourceMap": mapped("code.dims.sourceMaps"),
        "sources": mapped("code.dims.sources"),
        "codeHotspots": matching("devtools.views.codeHotspots").orderBy(*ordering(CODE_ORDER)),
        "cpuHotspots": matching("devtools.views.cpuHotspots").orderBy(*ordering(CPU_ORDER)),
    }
