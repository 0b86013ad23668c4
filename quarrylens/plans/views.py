"""Views of a trace that join and aggregate facts and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.operators.large_join import shuffle_join
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordinal import ordinal_by_order, ordinal_by_unique
from quarrylens.operators.range_join import interval_stats, overlap_join, range_join
from quarrylens.operators.sessions import capped_sessions
from quarrylens.plans.facts import event_id, split_categories, trace_bounds

SHIFT_GAP_US = 1_000_000
SHIFT_SPAN_US = 5_000_000
UNKNOWN_URL = "(unknown)"
VISUAL_EVENTS = ("Paint", "PrePaint", "AnimationFrame::Presentation")


def render_measures(events: DataFrame) -> DataFrame:
    """``devtools.views.renderMeasures``: measures with the last begin of their trace id."""
    args = F.col("args")
    begins = (
        events.filter(
            (F.col("ph") == "b")
            & F.array_contains(split_categories(F.col("cat")), "blink.user_timing")
        )
        .select(
            "trace_id",
            p.v_id(args, "$.traceId", "$.data.traceId").alias("traceId"),
            "rawIndex",
            F.col("name").alias("componentName"),
            p.v_str(args, "$.detail").alias("detailText"),
        )
        .filter(F.col("traceId").isNotNull())
        .groupBy("trace_id", "traceId")
        .agg(F.max_by(F.struct("componentName", "detailText", "rawIndex"), "rawIndex").alias("b"))
    )
    measures = events.filter(F.col("name") == "UserTiming::Measure").select(
        "trace_id",
        "rawIndex",
        F.col("ts").alias("tsUs"),
        (F.coalesce(F.col("dur"), F.lit(0)) / 1000).alias("durationMs"),
        p.v_id(args, "$.sampleTraceId", "$.traceId").alias("traceId"),
    )
    joined = shuffle_join(measures, begins, ["trace_id", "traceId"]).withColumn(
        "detail", F.try_parse_json("b.detailText")
    )
    detail = F.col("detail")
    properties = F.coalesce(
        p.v_array(detail, "$.devtools.properties"), F.array().cast("array<variant>")
    )
    keyed = F.filter(
        F.transform(properties, lambda e: p.v_str(e, "$[0]")), lambda k: k.isNotNull()
    )
    return joined.filter(F.col("b.componentName") != "").select(
        "trace_id",
        F.concat(F.lit("render:"), F.col("rawIndex").cast("string")).alias("renderMeasureId"),
        event_id().alias("eventId"),
        "rawIndex",
        "traceId",
        F.col("b.componentName").alias("componentName"),
        "tsUs",
        "durationMs",
        p.v_text(detail, "$.devtools.track").alias("track"),
        p.v_text(detail, "$.devtools.tooltipText").alias("tooltipText"),
        properties.alias("properties"),
        keyed.alias("propKeys"),
    )


def render_component_hotspots(renders: DataFrame) -> DataFrame:
    grouped = renders.groupBy("trace_id", "componentName").agg(
        F.count(F.lit(1)).alias("renderCount"),
        F.sum("durationMs").alias("totalDurationMs"),
        F.max("durationMs").alias("maxDurationMs"),
        F.min_by("track", "rawIndex").alias("track"),
    )
    return grouped.withColumn("avgDurationMs", F.col("totalDurationMs") / F.col("renderCount"))


def _windows(interactions: DataFrame) -> DataFrame:
    return interactions.select(
        "trace_id",
        "interactionId",
        F.col("startTsUs").alias("winStart"),
        F.col("endTsUs").alias("winEnd"),
    )


def interaction_renders(renders: DataFrame, interactions: DataFrame) -> DataFrame:
    inside = range_join(
        renders.select("trace_id", "componentName", "tsUs", "durationMs"),
        _windows(interactions),
        ["trace_id"],
        "tsUs",
        "winStart",
        "winEnd",
    )
    return inside.groupBy("trace_id", "interactionId", "componentName").agg(
        F.count(F.lit(1)).alias("renderCount"), F.sum("durationMs").alias("totalDurationMs")
    )


def frame_pipeline(events: DataFrame, screenshots: DataFrame) -> DataFrame:
    args = F.col("args")
    fields = p.v_object(args, "$.frame_reporter")
    numbers = F.map_filter(
        F.transform_values(fields, lambda k, v: p.v_num(v, "$")),
        lambda k, v: v.isNotNull() & (k != "frame_sequence"),
    )
    reports = events.filter(F.col("name") == "PipelineReporter").filter(fields.isNotNull())
    by_frame = (
        screenshots.filter(F.col("frameSeqId").isNotNull())
        .groupBy("trace_id", F.col("frameSeqId").alias("frameSequence"))
        .agg(F.max_by("artifactId", "index").alias("screenshotArtifactId"))
    )
    rows = reports.select(
        "trace_id",
        F.concat(F.lit("frame-report:"), F.col("rawIndex").cast("string")).alias("frameReportId"),
        event_id().alias("eventId"),
        "rawIndex",
        F.col("ts").alias("tsUs"),
        p.v_id(args, "$.frame_reporter.frame_sequence").alias("frameSequence"),
        F.coalesce(p.v_text(args, "$.frame_reporter.state"), F.lit("unknown")).alias("state"),
        p.v_truthy(args, "$.frame_reporter.affects_smoothness").alias("affectsSmoothness"),
        p.v_truthy(args, "$.frame_reporter.has_high_latency").alias("hasHighLatency"),
        p.v_truthy(args, "$.frame_reporter.has_main_animation").alias("hasMainAnimation"),
        p.v_text(args, "$.frame_reporter.scroll_state").alias("scrollState"),
        numbers.alias("stageTimingsMs"),
    )
    return shuffle_join(rows, by_frame, ["trace_id", "frameSequence"], "left")


def code_hotspots(events: DataFrame, scripts: DataFrame) -> DataFrame:
    """``devtools.views.codeHotspots``: script time by (script, url, function)."""
    args = F.col("args")
    calls = events.filter(
        F.col("name").isin("FunctionCall", "EvaluateScript") & (F.col("ph") == "X")
    ).select(
        "trace_id",
        "rawIndex",
        p.v_id(args, "$.data.scriptId").alias("scriptId"),
        F.coalesce(p.first_text(args, "$.data.url", "$.url"), F.lit(UNKNOWN_URL)).alias("url"),
        F.coalesce(p.v_text(args, "$.data.functionName"), F.col("name")).alias("functionName"),
        F.coalesce(F.col("dur"), F.lit(0)).alias("durUs"),
    )
    grouped = calls.groupBy("trace_id", "scriptId", "url", "functionName").agg(
        (F.sum("durUs") / 1000).alias("totalDurationMs"),
        (F.greatest(F.max("durUs"), F.lit(0)) / 1000).alias("maxDurationMs"),
        F.count(F.lit(1)).alias("count"),
        F.min("rawIndex").alias("firstIndex"),
    )
    numbered = ordinal_by_unique(grouped, ["trace_id"], "firstIndex", "_n")
    maps = scripts.filter(F.col("sourceMapId").isNotNull()).select(
        "trace_id", "scriptId", "sourceMapId"
    )
    return numbered.join(maps, ["trace_id", "scriptId"], "left").select(
        "trace_id",
        F.concat(F.lit("hotspot:"), F.col("_n").cast("string")).alias("hotspotId"),
        "scriptId",
        "url",
        "functionName",
        "totalDurationMs",
        "maxDurationMs",
        "count",
        "sourceMapId",
    )


def interaction_windows(
    interactions: DataFrame,
    renders: DataFrame,
    requests: DataFrame,
    screenshots: DataFrame,
    frames: DataFrame,
    shifts: DataFrame,
    navigations: DataFrame,
) -> DataFrame:
    """``devtools.views.interactionWindows``: what happened during each interaction.

    All point sources go through one range join, summed per time and kind first.
    """

    def tagged(df: DataFrame, ts: str, kind: str) -> DataFrame:
        return df.select("trace_id", F.col(ts).alias("tsUs"), F.lit(kind).alias("kind"))

    points = (
        tagged(renders, "tsUs", "render")
        .unionByName(tagged(requests, "startTimeUs", "request"))
        .unionByName(tagged(screenshots, "tsUs", "screenshot"))
        .unionByName(tagged(frames.filter(F.col("state") == "STATE_DROPPED"), "tsUs", "dropped"))
        .unionByName(tagged(shifts, "tsUs", "shift"))
        .groupBy("trace_id", "tsUs", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    interactions = cut(interactions)
    windows = _windows(interactions)
    stats = interval_stats(windows, "winStart", "winEnd")
    hits = range_join(points, windows, ["trace_id"], "tsUs", "winStart", "winEnd", stats=stats)
    counts = {
        "renderCount": "render",
        "requestCount": "request",
        "screenshotCount": "screenshot",
        "droppedFrameCount": "dropped",
        "layoutShiftCount": "shift",
    }
    per_window = hits.groupBy("trace_id", "interactionId").agg(
        *[
            F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
            for name, kind in counts.items()
        ]
    )
    navs = (
        overlap_join(
            navigations.select(
                "trace_id",
                "softNavigationId",
                F.col("startTsUs").alias("navStart"),
                F.col("endTsUs").alias("navEnd"),
            ),
            windows,
            ["trace_id"],
            ("navStart", "navEnd"),
            ("winStart", "winEnd"),
        )
        .groupBy("trace_id", "interactionId")
        .agg(F.count(F.lit(1)).alias("softNavigationCount"))
    )
    names = [*counts, "softNavigationCount"]
    key = ["trace_id", "interactionId"]
    return (
        interactions.select(*key, "type", "durationMs")
        .join(per_window.hint("merge"), key, "left")
        .join(navs.hint("merge"), key, "left")
        .fillna({name: 0 for name in names})
        .select(*key, "type", "durationMs", *names)
    )


def network_waterfall(events: DataFrame, requests: DataFrame) -> DataFrame:
    """``devtools.views.networkWaterfall``: requests in start order."""
    ordered = ordinal_by_order(
        requests.drop("responseHeaders", "timing"),
        ["trace_id"],
        [F.col("startTimeUs"), F.col("requestId")],
        "_n",
    )
    return ordered.join(trace_bounds(events), "trace_id").select(
        "trace_id",
        F.concat(F.lit("request-waterfall:"), F.col("_n").cast("string")).alias("requestWaterfallId"),
        "requestId",
        "url",
        "method",
        ((F.col("startTimeUs") - F.col("minTs")) / 1000).alias("startOffsetMs"),
        F.when(F.col("endTimeUs") != 0, (F.col("endTimeUs") - F.col("minTs")) / 1000).alias(
            "endOffsetMs"
        ),
        "durationMs",
        "statusCode",
        "protocol",
    )


def layout_shift_clusters(
    shifts: DataFrame, gap_us: int = SHIFT_GAP_US, span_us: int = SHIFT_SPAN_US
) -> DataFrame:
    """``devtools.views.layoutShiftClusters``: capped sessions of layout shifts."""
    sessions = capped_sessions(
        shifts,
        ["trace_id"],
        "tsUs",
        gap_us,
        span_us,
        {
            "totalScore": F.col("score"),
            "shiftCount": F.lit(1).cast("bigint"),
            "impactedNodeCount": F.col("impactedNodeCount").cast("bigint"),
        },
    )
    numbered = ordinal_by_unique(
        sessions, ["trace_id"], "start_ts", "_n", cell_width=max(1 << 32, 1024 * gap_us)
    )
    return numbered.select(
        "trace_id",
        F.concat(F.lit("layout-shift-cluster:"), F.col("_n").cast("string")).alias(
            "layoutShiftClusterId"
        ),
        F.col("start_ts").alias("startTsUs"),
        F.col("last_ts").alias("lastTsUs"),
        "totalScore",
        "shiftCount",
        "impactedNodeCount",
        ((F.col("last_ts") - F.col("start_ts")) / 1000).alias("durationMs"),
    )


def visual_changes(events: DataFrame, screenshots: DataFrame, shifts: DataFrame) -> DataFrame:
    """``devtools.views.visualChanges``: screenshots, shifts and paints as one list.

    ``sourceOrder`` and ``rawIndex`` break ties in time as the list does.
    """
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    shot_rows = screenshots.select(
        "trace_id",
        F.concat(F.lit("visual:screenshot:"), "screenshotId").alias("changeId"),
        F.lit("screenshot").alias("kind"),
        "tsUs",
        "artifactId",
        number.alias("score"),
        F.lit(0).alias("sourceOrder"),
        "rawIndex",
    )
    shift_rows = shifts.select(
        "trace_id",
        F.col("layoutShiftId").alias("changeId"),
        F.lit("layout-shift").alias("kind"),
        "tsUs",
        text.alias("artifactId"),
        "score",
        F.lit(1).alias("sourceOrder"),
        "rawIndex",
    )
    paint_rows = events.filter(F.col("name").isin(*VISUAL_EVENTS)).select(
        "trace_id",
        F.concat_ws(":", F.lit("visual"), "name", "rawIndex").alias("changeId"),
        F.col("name").alias("kind"),
        F.col("ts").alias("tsUs"),
        text.alias("artifactId"),
        number.alias("score"),
        F.lit(2).alias("sourceOrder"),
        "rawIndex",
    )
    return shot_rows.unionByName(shift_rows).unionByName(paint_rows)
