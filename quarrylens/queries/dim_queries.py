"""Requests, interactions, screenshots, scripts, shifts, tasks and navigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans import dims, facts, views
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.star_events import by_type, trace_of


def _text(prefix, column="k"):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Requests -------------------------------------------------------------------------------
NETWORK = {
    "signup": "ResourceSendRequest",
    "view": "ResourceReceiveResponse",
    "purchase": "ResourceFinish",
    "error": "ResourceReceivedData",
    "click": "Paint",
}
NETWORK_PHASES = {"signup": "I", "view": "I", "purchase": "X", "error": "I", "click": "X"}


def network_trace(spark, sf_dir):
    """Request ids repeat within a trace, so later events override earlier ones."""

    def args():
        sent = F.when(F.col("k") < 90, F.col("et") != "click")
        number = F.when(F.col("uid") > 20, 200 + F.col("k"))
        words = F.when(F.col("uid") <= 20, F.lit("200"))
        header = F.struct(F.lit("n").alias("name"), F.col("uid").cast("string").alias("value"))
        data = F.struct(
            F.when(sent, _text("req-")).alias("requestId"),
            by_type(
                {
                    "signup": F.when(F.col("uid") > 9, _text("https://s/", "uid")).otherwise(""),
                    "view": _text("https://v/", "uid"),
                }
            ).alias("url"),
            by_type({"signup": F.when(F.col("uid") % 2 == 0, "GET").otherwise("POST")}).alias(
                "requestMethod"
            ),
            by_type({"view": F.coalesce(number.cast("variant"), words.cast("variant"))}).alias(
                "statusCode"
            ),
            by_type({"view": F.when(F.col("uid") > 70, _text("text/", "uid"))}).alias("mimeType"),
            by_type({"view": F.lit("h2")}).alias("protocol"),
            by_type({"view": F.when(F.col("uid") > 40, F.col("uid") % 2 == 0)}).alias("fromCache"),
            by_type({"view": F.when(F.col("uid") > 30, F.array(header))}).alias("headers"),
            by_type({"error": F.col("uid")}).alias("encodedDataLength"),
        )
        return F.struct(data.alias("data"))

    return trace_of(spark, sf_dir, NETWORK, NETWORK_PHASES, args)


REQUESTS = """, r AS (
  SELECT *, 'req-' || k AS rid,
    CASE WHEN et = 'signup' AND uid > 9 THEN 'https://s/' || uid WHEN et = 'view' THEN 'https://v/' || uid END AS url,
    ts + CASE WHEN et = 'purchase' THEN span ELSE 0 END AS end_ts
  FROM e WHERE k < 90 AND et <> 'click'), base AS (
  SELECT trace_id, rid, arg_min_null(url, idx) AS first_url,
    arg_max(url, idx) FILTER (et = 'signup' AND url IS NOT NULL) AS sent_url,
    arg_max(CASE WHEN uid % 2 = 0 THEN 'GET' ELSE 'POST' END, idx) FILTER (et = 'signup') AS method,
    arg_min(ts, idx) AS first_ts, arg_max(ts, idx) FILTER (et = 'signup') AS last_send,
    max(idx) FILTER (et = 'purchase') AS fin, arg_max(end_ts, idx) FILTER (et = 'purchase') AS end_ts,
    arg_max(200 + k, idx) FILTER (et = 'view' AND uid > 20) AS status,
    arg_max('text/' || uid, idx) FILTER (et = 'view' AND uid > 70) AS mime,
    arg_max('h2', idx) FILTER (et = 'view') AS protocol,
    arg_max(uid % 2 = 0, idx) FILTER (et = 'view' AND uid > 40) AS cached,
    arg_max('n=' || uid, idx) FILTER (et = 'view' AND uid > 30) AS headers
  FROM r GROUP BY 1, 2), known AS (
  SELECT r.trace_id, r.rid, arg_max(r.ts, r.idx) AS known_ts
  FROM r JOIN base b ON b.trace_id = r.trace_id AND b.rid = r.rid AND r.idx < b.fin
  WHERE r.et = 'signup' GROUP BY 1, 2), req AS (
  SELECT base.trace_id, base.rid AS "requestId", coalesce(sent_url, first_url, '') AS url,
    coalesce(method, '') AS method, coalesce(last_send, first_ts) AS "startTimeUs", end_ts AS "endTimeUs",
    round((end_ts - coalesce(known_ts, first_ts)) / 1000, 3) AS "durationMs", status AS "statusCode",
    mime AS "mimeType", protocol, cached AS "fromCache", coalesce(headers, '') AS headers
  FROM base LEFT JOIN known USING (trace_id, rid))"""


def _requests(spark, sf_dir):
    return dims.requests(facts.event_facts(network_trace(spark, sf_dir)))


@query("d07_requests", with_events(REQUESTS + " SELECT * FROM req"))
def requests(spark, sf_dir):
    headers = F.array_join(
        F.transform("responseHeaders", lambda h: F.concat_ws("=", h["name"], h["value"])), ","
    )
    return _requests(spark, sf_dir).select(
        "trace_id",
        "requestId",
        "url",
        "method",
        "startTimeUs",
        "endTimeUs",
        F.round("durationMs", 3).alias("durationMs"),
        "statusCode",
        "mimeType",
        "protocol",
        "fromCache",
        headers.alias("headers"),
    )


@query(
    "e17_network_waterfall",
    with_events(
        REQUESTS
        + """, b AS (SELECT trace_id, min(ts) AS lo FROM e GROUP BY 1)
SELECT trace_id, 'request-waterfall:' || (row_number() OVER (PARTITION BY trace_id ORDER BY "startTimeUs", "requestId") - 1) AS "requestWaterfallId",
  "requestId", url, method, round(("startTimeUs" - lo) / 1000, 3) AS "startOffsetMs",
  round(("endTimeUs" - lo) / 1000, 3) AS "endOffsetMs", "durationMs", "statusCode", protocol
FROM req JOIN b USING (trace_id)"""
    ),
)
def network_waterfall(spark, sf_dir):
    rows = views.network_waterfall(network_trace(spark, sf_dir), _requests(spark, sf_dir))
    for name in ("startOffsetMs", "endOffsetMs", "durationMs"):
        rows = rows.withColumn(name, F.round(name, 3))
    return rows


# Interactions ---------------------------------------------------------------------------
def timing_trace(spark, sf_dir):
    """Clicks, views and errors are event timings; ids repeat, and zero means none."""
    names = {"click": "EventTiming", "view": "EventTiming", "error": "EventTiming", "signup": "X", "purchase": "Y"}
    phases = {t: "b" for t in names}

    def args():
        kind = by_type(
            {
                "click": F.when(F.col("uid") % 3 == 0, "click").otherwise("pointerup"),
                "view": F.when(F.col("uid") % 2 == 0, "keydown").otherwise("mouseover"),
                "error": F.when(F.col("uid") > 75, "touchstart").otherwise(""),
            }
        )
        data = F.struct(
            kind.alias("type"),
            F.when(F.col("et") != "error", F.col("k")).alias("interactionId"),
            (F.col("value") * 60000).alias("duration"),
            F.col("value").alias("processingStart"),
            by_type({"click": F.col("uid")}).alias("processingEnd"),
        )
        return F.struct(data.alias("data"))

    return trace_of(spark, sf_dir, names, phases, args)


TIMINGS = """, t AS (
  SELECT *, CASE et WHEN 'click' THEN CASE WHEN uid % 3 = 0 THEN 'click' ELSE 'pointerup' END
    WHEN 'view' THEN CASE WHEN uid % 2 = 0 THEN 'keydown' ELSE 'mouseover' END
    ELSE CASE WHEN uid > 75 THEN 'touchstart' ELSE 'unknown' END END AS type,
    CASE WHEN et <> 'error' THEN CAST(k AS VARCHAR) END AS sid, value * 60000 AS dur
  FROM e WHERE et IN ('click', 'view', 'error')), g AS (
  SELECT *, CASE WHEN sid <> '0' THEN sid ELSE type || '@' || ts END AS iid,
    row_number() OVER (PARTITION BY trace_id, CASE WHEN sid <> '0' THEN sid ELSE type || '@' || ts END ORDER BY dur DESC, idx) AS rn
  FROM t), ty AS (
  SELECT trace_id, iid, type, min(rn) AS rn FROM g GROUP BY ALL), tl AS (
  SELECT trace_id, iid, string_agg(type, ',' ORDER BY rn) AS types, arg_min(type, rn) AS first_type FROM ty GROUP BY ALL), ix AS (
  SELECT g.trace_id, g.iid AS "interactionId", max(dur) FILTER (rn = 1) AS dur, min(ts) AS lo,
    max(ts + dur * 1000) AS hi, arg_min_null(sid, rn) AS sid, arg_min_null(value, rn) AS ps,
    arg_min_null(CASE WHEN et = 'click' THEN uid END, rn) AS pe
  FROM g GROUP BY ALL)"""


@query(
    "d11_interactions",
    with_events(
        TIMINGS
        + """
SELECT ix.trace_id, ix."interactionId", sid AS "sourceInteractionId", types AS "eventTypes",
  CASE WHEN contains(',' || types || ',', ',click,') THEN 'click' WHEN contains(types, 'keydown') THEN 'keydown'
       WHEN contains(types, 'pointerup') THEN 'pointerup' ELSE first_type END AS type,
  round(dur, 3) AS "durationMs", lo AS "startTsUs", round(hi, 0) AS "endTsUs",
  ps AS "processingStartMs", CAST(pe AS DOUBLE) AS "processingEndMs"
FROM ix JOIN tl ON tl.trace_id = ix.trace_id AND tl.iid = ix."interactionId" """
    ),
)
def interactions(spark, sf_dir):
    return dims.interactions(timing_trace(spark, sf_dir)).select(
        "trace_id",
        "interactionId",
        "sourceInteractionId",
        F.array_join("eventTypes", ",").alias("eventTypes"),
        "type",
        F.round("durationMs", 3).alias("durationMs"),
        "startTsUs",
        F.round("endTsUs", 0).alias("endTsUs"),
        "processingStartMs",
        "processingEndMs",
    )


# Screenshots, scripts, shifts -----------------------------------------------------------
MEDIA = {
    "view": "Screenshot",
    "error": "LayoutShift",
    "click": "Paint",
    "signup": "PipelineReporter",
    "purchase": "PrePaint",
}
MEDIA_PHASES = {"view": "I", "error": "I", "click": "X", "signup": "b", "purchase": "X"}


def media_trace(spark, sf_dir):
    def args():
        node = F.struct(F.col("k").alias("node_id"))
        other = F.struct(_text("n").alias("node_id"))
        data = F.struct(
            by_type({"error": F.col("value")}).alias("score"),
            by_type({"error": F.col("k") / 4}).alias("cumulative_score"),
            by_type({"error": F.col("k") % 2}).alias("had_recent_input"),
            by_type(
                {"error": F.array(node.cast("struct<node_id:string>"), other)}
            ).alias("impacted_nodes"),
            by_type({"error": F.when(F.col("uid") >= 0, _text("s"))}).alias("scriptId"),
            F.when(F.col("k") < 50, _text("https://u/", "uid")).alias("url"),
            by_type({"error": F.when(F.col("k") > 80, _text("text é", "uid"))}).alias("sourceText"),
        )
        dropped = F.when(F.col("k") < 40, "STATE_DROPPED").otherwise("STATE_PRESENTED_ALL")
        reporter = F.struct(
            F.when(F.col("uid") > 10, dropped).alias("state"),
            F.col("k").alias("frame_sequence"),
            (F.col("k") > 20).alias("affects_smoothness"),
            F.when(F.col("uid") > 50, "yes").otherwise("").alias("has_high_latency"),
            F.col("value").alias("submit_ms"),
            F.col("uid").alias("queue_ms"),
            _text("SCROLL_").alias("scroll_state"),
        )
        return F.struct(
            data.alias("data"),
            by_type({"view": F.base64(F.encode(_text("picture "), "UTF-8"))}).alias("snapshot"),
            by_type({"view": F.when(F.col("uid") > 30, F.col("k"))}).alias("frame_sequence"),
            by_type({"signup": reporter}).alias("frame_reporter"),
        )

    return trace_of(spark, sf_dir, MEDIA, MEDIA_PHASES, args)


SHOTS = """, lo AS (SELECT trace_id, min(ts) AS lo FROM e GROUP BY 1), sh AS (
  SELECT trace_id, idx, ts, k, uid, row_number() OVER (PARTITION BY trace_id ORDER BY ts, idx) - 1 AS n
  FROM e WHERE et = 'view')"""


@query(
    "d10_screenshots",
    with_events(
        SHOTS
        + """
SELECT trace_id, CAST(n AS VARCHAR) AS "screenshotId", 'artifact:devtools:screenshot:' || n AS "artifactId",
  'evt:' || idx AS "eventId", n AS "index", ts AS "tsUs", round((ts - lo) / 1000, 3) AS "timestampMs",
  CASE WHEN uid > 30 THEN CAST(k AS VARCHAR) END AS "frameSeqId", 8 + length(CAST(k AS VARCHAR)) AS "sizeBytes",
  'screenshot-' || CASE WHEN length(CAST(n AS VARCHAR)) < 4 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END || '.jpg' AS filename
FROM sh JOIN lo USING (trace_id)"""
    ),
)
def screenshots(spark, sf_dir):
    return dims.screenshots(media_trace(spark, sf_dir)).select(
        "trace_id",
        "screenshotId",
        "artifactId",
        "eventId",
        "index",
        "tsUs",
        F.round("timestampMs", 3).alias("timestampMs"),
        "frameSeqId",
        "sizeBytes",
        "filename",
    )


@query(
    "d12_scripts",
    with_events("""
, m AS (SELECT DISTINCT trace_id, 'https://u/' || uid AS url, min(idx) OVER (PARTITION BY trace_id, uid) AS n FROM e WHERE uid % 5 = 0),
s AS (SELECT trace_id, 's' || k AS "scriptId",
    arg_max('https://u/' || uid, idx) FILTER (k < 50) AS url,
    arg_max(length('text é' || uid), idx) FILTER (k > 80) AS units FROM e WHERE et = 'error' GROUP BY 1, 2)
SELECT s.trace_id, "scriptId", s.url, units IS NOT NULL AS "hasSourceText",
  CASE WHEN units IS NOT NULL THEN 'artifact:devtools:script:' || "scriptId" END AS "sourceTextArtifactId",
  coalesce(units, 0) AS "sourceTextBytes", CASE WHEN n IS NOT NULL THEN 'sourcemap:' || n END AS "sourceMapId"
FROM s LEFT JOIN m ON m.trace_id = s.trace_id AND m.url = s.url"""),
)
def scripts(spark, sf_dir):
    from quarrylens.sources.star_events import base_rows

    # Source maps of every fifth user's url, listed in event order.
    maps = base_rows(spark, sf_dir).filter(F.col("uid") % 5 == 0).select(
        "trace_id", _text("https://u/", "uid").alias("url"), F.col("rawIndex").alias("mapIndex")
    )
    return dims.scripts(media_trace(spark, sf_dir), maps)


@query(
    "d13_layout_shifts",
    with_events("""
SELECT trace_id, 'layout-shift:' || idx AS "layoutShiftId", ts AS "tsUs", value AS score, k / 4 AS "cumulativeScore",
  k % 2 <> 0 AS "hadRecentInput", 2 AS "impactedNodeCount" FROM e WHERE et = 'error'"""),
)
def layout_shifts(spark, sf_dir):
    return dims.layout_shifts(media_trace(spark, sf_dir)).select(
        "trace_id",
        "layoutShiftId",
        "tsUs",
        "score",
        "cumulativeScore",
        "hadRecentInput",
        F.col("impactedNodeCount").cast("bigint").alias("impactedNodeCount"),
    )


@query(
    "e04_frame_pipeline",
    with_events(
        SHOTS
        + """, by_frame AS (SELECT trace_id, k, 'artifact:devtools:screenshot:' || max(n) AS shot FROM sh WHERE uid > 30 GROUP BY ALL)
SELECT e.trace_id, 'frame-report:' || idx AS "frameReportId", ts AS "tsUs", CAST(e.k AS VARCHAR) AS "frameSequence",
  CASE WHEN uid > 10 THEN CASE WHEN e.k < 40 THEN 'STATE_DROPPED' ELSE 'STATE_PRESENTED_ALL' END ELSE 'unknown' END AS state,
  e.k > 20 AS "affectsSmoothness", uid > 50 AS "hasHighLatency", FALSE AS "hasMainAnimation", 'SCROLL_' || e.k AS "scrollState",
  value AS submit_ms, CAST(uid AS DOUBLE) AS queue_ms, 2 AS timings, shot AS "screenshotArtifactId"
FROM e LEFT JOIN by_frame USING (trace_id, k) WHERE et = 'signup'"""
    ),
)
def frame_pipeline(spark, sf_dir):
    events = media_trace(spark, sf_dir)
    rows = views.frame_pipeline(events, dims.screenshots(events))
    timing = F.col("stageTimingsMs")
    return rows.select(
        "trace_id",
        "frameReportId",
        "tsUs",
        "frameSequence",
        "state",
        "affectsSmoothness",
        "hasHighLatency",
        "hasMainAnimation",
        "scrollState",
        timing["submit_ms"].alias("submit_ms"),
        timing["queue_ms"].alias("queue_ms"),
        F.size(timing).cast("bigint").alias("timings"),
        "screenshotArtifactId",
    )


@query(
    "e19_visual_changes",
    with_events(
        SHOTS
        + """
SELECT trace_id, 'visual:screenshot:' || n AS "changeId", 'screenshot' AS kind, ts AS "tsUs",
  'artifact:devtools:screenshot:' || n AS "artifactId", NULL AS score FROM sh
UNION ALL SELECT trace_id, 'layout-shift:' || idx, 'layout-shift', ts, NULL, value FROM e WHERE et = 'error'
UNION ALL SELECT trace_id, 'visual:' || CASE et WHEN 'click' THEN 'Paint' ELSE 'PrePaint' END || ':' || idx,
  CASE et WHEN 'click' THEN 'Paint' ELSE 'PrePaint' END, ts, NULL, NULL FROM e WHERE et IN ('click', 'purchase')"""
    ),
)
def visual_changes(spark, sf_dir):
    events = media_trace(spark, sf_dir)
    rows = views.visual_changes(events, dims.screenshots(events), dims.layout_shifts(events))
    return rows.drop("sourceOrder", "rawIndex")


# Sessions of errors per trace: one hour of quiet ends one, six hours cap it.
GAP_US, SPAN_US = 3_600_000_000, 21_600_000_000


@query(
    "e18_layout_shift_clusters",
    with_events(
        """, s AS (
  SELECT trace_id, ts, value, 2 AS nodes, row_number() OVER (PARTITION BY trace_id ORDER BY ts, idx) AS n
  FROM e WHERE et = 'error'), walk AS (
  SELECT trace_id, n, ts, ts AS start_ts, 0 AS c FROM s WHERE n = 1
  UNION ALL SELECT s.trace_id, s.n, s.ts,
    CASE WHEN s.ts - w.ts > 3600000000 OR s.ts - w.start_ts > 21600000000 THEN s.ts ELSE w.start_ts END,
    CASE WHEN s.ts - w.ts > 3600000000 OR s.ts - w.start_ts > 21600000000 THEN w.c + 1 ELSE w.c END
  FROM walk w JOIN s ON s.trace_id = w.trace_id AND s.n = w.n + 1)
SELECT trace_id, 'layout-shift-cluster:' || c AS "layoutShiftClusterId", min(w.start_ts) AS "startTsUs", max(w.ts) AS "lastTsUs",
  round(sum(value), 4) AS "totalScore", count(*) AS "shiftCount", CAST(sum(nodes) AS BIGINT) AS "impactedNodeCount",
  round((max(w.ts) - min(w.start_ts)) / 1000, 3) AS "durationMs"
FROM walk w JOIN s USING (trace_id, n) GROUP BY trace_id, c""",
        recursive=True,
    ),
)
def layout_shift_clusters(spark, sf_dir):
    shifts = dims.layout_shifts(media_trace(spark, sf_dir))
    rows = views.layout_shift_clusters(shifts, GAP_US, SPAN_US)
    return rows.withColumn("totalScore", F.round("totalScore", 4)).withColumn(
        "durationMs", F.round("durationMs", 3)
    )


# Tasks and navigations ------------------------------------------------------------------
MAIN = {
    "error": "thread_name",
    "purchase": "RunTask",
    "click": "FunctionCall",
    "view": "Paint",
    "signup": "SoftNavigationHeuristics",
}
MAIN_PHASES = {"error": "M", "purchase": "X", "click": "I", "view": "I", "signup": "n"}


def main_trace(spark, sf_dir):
    """Purchases are tasks as long as their value in minutes, on some main threads."""

    def args():
        label = F.when(F.col("k") < 80, F.lit("CrRendererMain")).otherwise(_text("Compositor "))
        context = F.struct(
            by_type({"signup": F.when(F.col("k") > 10, F.col("k"))}).alias("softNavContextId"),
            by_type({"signup": F.col("uid")}).alias("domModifications"),
        )
        return F.struct(by_type({"error": label}).alias("name"), context.alias("context"))

    return trace_of(spark, sf_dir, MAIN, MAIN_PHASES, args)


TASKS = """, tn AS (
  SELECT trace_id, pid, tid FROM e WHERE et = 'error' GROUP BY ALL HAVING arg_max(k, idx) < 80), m AS (
  SELECT *, ts + CASE WHEN et = 'purchase' THEN span ELSE 0 END AS end_ts FROM e SEMI JOIN tn USING (trace_id, pid, tid)), tk AS (
  SELECT * FROM m WHERE et = 'purchase' AND span > 0), ch AS (
  SELECT tk.trace_id, tk.idx, count(*) AS n, count(*) FILTER (m.et = 'click') AS fc, count(*) FILTER (m.et = 'view') AS pt
  FROM tk JOIN m ON m.trace_id = tk.trace_id AND m.pid = tk.pid AND m.tid = tk.tid AND m.idx <> tk.idx
    AND m.ts >= tk.ts AND m.ts <= tk.end_ts AND m.end_ts <= tk.end_ts GROUP BY 1, 2), tasks AS (
  SELECT tk.trace_id, tk.idx, tk.ts, tk.end_ts, tk.span, tk.pid || ':' || tk.tid AS thread_key,
    coalesce(n, 0) AS n, coalesce(fc, 0) AS fc, coalesce(pt, 0) AS pt FROM tk LEFT JOIN ch USING (trace_id, idx))"""


@query(
    "d15_main_thread_tasks",
    with_events(
        TASKS
        + """
SELECT trace_id, 'task:' || idx AS "taskId", thread_key AS "threadKey", ts AS "tsUs", round(span / 1000, 3) AS "durationMs",
  n AS "childEventCount", fc AS "functionCalls", 0 AS layouts, pt AS paints, 0 AS "renderMeasures" FROM tasks"""
    ),
)
def main_thread_tasks(spark, sf_dir):
    rows = dims.main_thread_tasks(main_trace(spark, sf_dir))
    return rows.drop("eventId", "rawIndex").withColumn("durationMs", F.round("durationMs", 3))


@query(
    "d14_soft_navigations",
    with_events(
        TASKS
        + """, nav AS (
  SELECT trace_id, CASE WHEN k > 10 THEN CAST(k AS VARCHAR) ELSE 'soft-nav:' || idx END AS id, min(ts) AS lo, max(ts) AS hi,
    count(*) AS n, max(uid) AS mods FROM e WHERE et = 'signup' GROUP BY 1, 2), best AS (
  SELECT nav.trace_id, nav.id, t.idx, row_number() OVER (PARTITION BY nav.trace_id, nav.id ORDER BY t.span DESC, t.ts, t.idx) AS rn
  FROM nav JOIN tasks t ON t.trace_id = nav.trace_id AND t.ts <= nav.hi AND t.end_ts >= nav.lo)
SELECT nav.trace_id, nav.id AS "softNavigationId", lo AS "startTsUs", hi AS "endTsUs", round((hi - lo) / 1000, 3) AS "durationMs",
  'SoftNavigationHeuristics' AS "eventTypes", nav.n AS "eventCount", mods AS "domModifications",
  CASE WHEN best.idx IS NOT NULL THEN 'task:' || best.idx END AS "taskId"
FROM nav LEFT JOIN best ON best.trace_id = nav.trace_id AND best.id = nav.id AND best.rn = 1"""
    ),
)
def soft_navigations(spark, sf_dir):
    events = main_trace(spark, sf_dir)
    rows = dims.soft_navigations(events, dims.main_thread_tasks(events))
    return rows.withColumn("eventTypes", F.array_join("eventTypes", ",")).withColumn(
        "durationMs", F.round("durationMs", 3)
    )
