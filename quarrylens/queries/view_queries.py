"""Renders, code hotspots, interaction windows and trace reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans import cpu, dims, facts, reports, views
from quarrylens.queries.cpu_queries import NODES, SAMPLES, STACKS, cpu_rows, profile_trace
from quarrylens.queries.dim_queries import (
    REQUESTS,
    SHOTS,
    TASKS,
    main_trace,
    media_trace,
    network_trace,
)
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.star_events import base_rows, by_type, trace_of


def _text(prefix, column="k"):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Renders and interactions ---------------------------------------------------------------
UI_PHASES = {"signup": "b", "view": "X", "purchase": "b", "click": "X", "error": "X"}


def ui_trace(spark, sf_dir):
    """Signups begin components, views measure them, purchases are interactions."""
    names = {
        "view": "UserTiming::Measure",
        "purchase": "EventTiming",
        "click": "FunctionCall",
        "error": "EvaluateScript",
    }

    def args():
        detail = F.when(
            F.col("uid") > 20,
            F.concat(
                F.lit('{"devtools":{"track":"T'),
                (F.col("uid") % 3).cast("string"),
                F.lit('","tooltipText":"tip","properties":[["a'),
                F.col("k").cast("string"),
                F.lit('",1],["b"],7,[2]]}}'),
            ),
        ).otherwise("not json")
        data = F.struct(
            by_type({"purchase": F.lit("click")}).alias("type"),
            by_type({"purchase": F.col("rawIndex") + 1}).alias("interactionId"),
            by_type({"purchase": F.col("value") * 60000}).alias("duration"),
            by_type({"click": F.col("uid"), "error": F.col("uid")}).alias("scriptId"),
            by_type(
                {"click": F.when(F.col("k") > 9, _text("https://u/", "uid")), "error": F.lit("x.js")}
            ).alias("url"),
            by_type({"click": F.when(F.col("k") < 60, F.concat(F.lit("fn"), (F.col("k") % 4).cast("string")))}).alias("functionName"),
        )
        return F.struct(
            data.alias("data"),
            by_type({"signup": F.col("k")}).alias("traceId"),
            by_type({"view": F.col("k")}).alias("sampleTraceId"),
            by_type({"signup": detail}).alias("detail"),
        )

    return trace_of(
        spark,
        sf_dir,
        names,
        UI_PHASES,
        args,
        cat=lambda: by_type({"signup": F.lit("a, blink.user_timing")}),
        name=lambda: F.when(
            F.col("et") == "signup", F.concat(F.lit("Comp"), (F.col("uid") % 7).cast("string"))
        ).otherwise(by_type(names)),
    )


RENDERS = """, bg AS (
  SELECT trace_id, k, max(idx) AS bidx FROM e WHERE et = 'signup' GROUP BY ALL), rd AS (
  SELECT v.trace_id, v.idx, v.k, v.ts, v.span, 'Comp' || (b.uid % 7) AS comp, b.uid AS buid
  FROM e v JOIN bg ON bg.trace_id = v.trace_id AND bg.k = v.k JOIN e b ON b.idx = bg.bidx WHERE v.et = 'view'), ia AS (
  SELECT trace_id, CAST(idx + 1 AS VARCHAR) AS iid, ts AS lo, ts + value * 60000 * 1000 AS hi, value * 60000 AS dur
  FROM e WHERE et = 'purchase')"""


@query(
    "e01_render_measures",
    with_events(
        RENDERS
        + """
SELECT trace_id, 'render:' || idx AS "renderMeasureId", CAST(k AS VARCHAR) AS "traceId", comp AS "componentName", ts AS "tsUs",
  round(span / 1000, 3) AS "durationMs", CASE WHEN buid > 20 THEN 'T' || (buid % 3) END AS track,
  CASE WHEN buid > 20 THEN 'tip' END AS "tooltipText", CASE WHEN buid > 20 THEN 'a' || k || ',b' ELSE '' END AS "propKeys",
  CASE WHEN buid > 20 THEN 4 ELSE 0 END AS properties FROM rd"""
    ),
)
def render_measures(spark, sf_dir):
    rows = views.render_measures(ui_trace(spark, sf_dir))
    return rows.select(
        "trace_id",
        "renderMeasureId",
        "traceId",
        "componentName",
        "tsUs",
        F.round("durationMs", 3).alias("durationMs"),
        "track",
        "tooltipText",
        F.array_join("propKeys", ",").alias("propKeys"),
        F.size("properties").cast("bigint").alias("properties"),
    )


@query(
    "e02_render_component_hotspots",
    with_events(
        RENDERS
        + """
SELECT trace_id, comp AS "componentName", count(*) AS "renderCount", round(sum(span) / 1000, 2) AS "totalDurationMs",
  round(max(span) / 1000, 3) AS "maxDurationMs", round(sum(span) / 1000 / count(*), 2) AS "avgDurationMs",
  arg_min_null(CASE WHEN buid > 20 THEN 'T' || (buid % 3) END, idx) AS track
FROM rd GROUP BY 1, 2"""
    ),
)
def render_component_hotspots(spark, sf_dir):
    rows = views.render_component_hotspots(views.render_measures(ui_trace(spark, sf_dir)))
    return (
        rows.withColumn("totalDurationMs", F.round("totalDurationMs", 2))
        .withColumn("maxDurationMs", F.round("maxDurationMs", 3))
        .withColumn("avgDurationMs", F.round("avgDurationMs", 2))
    )


@query(
    "e03_interaction_renders",
    with_events(
        RENDERS
        + """
SELECT rd.trace_id, iid AS "interactionId", comp AS "componentName", count(*) AS "renderCount",
  round(sum(span) / 1000, 2) AS "totalDurationMs"
FROM ia JOIN rd ON rd.trace_id = ia.trace_id AND rd.ts >= lo AND rd.ts <= hi GROUP BY 1, 2, 3"""
    ),
)
def interaction_renders(spark, sf_dir):
    events = ui_trace(spark, sf_dir)
    rows = views.interaction_renders(views.render_measures(events), dims.interactions(events))
    return rows.withColumn("totalDurationMs", F.round("totalDurationMs", 2))


CODE = """, c AS (
  SELECT *, CAST(uid AS VARCHAR) AS sid,
    CASE WHEN et = 'error' THEN 'x.js' WHEN k > 9 THEN 'https://u/' || uid ELSE '(unknown)' END AS url,
    CASE WHEN et = 'error' THEN 'EvaluateScript' WHEN k < 60 THEN 'fn' || (k % 4) ELSE 'FunctionCall' END AS fn
  FROM e WHERE et IN ('click', 'error')), hot AS (
  SELECT trace_id, sid, url, fn, sum(span) AS total, max(span) AS top, count(*) AS n, min(idx) AS first FROM c GROUP BY ALL), hs AS (
  SELECT *, 'hotspot:' || (row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1) AS hid FROM hot), su AS (
  SELECT trace_id, CAST(uid AS VARCHAR) AS sid, arg_max(CASE WHEN et = 'error' THEN 'x.js' ELSE 'https://u/' || uid END, idx) FILTER (et = 'error' OR k > 9) AS url
  FROM e WHERE et IN ('click', 'error') GROUP BY ALL), mp AS (
  SELECT trace_id, 'https://u/' || uid AS url, min(idx) AS n FROM e WHERE uid % 5 = 0 GROUP BY ALL), ch AS (
  SELECT hs.trace_id, hid AS "hotspotId", hs.sid AS "scriptId", hs.url, fn AS "functionName", total / 1000 AS "totalDurationMs",
    top / 1000 AS "maxDurationMs", hs.n AS count, CASE WHEN mp.n IS NOT NULL THEN 'sourcemap:' || mp.n END AS "sourceMapId"
  FROM hs LEFT JOIN su ON su.trace_id = hs.trace_id AND su.sid = hs.sid LEFT JOIN mp ON mp.trace_id = su.trace_id AND mp.url = su.url)"""


def _scripts(spark, sf_dir, events):
    maps = base_rows(spark, sf_dir).filter(F.col("uid") % 5 == 0).select(
        "trace_id", _text("https://u/", "uid").alias("url"), F.col("rawIndex").alias("mapIndex")
    )
    return dims.scripts(events, maps)


def _code_hotspots(spark, sf_dir):
    events = ui_trace(spark, sf_dir)
    return views.code_hotspots(events, _scripts(spark, sf_dir, events))


def _rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 3))
    return df


@query(
    "e05_code_hotspots",
    with_events(
        CODE
        + """ SELECT * REPLACE (round("totalDurationMs", 3) AS "totalDurationMs", round("maxDurationMs", 3) AS "maxDurationMs") FROM ch"""
    ),
)
def code_hotspots(spark, sf_dir):
    return _rounded(_code_hotspots(spark, sf_dir), "totalDurationMs", "maxDurationMs")


@query(
    "e16_interaction_windows",
    with_events(
        RENDERS
        + TASKS.replace(", tn AS", ", tn AS", 1)
        + REQUESTS
        + """, pts AS (
  SELECT trace_id, ts, 'render' AS kind FROM rd
  UNION ALL SELECT trace_id, "startTimeUs", 'request' FROM req
  UNION ALL SELECT trace_id, ts, 'screenshot' FROM e WHERE et = 'view'
  UNION ALL SELECT trace_id, ts, 'dropped' FROM e WHERE et = 'signup' AND uid > 10 AND k < 40
  UNION ALL SELECT trace_id, ts, 'shift' FROM e WHERE et = 'error'), hit AS (
  SELECT ia.trace_id, iid, count(*) FILTER (kind = 'render') AS a, count(*) FILTER (kind = 'request') AS b, count(*) FILTER (kind = 'screenshot') AS c,
    count(*) FILTER (kind = 'dropped') AS d, count(*) FILTER (kind = 'shift') AS s
  FROM ia JOIN pts ON pts.trace_id = ia.trace_id AND pts.ts >= lo AND pts.ts <= hi GROUP BY 1, 2), nav AS (
  SELECT trace_id, CASE WHEN k > 10 THEN CAST(k AS VARCHAR) ELSE 'soft-nav:' || idx END AS id, min(ts) AS nlo, max(ts) AS nhi
  FROM e WHERE et = 'signup' GROUP BY 1, 2), nh AS (
  SELECT ia.trace_id, iid, count(*) AS n FROM ia JOIN nav ON nav.trace_id = ia.trace_id AND nlo <= hi AND nhi >= lo GROUP BY 1, 2)
SELECT ia.trace_id, ia.iid AS "interactionId", 'click' AS type, round(dur, 3) AS "durationMs", coalesce(a, 0) AS "renderCount",
  coalesce(b, 0) AS "requestCount", coalesce(c, 0) AS "screenshotCount", coalesce(d, 0) AS "droppedFrameCount",
  coalesce(s, 0) AS "layoutShiftCount", coalesce(n, 0) AS "softNavigationCount"
FROM ia LEFT JOIN hit ON hit.trace_id = ia.trace_id AND hit.iid = ia.iid LEFT JOIN nh ON nh.trace_id = ia.trace_id AND nh.iid = ia.iid"""
    ),
)
def interaction_windows(spark, sf_dir):
    ui, media, main = ui_trace(spark, sf_dir), media_trace(spark, sf_dir), main_trace(spark, sf_dir)
    network = facts.event_facts(network_trace(spark, sf_dir))
    shots = dims.screenshots(media)
    rows = views.interaction_windows(
        dims.interactions(ui),
        views.render_measures(ui),
        dims.requests(network),
        shots,
        views.frame_pipeline(media, shots),
        dims.layout_shifts(media),
        dims.soft_navigations(main, dims.main_thread_tasks(main)),
    )
    return _rounded(rows, "durationMs")


# Reports --------------------------------------------------------------------------------
class _Tables:
    """Report inputs by table name, taken from the traces above."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.ui, self.media = ui_trace(spark, sf_dir), media_trace(spark, sf_dir)
        self.main = main_trace(spark, sf_dir)

    def __call__(self, name):
        return getattr(self, "_" + name.split(".")[-1])()

    def _interactions(self):
        return dims.interactions(self.ui)

    def _renderMeasures(self):
        return views.render_measures(self.ui)

    def _screenshots(self):
        return dims.screenshots(self.media)

    def _framePipeline(self):
        return views.frame_pipeline(self.media, self._screenshots())

    def _requests(self):
        return dims.requests(facts.event_facts(network_trace(self.spark, self.sf_dir)))

    def _layoutShifts(self):
        return dims.layout_shifts(self.media)

    def _softNavigations(self):
        return dims.soft_navigations(self.main, dims.main_thread_tasks(self.main))

    def _visualChanges(self):
        return views.visual_changes(self.media, self._screenshots(), self._layoutShifts())

    def _scripts(self):
        return _scripts(self.spark, self.sf_dir, self.ui)

    def _codeHotspots(self):
        return _code_hotspots(self.spark, self.sf_dir)

    def _cpuSamples(self):
        return cpu_rows(self.spark, self.sf_dir)

    def _cpuHotspots(self):
        return cpu.cpu_hotspots(cpu.cpu_nodes(profile_trace(self.spark, self.sf_dir)))

    def _cpuCallTrees(self):
        return cpu.cpu_call_trees(self._cpuSamples())

    def _sourceMaps(self):
        """A map for every event of a fifth of the users, as the scripts have them."""
        rows = base_rows(self.spark, self.sf_dir).filter(F.col("uid") % 5 == 0)
        return rows.select("trace_id", _text("sourcemap:", "rawIndex").alias("sourceMapId"), _text("https://u/", "uid").alias("url"))

    def _sources(self):
        return self._sourceMaps().select(
            "trace_id", F.replace("sourceMapId", F.lit("sourcemap"), F.lit("source")).alias("sourceId"), "sourceMapId"
        )


TARGET = """, tg AS (SELECT * FROM ia ORDER BY dur DESC, lo, trace_id, iid LIMIT 1)"""


@query(
    "f02_interaction_report_components",
    with_events(
        RENDERS
        + TARGET
        + """
SELECT comp AS "componentName", count(*) AS count FROM rd JOIN tg ON rd.trace_id = tg.trace_id AND rd.ts >= lo AND rd.ts <= hi
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
    ),
)
def interaction_report_components(spark, sf_dir):
    return reports.interaction_report(_Tables(spark, sf_dir))["topComponents"]


@query(
    "f02_interaction_report_shifts",
    with_events(
        RENDERS
        + TARGET
        + """
SELECT e.trace_id, 'layout-shift:' || e.idx AS "layoutShiftId", e.ts AS "tsUs", value AS score
FROM e JOIN tg ON e.trace_id = tg.trace_id AND e.ts >= lo AND e.ts <= hi WHERE et = 'error'"""
    ),
)
def interaction_report_shifts(spark, sf_dir):
    rows = reports.interaction_report(_Tables(spark, sf_dir))["layoutShifts"]
    return rows.select("trace_id", "layoutShiftId", "tsUs", "score")


@query(
    "f02_interaction_report_cpu",
    with_events(
        RENDERS
        + TARGET
        + SAMPLES
        + STACKS
        + """
SELECT CAST(node AS VARCHAR) AS "nodeId", fn AS "functionName", url, count(*) AS "sampleCount", round(sum(delta) / 1000, 6) AS "totalTimeMs"
FROM sm JOIN tg ON sm.trace_id = tg.trace_id AND sm.ts >= lo AND sm.ts <= hi GROUP BY node, fn, url
ORDER BY 5 DESC, 4 DESC, 1 LIMIT 20""",
        recursive=True,
    ),
)
def interaction_report_cpu(spark, sf_dir):
    rows = reports.interaction_report(_Tables(spark, sf_dir))["cpuHotspots"]
    return rows.select("nodeId", "functionName", "url", "sampleCount", F.round("totalTimeMs", 6).alias("totalTimeMs"))


@query(
    "f03_frame_report_changes",
    with_events(
        SHOTS
        + """, fr AS (SELECT trace_id, ts FROM e WHERE et = 'signup' ORDER BY idx LIMIT 1)
SELECT e.trace_id, e.ts AS "tsUs", CASE et WHEN 'view' THEN 'screenshot' WHEN 'error' THEN 'layout-shift' WHEN 'click' THEN 'Paint' ELSE 'PrePaint' END AS kind
FROM e JOIN fr ON e.trace_id = fr.trace_id AND e.ts BETWEEN fr.ts - 864000000000 AND fr.ts + 864000000000 WHERE et <> 'signup'"""
    ),
)
def frame_report_changes(spark, sf_dir):
    """Ten days around the frame: the test events lie minutes apart."""
    rows = reports.frame_report(_Tables(spark, sf_dir), margin_us=864_000_000_000)["visualChanges"]
    return rows.select("trace_id", "tsUs", "kind")


@query(
    "f04_request_report_changes",
    with_events(
        REQUESTS
        + """, tg AS (SELECT * FROM req ORDER BY "startTimeUs", "requestId", trace_id LIMIT 1)
SELECT e.trace_id, e.ts AS "tsUs", CASE et WHEN 'view' THEN 'screenshot' WHEN 'error' THEN 'layout-shift' WHEN 'click' THEN 'Paint' ELSE 'PrePaint' END AS kind
FROM e JOIN tg ON e.trace_id = tg.trace_id AND e.ts BETWEEN "startTimeUs" AND coalesce("endTimeUs", "startTimeUs") WHERE et <> 'signup'"""
    ),
)
def request_report_changes(spark, sf_dir):
    rows = reports.request_report(_Tables(spark, sf_dir))["visualChanges"]
    return rows.select("trace_id", "tsUs", "kind")


@query(
    "f05_soft_navigation_report_requests",
    with_events(
        REQUESTS
        + """, nav AS (
  SELECT trace_id, CASE WHEN k > 10 THEN CAST(k AS VARCHAR) ELSE 'soft-nav:' || idx END AS id, min(ts) AS nlo, max(ts) AS nhi
  FROM e WHERE et = 'signup' GROUP BY 1, 2), tg AS (SELECT * FROM nav WHERE id = '42' ORDER BY nlo, trace_id, id LIMIT 1)
SELECT req.trace_id, "requestId", "startTimeUs" FROM req JOIN tg ON req.trace_id = tg.trace_id AND "startTimeUs" BETWEEN nlo AND nhi"""
    ),
)
def soft_navigation_report_requests(spark, sf_dir):
    rows = reports.soft_navigation_report(_Tables(spark, sf_dir), "42")["requests"]
    return rows.select("trace_id", "requestId", "startTimeUs")


@query(
    "f06_hotspots_report_code",
    with_events(
        CODE
        + """ SELECT trace_id, "hotspotId", "functionName", round("totalDurationMs", 3) AS "totalDurationMs", count FROM ch
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ch."totalDurationMs" DESC, count DESC, "hotspotId") <= 50"""
    ),
)
def hotspots_report_code(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    rows = reports.hotspots_report(t("codeHotspots"), t("cpuHotspots"), t("cpuCallTrees"))
    return _rounded(
        rows["codeHotspots"].select("trace_id", "hotspotId", "functionName", "totalDurationMs", "count"),
        "totalDurationMs",
    )


@query(
    "f06_hotspots_report_cpu",
    with_events(
        SAMPLES
        + NODES
        + """ SELECT trace_id, "nodeId", "functionName", "selfSampleCount" AS "sampleCount", "selfTimeMs" FROM nd WHERE "selfSampleCount" > 0
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY nd."selfTimeMs" DESC, "selfSampleCount" DESC, "functionName", "nodeId") <= 50""",
        recursive=True,
    ),
)
def hotspots_report_cpu(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    rows = reports.hotspots_report(t("codeHotspots"), t("cpuHotspots"), t("cpuCallTrees"))["cpuHotspots"]
    return rows.select("trace_id", "nodeId", "functionName", "sampleCount", F.round("selfTimeMs", 6).alias("selfTimeMs"))


@query(
    "f06_hotspots_report_stacks",
    with_events(
        SAMPLES
        + STACKS
        + """, g AS (SELECT trace_id, label, count(*) AS n, sum(delta) AS us, min(idx * 2 + pos) AS first FROM sm GROUP BY 1, 2), o AS (
  SELECT *, 'cpu-stack:' || (row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1) AS "stackId" FROM g)
SELECT trace_id, "stackId", label AS "stackLabel", n AS "sampleCount", round(us / 1000, 6) AS "totalTimeMs" FROM o
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY us DESC, n DESC, "stackId") <= 20""",
        recursive=True,
    ),
)
def hotspots_report_stacks(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    rows = reports.hotspots_report(t("codeHotspots"), t("cpuHotspots"), t("cpuCallTrees"))["cpuCallTrees"]
    return rows.select("trace_id", "stackId", "stackLabel", "sampleCount", F.round("totalTimeMs", 6).alias("totalTimeMs"))


@query(
    "f07_script_report_sources",
    with_events(
        CODE
        + """, tg AS (SELECT su.trace_id, su.sid, mp.n FROM su JOIN mp ON mp.trace_id = su.trace_id AND mp.url = su.url WHERE sid = '55' LIMIT 1)
SELECT trace_id, 'sourcemap:' || n AS "sourceMapId", 'source:' || n AS "sourceId" FROM tg"""
    ),
)
def script_report_sources(spark, sf_dir):
    report = reports.script_report(_Tables(spark, sf_dir), "55")
    found = report["sourceMap"].select("trace_id", "sourceMapId")
    return found.join(report["sources"], ["trace_id", "sourceMapId"])


class _ProfiledTables(_Tables):
    """The same with the scripts that the profile names."""

    def _scripts(self):
        rows = base_rows(self.spark, self.sf_dir)
        script = F.concat(F.lit("s"), (F.col("uid") % 3).cast("string")).alias("scriptId")
        return rows.select("trace_id", script, F.lit("a.js").alias("url"), F.lit(None).cast("string").alias("sourceMapId")).distinct()


@query(
    "f07_script_report_cpu",
    with_events(
        SAMPLES
        + NODES
        + """ SELECT trace_id, "nodeId", "functionName", "selfSampleCount" AS "sampleCount" FROM nd
WHERE trace_id = (SELECT min(trace_id) FROM e WHERE uid % 3 = 1) AND "selfSampleCount" > 0
  AND (CAST("nodeId" AS BIGINT) % 2 = 0 OR (CAST("nodeId" AS BIGINT) > 50 AND CAST("nodeId" AS BIGINT) % 3 = 1))""",
        recursive=True,
    ),
)
def script_report_cpu(spark, sf_dir):
    """Sampled nodes of the script or of its file."""
    rows = reports.script_report(_ProfiledTables(spark, sf_dir), "s1")["cpuHotspots"]
    return rows.select("trace_id", "nodeId", "functionName", "sampleCount")


@query(
    "f07_script_report_code",
    with_events(
        CODE
        + """, tg AS (SELECT * FROM su WHERE sid = '33' LIMIT 1)
SELECT ch.trace_id, "hotspotId", "scriptId", ch.url, "functionName", count FROM ch JOIN tg ON ch.trace_id = tg.trace_id AND ("scriptId" = sid OR ch.url = tg.url)"""
    ),
)
def script_report_code(spark, sf_dir):
    rows = reports.script_report(_Tables(spark, sf_dir), "33")["codeHotspots"]
    return rows.select("trace_id", "hotspotId", "scriptId", "url", "functionName", "count")


@query(
    "f08_capabilities",
    with_events("""
SELECT trace_id, FALSE AS "cpuProfile", FALSE AS "eventTiming", bool_or(et = 'signup') AS "framePipeline", FALSE AS "networkTiming",
  FALSE AS "renderUserTiming", bool_or(et = 'error') AS "layoutShift", FALSE AS "softNavigation", bool_or(et = 'view') AS screenshots,
  bool_or(k < 90 AND et <> 'click' AND uid % 3 = 1) AS "networkBodies", bool_or(et = 'error' AND k > 80) AS "inlineScriptSource",
  bool_or(uid % 5 = 0) AS "sourceMaps", bool_or(uid % 5 = 0 AND k > 50) AS "sourceContents" FROM e GROUP BY 1"""),
)
def capabilities(spark, sf_dir):
    """Bodies, maps and sources are rows of the same events."""
    media, rows = media_trace(spark, sf_dir), base_rows(spark, sf_dir)
    mapped = rows.filter(F.col("uid") % 5 == 0)
    maps = mapped.select("trace_id", _text("https://u/", "uid").alias("url"), F.col("rawIndex").alias("mapIndex"))
    contents = mapped.select("trace_id", (F.col("k") > 50).alias("hasContent"))
    bodies = rows.filter((F.col("k") < 90) & (F.col("et") != "click") & (F.col("uid") % 3 == 1)).select("trace_id")
    return reports.trace_capabilities(media, dims.scripts(media, maps), contents, maps, dims.screenshots(media), bodies)


@query(
    "f01_summary",
    with_events("""
SELECT trace_id, count(*) AS "totalEvents", round((max(ts + CASE WHEN et IN ('click', 'purchase') THEN span ELSE 0 END) - min(ts)) / 1000, 3) AS "durationMs",
  1 AS categories, count(DISTINCT pid || ':' || tid) AS threads, count(*) AS facts, count(*) FILTER (et = 'view') AS screenshots,
  count(DISTINCT k) FILTER (et = 'error') AS scripts, count(*) FILTER (et = 'error') AS "layoutShifts", count(*) FILTER (et = 'signup') AS "frameReports",
  0 AS failing, TRUE AS reported FROM e GROUP BY 1"""),
)
def summary(spark, sf_dir):
    media = media_trace(spark, sf_dir)
    none = spark.createDataFrame([], "trace_id string, url string, mapIndex bigint")

    def tables(name):
        if name == "failing":
            raise ValueError("no such input")
        return {
            "screenshots": lambda: dims.screenshots(media),
            "scripts": lambda: dims.scripts(media, none),
            "layoutShifts": lambda: dims.layout_shifts(media),
            "frameReports": lambda: views.frame_pipeline(media, dims.screenshots(media)),
        }[name]()

    names = ("screenshots", "scripts", "layoutShifts", "frameReports")
    rows = reports.trace_summary(media, tables, {**{n: n for n in names}, "failing": "failing"})
    if "failing" not in rows.columns:
        rows = rows.withColumn("failing", F.lit(0))
    return _rounded(
        rows.withColumn("reported", F.contains("error", F.lit("no such input"))).drop("error"),
        "durationMs",
    )
