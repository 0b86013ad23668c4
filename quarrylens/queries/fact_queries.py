"""Facts and dimensions over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans import dims, facts
from quarrylens.plans.provenance import provenance
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.star_events import by_type, trace_of

PHASES = {"purchase": "X", "click": "I", "view": "b", "signup": "i", "error": "e"}


def _text(prefix):
    return F.concat(F.lit(prefix), F.col("k").cast("string"))


def keyed_trace(spark, sf_dir):
    """Event types keep their name; each carries its own set of keys."""
    null_text, null_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def args():
        data = F.struct(
            by_type({"purchase": _text("F")}).alias("frame"),
            F.concat_ws("-", "uid", "k").alias("requestId"),
            by_type({"click": _text("https://h/"), "view": F.lit("")}).alias("url"),
            by_type({"view": _text("https://s/"), "purchase": _text("https://p/")}).alias("script_url"),
            by_type({"purchase": F.col("k")}).alias("scriptId"),
            by_type({"click": F.col("k")}).alias("interactionId"),
            by_type({"view": F.col("k")}).alias("nodeId"),
            by_type({"error": _text("w"), "signup": F.lit("")}).alias("workerId"),
            by_type({"signup": F.col("k")}).alias("layerId"),
            by_type({"view": F.col("value")}).alias("sampleTraceId"),
        )
        return F.struct(
            data.alias("data"),
            by_type({"signup": F.col("uid")}).alias("frame_sequence"),
            by_type({"error": _text("G")}).alias("frame"),
            F.coalesce(null_text, null_text).alias("url"),
            F.struct(by_type({"signup": F.col("k")}).alias("nodeId")).alias("endData"),
            null_long.alias("traceId"),
        )

    return trace_of(
        spark,
        sf_dir,
        {t: t for t in PHASES},
        PHASES,
        args,
        cat=lambda: F.concat(F.lit("devtools.timeline, ,"), F.col("et")),
        event_id=lambda: by_type({"view": _text("obj-"), "error": F.col("k").cast("string")}),
        scope=lambda: by_type({"click": F.lit("t")}),
    )


# The same facts in SQL.
FACTS = """, f AS (
  SELECT *, 'evt:' || idx AS "eventId", et AS name,
    CASE et WHEN 'purchase' THEN 'X' WHEN 'click' THEN 'I' WHEN 'view' THEN 'b'
            WHEN 'signup' THEN 'i' ELSE 'e' END AS phase,
    pid || ':' || tid AS "threadKey",
    CASE WHEN et = 'purchase' THEN span ELSE 0 END AS dur,
    CASE WHEN et = 'view' THEN 'obj-' || k WHEN et = 'error' THEN CAST(k AS VARCHAR) END AS oid,
    CASE WHEN et = 'click' THEN 't' END AS scope,
    CASE WHEN et = 'purchase' THEN 'F' || k WHEN et = 'error' THEN 'G' || k END AS "frameId",
    uid || '-' || k AS "requestId",
    CASE WHEN et = 'click' THEN 'https://h/' || k WHEN et = 'view' THEN 'https://s/' || k
         WHEN et = 'purchase' THEN 'https://p/' || k END AS url,
    CASE WHEN et = 'purchase' THEN CAST(k AS VARCHAR) END AS "scriptId",
    CASE WHEN et = 'click' THEN CAST(k AS VARCHAR) END AS "interactionId",
    CASE WHEN et = 'signup' THEN CAST(uid AS VARCHAR) END AS "frameSeqId",
    CASE WHEN et IN ('view', 'signup') THEN CAST(k AS VARCHAR) END AS "nodeId",
    CASE WHEN et = 'error' THEN 'w' || k END AS "workerId",
    CASE WHEN et = 'signup' THEN CAST(k AS VARCHAR) END AS "layerId"
  FROM e)"""

FACT_COLUMNS = [
    "trace_id",
    "eventId",
    "name",
    "phase",
    "pid",
    "tid",
    "threadKey",
    "tsUs",
    "durUs",
    "endUs",
    "id",
    "flowScope",
    "frameId",
    "requestId",
    "url",
    "scriptId",
    "interactionId",
    "frameSeqId",
    "nodeId",
    "workerId",
    "layerId",
]
FACT_SQL = """
SELECT trace_id, "eventId", name, phase, pid, tid, "threadKey", ts AS "tsUs", dur AS "durUs",
  ts + dur AS "endUs", oid AS id, scope AS "flowScope", "frameId", "requestId", url, "scriptId",
  "interactionId", "frameSeqId", "nodeId", "workerId", "layerId" FROM f"""


def _facts(spark, sf_dir):
    return facts.event_facts(keyed_trace(spark, sf_dir), keep_args=False)


@query(
    "a04_raw_events",
    with_events("""
SELECT trace_id, idx AS "rawIndex", et AS name, CASE et WHEN 'purchase' THEN 'X' WHEN 'click' THEN 'I'
  WHEN 'view' THEN 'b' WHEN 'signup' THEN 'i' ELSE 'e' END AS ph, pid, tid, ts FROM e"""),
)
def raw_events(spark, sf_dir):
    return facts.raw_events(keyed_trace(spark, sf_dir))


@query(
    "c01_event_facts",
    with_events(
        FACTS
        + FACT_SQL.replace(
            '"layerId" FROM', '"layerId", \'devtools.timeline|\' || et AS categories FROM'
        )
    ),
)
def event_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select(
        *FACT_COLUMNS, F.array_join("categories", "|").alias("categories")
    )


@query(
    "c03_sample_trace_ids",
    with_events("""
SELECT trace_id, 'evt:' || idx AS "eventId",
  regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS "sampleTraceId"
FROM e WHERE et = 'view'"""),
)
def sample_trace_ids(spark, sf_dir):
    rows = _facts(spark, sf_dir).filter(F.col("sampleTraceId").isNotNull())
    return rows.select("trace_id", "eventId", "sampleTraceId")


@query(
    "c05_trace_bounds",
    with_events("""
SELECT trace_id, min(ts) AS "minTs", max(ts + CASE WHEN et = 'purchase' THEN span ELSE 0 END) AS "maxTs"
FROM e GROUP BY 1"""),
)
def trace_bounds(spark, sf_dir):
    return facts.trace_bounds(keyed_trace(spark, sf_dir))


def _phase_query(name, build, test):
    @query(name, with_events(FACTS + FACT_SQL + f" WHERE {test}"))
    def run(spark, sf_dir):
        return build(_facts(spark, sf_dir)).select(*FACT_COLUMNS)

    return run


_phase_query("c06_instant_events", facts.instant_events, "phase IN ('I', 'i', 'M', 'n')")
_phase_query("c07_slice_events", facts.slice_events, "phase = 'X'")
_phase_query(
    "c08_async_flows",
    facts.async_flows,
    "phase IN ('b','e','s','t','f','n') OR oid IS NOT NULL OR scope IS NOT NULL",
)


@query(
    "c09_object_lifecycles",
    with_events(
        FACTS
        + """
SELECT trace_id, coalesce(oid, scope) AS "objectId", min(ts) AS "firstTsUs", max(ts + dur) AS "lastTsUs",
  count(*) AS "eventCount", string_agg(DISTINCT name, ',' ORDER BY name) AS "eventNames"
FROM f WHERE coalesce(oid, scope) IS NOT NULL GROUP BY 1, 2"""
    ),
)
def object_lifecycles(spark, sf_dir):
    rows = facts.object_lifecycles(_facts(spark, sf_dir))
    return rows.withColumn("eventNames", F.array_join("eventNames", ","))


SIZES = """ SELECT trace_id, index_name, key, count(*) AS event_count, min(idx) AS first_index,
  max(idx) AS last_index FROM p GROUP BY 1, 2, 3"""


@query(
    "c10_basic_indexes",
    with_events(
        FACTS
        + """, p AS (
  SELECT trace_id, idx, 'byName' AS index_name, name AS key FROM f
  UNION ALL SELECT trace_id, idx, 'byPhase', phase FROM f
  UNION ALL SELECT trace_id, idx, 'byThread', "threadKey" FROM f
  UNION ALL SELECT trace_id, idx, 'byCategory', 'devtools.timeline' FROM f
  UNION ALL SELECT trace_id, idx, 'byCategory', et FROM f)"""
        + SIZES
    ),
)
def basic_indexes(spark, sf_dir):
    return facts.index_sizes(facts.basic_index(_facts(spark, sf_dir)))


POSTINGS = """, p AS (
  SELECT trace_id, idx, 'byRequestId' AS index_name, "requestId" AS key FROM f
  UNION ALL SELECT trace_id, idx, 'byScriptId', "scriptId" FROM f
  UNION ALL SELECT trace_id, idx, 'byInteractionId', "interactionId" FROM f
  UNION ALL SELECT trace_id, idx, 'byFrameSequenceId', "frameSeqId" FROM f
  UNION ALL SELECT trace_id, idx, 'byNodeId', "nodeId" FROM f
  UNION ALL SELECT trace_id, idx, 'byUrl', url FROM f)"""


@query(
    "c11_secondary_indexes",
    with_events(FACTS + POSTINGS + SIZES.replace("GROUP BY", "WHERE key IS NOT NULL GROUP BY")),
)
def secondary_indexes(spark, sf_dir):
    return facts.index_sizes(facts.secondary_index(_facts(spark, sf_dir)))


@query(
    "c11_posting_blocks",
    with_events(
        FACTS
        + POSTINGS
        + """ SELECT trace_id, index_name, key, idx // 65536 AS block,
  string_agg('evt:' || idx, ',' ORDER BY idx) AS event_ids
FROM p WHERE key IS NOT NULL GROUP BY 1, 2, 3, 4"""
    ),
)
def posting_blocks(spark, sf_dir):
    rows = facts.posting_blocks(facts.secondary_index(_facts(spark, sf_dir)))
    return rows.withColumn("event_ids", F.array_join("event_ids", ","))


@query(
    "c13_provenance",
    with_events(
        FACTS
        + """, m AS (
  SELECT trace_id, 'devtools.dims.requests' AS layer, "requestId" AS id, "eventId" FROM f
  UNION ALL SELECT trace_id, 'devtools.facts.objectLifecycles', coalesce(oid, scope), "eventId" FROM f
  UNION ALL SELECT trace_id, 'devtools.dims.frames', "frameId", "eventId" FROM f)
SELECT trace_id, layer, id AS "rowId", "eventId" FROM m WHERE id IS NOT NULL"""
    ),
)
def event_provenance(spark, sf_dir):
    rows = facts.event_facts(keyed_trace(spark, sf_dir))
    layers = ("devtools.dims.requests", "devtools.facts.objectLifecycles", "devtools.dims.frames")
    first, second, third = (provenance(rows, layer) for layer in layers)
    return first.unionByName(second).unionByName(third)


# Threads and processes -----------------------------------------------------------------
NAMED = {"error": "thread_name", "signup": "process_name", "click": "click", "view": "view", "purchase": "purchase"}
NAMED_PHASES = {"error": "M", "signup": "M", "click": "I", "view": "I", "purchase": "X"}


def named_trace(spark, sf_dir):
    """Errors name threads, signups name processes, sometimes as workers."""

    def args():
        label = F.when(F.col("k") < 30, _text("Dedicated worker ")).otherwise(_text("Main "))
        process = F.when(F.col("k") < 5, _text("WORKER process ")).otherwise(_text("Renderer "))
        return F.struct(
            by_type({"error": label}).alias("name"),
            F.struct(
                by_type({"signup": process}).alias("name"),
                by_type({"click": F.col("k")}).alias("workerId"),
                by_type({"click": _text("https://w/"), "view": F.lit("x")}).alias("url"),
                by_type({"view": _text("F"), "purchase": _text("F")}).alias("frame"),
                by_type({"purchase": F.col("k")}).alias("layerId"),
            ).alias("data"),
        )

    return trace_of(spark, sf_dir, NAMED, NAMED_PHASES, args)


NAMES = """, tn AS (
  SELECT trace_id, pid, tid, arg_max(CASE WHEN k < 30 THEN 'Dedicated worker ' || k ELSE 'Main ' || k END, idx) AS thread_name
  FROM e WHERE et = 'error' GROUP BY ALL), pn AS (
  SELECT trace_id, pid, arg_max(CASE WHEN k < 5 THEN 'WORKER process ' || k ELSE 'Renderer ' || k END, idx) AS process_name
  FROM e WHERE et = 'signup' GROUP BY ALL), th AS (
  SELECT c.trace_id, c.pid || ':' || c.tid AS "threadKey", c.pid, c.tid, thread_name AS "threadName",
    process_name AS "processName", n AS "eventCount"
  FROM (SELECT trace_id, pid, tid, count(*) AS n FROM e GROUP BY ALL) c
  LEFT JOIN tn USING (trace_id, pid, tid) LEFT JOIN pn USING (trace_id, pid))"""


@query(
    "d01_thread_names",
    with_events(NAMES + ' SELECT trace_id, pid, tid, thread_name AS "threadName" FROM tn'),
)
def thread_names(spark, sf_dir):
    return dims.thread_names(named_trace(spark, sf_dir))


@query("d02_threads", with_events(NAMES + " SELECT * FROM th"))
def threads(spark, sf_dir):
    return dims.threads(named_trace(spark, sf_dir))


@query(
    "d03_processes",
    with_events(
        NAMES
        + """ SELECT c.trace_id, CAST(c.pid AS VARCHAR) AS "processId", c.pid, process_name AS "processName",
  t AS "threadCount", n AS "eventCount"
FROM (SELECT trace_id, pid, count(DISTINCT tid) AS t, count(*) AS n FROM e GROUP BY ALL) c
LEFT JOIN pn USING (trace_id, pid)"""
    ),
)
def processes(spark, sf_dir):
    return dims.processes(named_trace(spark, sf_dir))


@query(
    "d04_frames",
    with_events("""
SELECT trace_id, 'F' || k AS "frameId", arg_min(CASE WHEN et = 'view' THEN 'x' END, idx) AS url,
  count(*) AS "eventCount", count(DISTINCT pid || ':' || tid) AS "threadCount"
FROM e WHERE et IN ('view', 'purchase') GROUP BY 1, 2"""),
)
def frames(spark, sf_dir):
    return dims.frames(facts.event_facts(named_trace(spark, sf_dir), keep_args=False))


@query(
    "d05_workers",
    with_events(
        NAMES
        + """, w AS (
  SELECT trace_id, CAST(k AS VARCHAR) AS id, pid || ':' || tid AS t, 'https://w/' || k AS url FROM e WHERE et = 'click'
  UNION ALL SELECT trace_id, 'thread:' || "threadKey", "threadKey", NULL FROM th
  WHERE regexp_matches(coalesce("threadName", ''), '(?i)worker') OR regexp_matches(coalesce("processName", ''), '(?i)worker'))
SELECT trace_id, id AS "workerId", count(DISTINCT t) AS "threadCount",
  coalesce(string_agg(DISTINCT url, ',' ORDER BY url), '') AS urls FROM w GROUP BY 1, 2"""
    ),
)
def workers(spark, sf_dir):
    events = named_trace(spark, sf_dir)
    rows = dims.workers(facts.event_facts(events, keep_args=False), dims.threads(events))
    return rows.withColumn("urls", F.array_join("urls", ","))


@query(
    "d06_layers",
    with_events("""
SELECT trace_id, CAST(k AS VARCHAR) AS "layerId", count(*) AS "eventCount",
  string_agg(DISTINCT et, ',' ORDER BY et) AS "eventNames" FROM e WHERE et = 'purchase' GROUP BY 1, 2"""),
)
def layers(spark, sf_dir):
    rows = dims.layers(facts.event_facts(named_trace(spark, sf_dir), keep_args=False))
    return rows.withColumn("eventNames", F.array_join("eventNames", ","))
