"""CPU profile operators: most events are profile chunks that declare and sample nodes.

Node ids follow ``k``; the parent of node n is n div 3.  A node is declared by the
first event with its ``k``, so early samples see only part of the tree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators.closure import ancestor_closure
from quarrylens.plans import cpu, dims
from quarrylens.queries.dim_queries import TASKS, main_trace
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.star_events import by_type, read_table, trace_of

HALF_DAY_US = 43_200_000_000


def _rounded(rows, *names):
    for name in names:
        rows = rows.withColumn(name, F.round(name, 6))
    return rows


def _quarters():
    """A delta in quarters of a microsecond: times of this size hold them exactly, in any order of adding."""
    return F.floor(F.col("value") * 4000) / F.lit(4.0)


def profile_trace(spark, sf_dir):
    names = {t: "ProfileChunk" for t in ("click", "view", "signup", "error")}
    names["purchase"] = "EventTiming"

    def args():
        chunk = F.col("et") != "purchase"
        node_id, parent = F.col("k") + 1, F.floor((F.col("k") + 1) / 3)
        frame = F.struct(
            F.when(node_id % 10 != 9, F.concat(F.lit("f"), (node_id % 10).cast("string"))).otherwise("").alias("functionName"),
            F.when(node_id > 50, F.concat(F.lit("s"), (node_id % 3).cast("string"))).alias("scriptId"),
            F.when(node_id % 2 == 0, "a.js").alias("url"),
            node_id.alias("lineNumber"),
        )
        node = F.struct(node_id.alias("id"), F.when(parent > 0, parent).alias("parent"), frame.alias("callFrame"))
        profile = F.struct(
            F.array(node).alias("nodes"),
            F.array(node_id, F.col("uid") % 100 + 1).alias("samples"),
        )
        deltas = F.array(_quarters(), F.col("k") + 0.25)
        data = F.struct(
            F.when(chunk, profile).alias("cpuProfile"),
            F.when(chunk, deltas).alias("timeDeltas"),
            by_type({"purchase": F.lit("click")}).alias("type"),
            by_type({"purchase": F.col("rawIndex") + 1}).alias("interactionId"),
            by_type({"purchase": F.col("value") * 60000}).alias("duration"),
        )
        return F.struct(data.alias("data"))

    return trace_of(spark, sf_dir, names, {t: "P" for t in names}, args)


SAMPLES = """, c AS (SELECT *, floor(value * 4000) / CAST(4 AS DOUBLE) AS d4 FROM e WHERE et <> 'purchase'), s AS (
  SELECT trace_id, idx, 0 AS pos, k + 1 AS node, d4 AS delta, ts + d4 AS ts FROM c
  UNION ALL SELECT trace_id, idx, 1, uid % 100 + 1, k + CAST(0.25 AS DOUBLE), ts + d4 + k + CAST(0.25 AS DOUBLE) FROM c), d AS (
  SELECT trace_id, k + 1 AS node, min(idx) AS since, count(*) AS times FROM c GROUP BY ALL)"""
NAME = "CASE WHEN {n} % 10 <> 9 THEN 'f' || ({n} % 10) ELSE '(anonymous)' END"
# Walks up from each sample while the node is declared by the sample's chunk.
STACKS = f""", up AS (
  SELECT s.trace_id, s.idx, s.pos, s.node AS at, s.node // 3 AS parent, d.since IS NOT NULL AS known,
    CAST(s.node AS VARCHAR) AS ids, CASE WHEN d.since IS NOT NULL THEN {NAME.format(n="s.node")} ELSE '(anonymous)' END AS label
  FROM s LEFT JOIN d ON d.trace_id = s.trace_id AND d.node = s.node AND d.since <= s.idx
  UNION ALL
  SELECT up.trace_id, up.idx, up.pos, up.parent, up.parent // 3, d.since IS NOT NULL,
    up.parent || '/' || ids, CASE WHEN d.since IS NOT NULL THEN {NAME.format(n="up.parent")} ELSE '(anonymous)' END || ' > ' || label
  FROM up LEFT JOIN d ON d.trace_id = up.trace_id AND d.node = up.parent AND d.since <= up.idx
  WHERE up.known AND up.parent > 0), st AS (
  SELECT trace_id, idx, pos, ids, label FROM up WHERE NOT known OR parent = 0), sm AS (
  SELECT s.*, ids, label, d.since IS NOT NULL AS known,
    CASE WHEN d.since IS NOT NULL THEN {NAME.format(n="s.node")} ELSE '(anonymous)' END AS fn,
    CASE WHEN d.since IS NOT NULL AND s.node % 2 = 0 THEN 'a.js' END AS url,
    CASE WHEN d.since IS NOT NULL AND s.node > 50 THEN 's' || (s.node % 3) END AS sid
  FROM s JOIN st USING (trace_id, idx, pos) LEFT JOIN d ON d.trace_id = s.trace_id AND d.node = s.node AND d.since <= s.idx)"""


def cpu_rows(spark, sf_dir):
    no_scripts = spark.createDataFrame([], "trace_id string, scriptId string, sourceMapId string")
    return cpu.cpu_samples(profile_trace(spark, sf_dir), no_scripts)


@query(
    "e07_cpu_samples",
    with_events(
        SAMPLES
        + STACKS
        + """
SELECT trace_id, 'cpu-sample:' || (row_number() OVER (PARTITION BY trace_id ORDER BY idx, pos) - 1) AS "sampleId",
  'evt:' || idx AS "eventId", ts AS "tsUs", delta AS "timeDeltaUs", CAST(node AS VARCHAR) AS "nodeId",
  CASE WHEN known AND node // 3 > 0 THEN CAST(node // 3 AS VARCHAR) END AS "parentNodeId", fn AS "functionName", url, sid AS "scriptId",
  ids AS "stackNodeIds", label AS "stackLabel" FROM sm""",
        recursive=True,
    ),
)
def cpucpu_rows(spark, sf_dir):
    return cpu.number_samples(cpu_rows(spark, sf_dir)).select(
        "trace_id",
        "sampleId",
        "eventId",
        "tsUs",
        "timeDeltaUs",
        "nodeId",
        "parentNodeId",
        "functionName",
        "url",
        "scriptId",
        F.array_join("stackNodeIds", "/").alias("stackNodeIds"),
        "stackLabel",
    )


NODES = """, own AS (SELECT trace_id, node, count(*) AS n, sum(delta) AS us FROM s GROUP BY ALL), cl AS (
  SELECT trace_id, node, node AS anc FROM (SELECT trace_id, node FROM d UNION SELECT trace_id, node FROM own)
  UNION ALL SELECT cl.trace_id, cl.node, cl.anc // 3 FROM cl SEMI JOIN d ON d.trace_id = cl.trace_id AND d.node = cl.anc
  WHERE cl.anc // 3 > 0), tot AS (
  SELECT cl.trace_id, anc AS node, sum(n) AS tn, sum(us) AS tus FROM cl JOIN own ON own.trace_id = cl.trace_id AND own.node = cl.node GROUP BY 1, 2), nd AS (
  SELECT d.trace_id, CAST(d.node AS VARCHAR) AS "nodeId", CASE WHEN d.node // 3 > 0 THEN CAST(d.node // 3 AS VARCHAR) END AS "parentNodeId",
    """ + NAME.format(n="d.node") + """ AS "functionName", coalesce(n, 0) AS "selfSampleCount", CAST(coalesce(tn, 0) AS BIGINT) AS "totalSampleCount",
    round(coalesce(us, 0) / 1000, 6) AS "selfTimeMs", round(coalesce(tus, 0) / 1000, 6) AS "totalTimeMs"
  FROM d LEFT JOIN own ON own.trace_id = d.trace_id AND own.node = d.node LEFT JOIN tot ON tot.trace_id = d.trace_id AND tot.node = d.node)"""


@query("e08_cpu_nodes", with_events(SAMPLES + NODES + " SELECT * FROM nd", recursive=True))
def cpu_nodes(spark, sf_dir):
    rows = cpu.cpu_nodes(profile_trace(spark, sf_dir)).select(
        "trace_id",
        "nodeId",
        "parentNodeId",
        "functionName",
        "selfSampleCount",
        "totalSampleCount",
        "selfTimeMs",
        "totalTimeMs",
    )
    return _rounded(rows, "selfTimeMs", "totalTimeMs")


@query(
    "e12_cpu_hotspots",
    with_events(
        SAMPLES
        + NODES
        + """ SELECT trace_id, 'cpu:' || "nodeId" AS "cpuHotspotId", "functionName", "selfSampleCount" AS "sampleCount",
  "totalSampleCount", "selfTimeMs", "totalTimeMs" FROM nd WHERE "selfSampleCount" > 0""",
        recursive=True,
    ),
)
def cpu_hotspots(spark, sf_dir):
    rows = cpu.cpu_hotspots(cpu.cpu_nodes(profile_trace(spark, sf_dir))).select(
        "trace_id",
        "cpuHotspotId",
        "functionName",
        "sampleCount",
        "totalSampleCount",
        "selfTimeMs",
        "totalTimeMs",
    )
    return _rounded(rows, "selfTimeMs", "totalTimeMs")


@query(
    "e06_node_declarations",
    with_events(
        SAMPLES
        + """ SELECT trace_id, CAST(node AS VARCHAR) AS "nodeId", since, """
        + NAME.format(n="node")
        + """ AS "functionName", CAST(node AS INTEGER) AS "lineNumber" FROM d"""
    ),
)
def node_declarations(spark, sf_dir):
    chunks = cpu.profile_chunks(profile_trace(spark, sf_dir))
    return cpu.node_versions(cpu.node_declarations(chunks)).select(
        "trace_id", "nodeId", "since", "functionName", "lineNumber"
    )


@query(
    "e09_tree_closure",
    """WITH RECURSIVE own AS (SELECT l_partkey AS p, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), cl AS (
  SELECT p_partkey AS d, p_partkey AS a, 0 AS depth FROM part
  UNION ALL SELECT d, a // 4, depth + 1 FROM cl WHERE a > 0)
SELECT a AS p_partkey, count(*) AS nodes, CAST(coalesce(sum(q), 0) AS BIGINT) AS quantity
FROM cl LEFT JOIN own ON own.p = cl.d GROUP BY 1""",
)
def tree_closure(spark, sf_dir):
    """Quantities summed up a tree of parts where the parent of p is p div 4."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey")
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4))
    edges = parts.withColumn("parent", parent)
    closure = ancestor_closure(parts, edges, [], "p_partkey", "p_partkey", "parent")
    own = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("descendant"))
        .agg(F.sum("l_quantity").cast("bigint").alias("q"))
    )
    return (
        closure.join(own, "descendant", "left")
        .groupBy(F.col("ancestor").alias("p_partkey"))
        .agg(
            F.sum("paths").alias("nodes"),
            F.sum(F.coalesce("q", F.lit(0)) * F.col("paths")).alias("quantity"),
        )
    )


@query(
    "e10_cpu_call_trees",
    with_events(
        SAMPLES
        + STACKS
        + """, g AS (SELECT trace_id, label, count(*) AS n, sum(delta) AS us, min(idx * 2 + pos) AS first, arg_min(node, idx * 2 + pos) AS node FROM sm GROUP BY 1, 2)
SELECT trace_id, 'cpu-stack:' || (row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1) AS "stackId", label AS "stackLabel",
  n AS "sampleCount", round(us / 1000, 6) AS "totalTimeMs", CAST(node AS VARCHAR) AS "topNodeId" FROM g""",
        recursive=True,
    ),
)
def cpu_call_trees(spark, sf_dir):
    return _rounded(cpu.cpu_call_trees(cpu_rows(spark, sf_dir)), "totalTimeMs")


@query(
    "e11_cpu_timeline",
    with_events(
        SAMPLES
        + STACKS
        + f""", pf AS (SELECT trace_id, CAST(floor(ts / {HALF_DAY_US}) AS BIGINT) AS b, fn, count(*) AS n, sum(delta) AS us, min(idx * 2 + pos) AS first FROM sm GROUP BY 1, 2, 3), rk AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id, b ORDER BY n DESC, first) AS r FROM pf)
SELECT trace_id, 'cpu-bucket:' || b AS "bucketId", b * {HALF_DAY_US} AS "startTsUs", (b + 1) * {HALF_DAY_US} AS "endTsUs",
  CAST(sum(n) AS BIGINT) AS "sampleCount", round(sum(us) / 1000, 6) AS "totalTimeMs",
  string_agg(fn || '=' || n, ',' ORDER BY r) FILTER (r <= 5) AS "topFunctions" FROM rk GROUP BY trace_id, b""",
        recursive=True,
    ),
)
def cpu_timeline(spark, sf_dir):
    rows = cpu.cpu_timeline(cpu_rows(spark, sf_dir), HALF_DAY_US)
    tops = F.array_join(
        F.transform("topFunctions", lambda t: F.concat_ws("=", t["functionName"], t["count"])), ","
    )
    return _rounded(rows.withColumn("topFunctions", tops), "totalTimeMs")


def _scoped(scope, windows):
    return f"""
SELECT sm.trace_id, w.id AS "scopeId", CAST(node AS VARCHAR) AS "nodeId", fn AS "functionName", url, count(*) AS "sampleCount",
  round(sum(delta) / 1000, 6) AS "totalTimeMs", '{scope}-cpu:' || w.id || ':' || node AS "{scope}CpuHotspotId"
FROM ({windows}) w JOIN sm ON sm.trace_id = w.trace_id AND sm.ts >= w.lo AND sm.ts <= w.hi GROUP BY sm.trace_id, w.id, node, fn, url"""


@query(
    "e14_interaction_cpu_hotspots",
    with_events(
        SAMPLES
        + STACKS
        + _scoped(
            "interaction",
            "SELECT trace_id, CAST(idx + 1 AS VARCHAR) AS id, ts AS lo, ts + value * 60000 * 1000 AS hi FROM e WHERE et = 'purchase'",
        ),
        recursive=True,
    ),
)
def interaction_cpu_hotspots(spark, sf_dir):
    interactions = dims.interactions(profile_trace(spark, sf_dir))
    rows = cpu.interaction_cpu_hotspots(cpu_rows(spark, sf_dir), interactions)
    return _rounded(rows.drop("scriptId"), "totalTimeMs")


@query(
    "e15_task_cpu_hotspots",
    with_events(
        TASKS
        + SAMPLES
        + STACKS
        + _scoped("task", "SELECT trace_id, 'task:' || idx AS id, ts AS lo, end_ts AS hi FROM tasks"),
        recursive=True,
    ),
)
def task_cpu_hotspots(spark, sf_dir):
    tasks = dims.main_thread_tasks(main_trace(spark, sf_dir))
    rows = cpu.task_cpu_hotspots(cpu_rows(spark, sf_dir), tasks)
    return _rounded(rows.drop("scriptId"), "totalTimeMs")
