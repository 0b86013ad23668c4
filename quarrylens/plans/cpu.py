"""CPU profiles: samples, call-tree nodes, folded stacks, timeline and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.operators.closure import root_paths, subtree_sums
from quarrylens.operators.large_join import counted_join
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordinal import ordinal_by_unique, top_per_group
from quarrylens.operators.range_join import CELL, point_stats, spread_range_join
from quarrylens.operators.spreading import spread_counted

ANONYMOUS = "(anonymous)"
BUCKET_US = 5_000
TOP_FUNCTIONS = 5
FOREVER = (1 << 62) - 1
# A state holds its root path, about a kilobyte.


def profile_chunks(events: DataFrame) -> DataFrame:
    """ProfileChunk events with nodes, samples and time deltas as variant arrays."""
    args = F.col("args")
    return events.filter(F.col("name") == "ProfileChunk").select(
        "trace_id",
        F.col("rawIndex").alias("chunk"),
        F.col("ts").alias("chunkTs"),
        p.v_array(args, "$.data.cpuProfile.nodes").alias("nodes"),
        p.v_array(args, "$.data.cpuProfile.samples").alias("samples"),
        F.coalesce(
            p.v_array(args, "$.data.timeDeltas"), p.v_array(args, "$.data.cpuProfile.timeDeltas")
        ).alias("deltas"),
    )


def node_declarations(chunks: DataFrame) -> DataFrame:
    """One row per declared node, in declaration order (chunk, pos)."""
    declared = chunks.select("trace_id", "chunk", F.posexplode("nodes")).withColumnRenamed("col", "n")
    n = F.col("n")
    return declared.select(
        "trace_id",
        "chunk",
        "pos",
        p.v_num_text(n, "$.id").alias("nodeId"),
        p.v_num_text(n, "$.parent").alias("parentNodeId"),
        F.coalesce(p.v_text(n, "$.callFrame.functionName"), F.lit(ANONYMOUS)).alias("functionName"),
        p.v_text(n, "$.callFrame.url").alias("url"),
        p.v_id(n, "$.callFrame.scriptId").alias("scriptId"),
        p.v_num(n, "$.callFrame.lineNumber").cast("int").alias("lineNumber"),
        p.v_num(n, "$.callFrame.columnNumber").cast("int").alias("columnNumber"),
        p.v_text(n, "$.callFrame.codeType").alias("codeType"),
    ).filter(F.col("nodeId").isNotNull())


FRAME_FIELDS = (
    "parentNodeId",
    "functionName",
    "url",
    "scriptId",
    "lineNumber",
    "columnNumber",
    "codeType",
)


def node_versions(declared: DataFrame) -> DataFrame:
    """Definitions of a node with the chunks [since, until) they hold for.

    Equal redeclarations are merged by the first aggregate; only nodes that were
    really redefined go through a per-node window, and where none was, nothing does.
    """
    frame = F.struct(*FRAME_FIELDS)
    node = ["trace_id", "nodeId"]
    at_chunk = declared.groupBy(*node, "chunk").agg(F.max_by(frame, "pos").alias("frame"))
    kinds = at_chunk.groupBy(*node, "frame").agg(F.min("chunk").alias("since"))
    counted = cut(
        kinds.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("since", "frame")).alias("one"))
    )
    stable = counted.filter(F.col("n") == 1).select(
        *node, "one.since", F.lit(FOREVER).alias("until"), "one.frame"
    )
    fields = [*node, "since", "until", "frame.*"]
    several = counted.filter(F.col("n") > 1).select(*node)
    n_several = several.count()
    if not n_several:
        return stable.select(*fields)
    order = Window.partitionBy(*node).orderBy("chunk")
    redefined = counted_join(at_chunk, several, node, n_several, "left_semi")
    changes = redefined.withColumn("prev", F.lag("frame").over(order)).filter(
        ~F.col("frame").eqNullSafe(F.col("prev"))
    )
    changing = changes.select(
        *node,
        F.col("chunk").alias("since"),
        F.coalesce(F.lead("chunk").over(order), F.lit(FOREVER)).alias("until"),
        "frame",
    )
    return stable.unionByName(changing).select(*fields)


def node_states(declared: DataFrame) -> DataFrame:
    """Definition and root path of each node per period in which both stay the same.

    Ids used before or without a declaration have a path but no definition.
    """
    versions = cut(node_versions(declared))
    node = ["trace_id", "nodeId"]
    first = versions.groupBy(*node).agg(F.min("since").alias("until"))
    mentioned = versions.select("trace_id", F.col("parentNodeId").alias("nodeId")).union(
        versions.select(*node)
    )
    undeclared = (
        mentioned.filter(F.col("nodeId").isNotNull())
        .distinct()
        .join(first, node, "left")
        .select(
            *node,
            F.lit(-1).cast("bigint").alias("since"),
            F.coalesce("until", F.lit(FOREVER)).alias("until"),
            F.lit(None).cast("string").alias("parentNodeId"),
            F.lit(ANONYMOUS).alias("functionName"),
        )
    )
    every = versions.select(*undeclared.columns).unionByName(undeclared)
    paths = root_paths(
        every, ["trace_id"], "nodeId", "parentNodeId", "functionName", "since", "until"
    )
    definition = versions.withColumnsRenamed({"since": "v_since", "until": "v_until"})
    during = (F.col("since") >= F.col("v_since")) & (F.col("since") < F.col("v_until"))
    same = (F.col("trace_id") == F.col("s_trace")) & (F.col("nodeId") == F.col("s_node"))
    return (
        paths.select(
            F.col("trace_id").alias("s_trace"),
            F.col("node").alias("s_node"),
            "since",
            "until",
            F.col("ids").alias("stackNodeIds"),
            F.array_join("labels", " > ").alias("stackLabel"),
        )
        .join(definition, same & during, "left")
        .select(
            "s_trace", "s_node", "since", "until", "stackNodeIds", "stackLabel", *FRAME_FIELDS
        )
    )


def sample_points(chunks: DataFrame) -> DataFrame:
    """Samples with their times: chunk time plus the deltas up to the sample."""
    exploded = chunks.select(
        "trace_id", "chunk", "chunkTs", "deltas", F.posexplode("samples")
    ).withColumnRenamed("col", "sample")
    numeric = exploded.select(
        "trace_id",
        "chunk",
        "chunkTs",
        "pos",
        p.v_num_text(F.col("sample"), "$").alias("nodeId"),
        F.coalesce(p.v_num(F.get("deltas", F.col("pos")), "$"), F.lit(0.0)).alias("timeDeltaUs"),
    ).filter(F.col("nodeId").isNotNull())
    # One chunk is one event, so this window is bounded by the event.
    upto = (
        Window.partitionBy("trace_id", "chunk")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return numeric.withColumn("tsUs", F.col("chunkTs") + F.sum("timeDeltaUs").over(upto))


def cpu_samples(events: DataFrame, scripts: DataFrame) -> DataFrame:
    """``devtools.facts.cpuSamples`` with node definitions as of each chunk.

    Script lookups are made per node, so samples are joined once.
    """
    chunks = profile_chunks(events)
    script_map = scripts.filter(F.col("sourceMapId").isNotNull()).select(
        F.col("trace_id").alias("s_trace"), "scriptId", "sourceMapId"
    )
    states = cut(
        node_states(cut(node_declarations(chunks))).join(script_map, ["s_trace", "scriptId"], "left")
    )
    points = sample_points(chunks)
    # At most one state of a node is in force at a chunk.
    in_force = (
        (F.col("trace_id") == F.col("s_trace"))
        & (F.col("nodeId") == F.col("s_node"))
        & (F.col("chunk") >= F.col("since"))
        & (F.col("chunk") < F.col("until"))
    )
    return (
        counted_join(points, states, in_force, states.count(), "left")
        .select(
            "trace_id",
            F.concat_ws(":", F.lit("evt"), "chunk").alias("eventId"),
            "chunk",
            "pos",
            "tsUs",
            "timeDeltaUs",
            "nodeId",
            "parentNodeId",
            F.coalesce("functionName", F.lit(ANONYMOUS)).alias("functionName"),
            "url",
            "scriptId",
            "lineNumber",
            "columnNumber",
            "codeType",
            F.coalesce("stackNodeIds", F.array("nodeId")).alias("stackNodeIds"),
            F.coalesce("stackLabel", F.lit(ANONYMOUS)).alias("stackLabel"),
            "sourceMapId",
        )
    )


def number_samples(samples: DataFrame) -> DataFrame:
    """Add ``sampleId``: dense position by (chunk, pos) within the trace."""
    per_chunk = samples.groupBy("trace_id", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    cell = F.floor(F.col("chunk") / (1 << 16))
    per_cell = per_chunk.groupBy("trace_id", cell.alias("_cell")).agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy("trace_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_base = per_cell.select(
        "trace_id", "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_cb")
    )
    inside = (
        Window.partitionBy("trace_id", "_cell")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = (
        per_chunk.withColumn("_cell", cell)
        .withColumn("_b", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(cell_base, ["trace_id", "_cell"])
        .select("trace_id", "chunk", (F.col("_b") + F.col("_cb")).alias("_base"))
    )
    rank = F.row_number().over(Window.partitionBy("trace_id", "chunk").orderBy("pos"))
    return (
        samples.withColumn("_rn", rank)
        .join(base, ["trace_id", "chunk"])
        .withColumn(
            "sampleId",
            F.concat(F.lit("cpu-sample:"), (F.col("_base") + F.col("_rn") - 1).cast("string")),
        )
        .drop("_rn", "_base")
    )


def cpu_nodes(events: DataFrame) -> DataFrame:
    """``devtools.dims.cpuNodes``: last definition, own and subtree totals.

    Samples are summed per node before they are added up the tree.
    """
    chunks = profile_chunks(events)
    declared = cut(node_declarations(chunks))
    node = ["trace_id", "nodeId"]
    order = F.struct("chunk", "pos")
    last = declared.groupBy(*node).agg(
        F.max_by(F.struct(*FRAME_FIELDS), order).alias("frame"),
        F.count(F.lit(1)).alias("declarations"),
    )
    own = cut(
        sample_points(chunks)
        .groupBy(*node)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("timeDeltaUs").alias("us"))
    )
    edges = declared.select(*node, "parentNodeId").filter(F.col("parentNodeId").isNotNull())
    summed = own.withColumnsRenamed({"n": "tn", "us": "tus"})
    totals = subtree_sums(summed, edges, ["trace_id"], "nodeId", "nodeId", "parentNodeId", ["tn", "tus"])
    zero = F.lit(0)
    return (
        last.join(own, node, "left")
        .join(totals, node, "left")
        .select(
            "trace_id",
            F.col("nodeId").alias("cpuNodeId"),
            "nodeId",
            "frame.*",
            F.coalesce("n", zero).alias("selfSampleCount"),
            F.coalesce("tn", zero).alias("totalSampleCount"),
            (F.coalesce("us", zero) / 1000).alias("selfTimeMs"),
            (F.coalesce("tus", zero) / 1000).alias("totalTimeMs"),
        )
    )


def cpu_call_trees(samples: DataFrame) -> DataFrame:
    """``devtools.views.cpuCallTrees``: samples folded by stack, in order of first use.

    Two stacks cannot share their first sample, so that position is a unique key.
    """
    label = F.when(F.col("stackLabel") != "", F.col("stackLabel")).otherwise(F.col("functionName"))
    folded = samples.groupBy("trace_id", label.alias("stackLabel")).agg(
        F.count(F.lit(1)).alias("sampleCount"),
        (F.sum("timeDeltaUs") / 1000).alias("totalTimeMs"),
        F.min(F.struct("chunk", "pos", "nodeId")).alias("first"),
    )
    ordered = ordinal_by_unique(
        folded.withColumn("_at", F.col("first.chunk") * (1 << 27) + F.col("first.pos")),
        ["trace_id"],
        "_at",
        "_n",
        cell_width=1 << 40,
    )
    return ordered.select(
        "trace_id",
        F.concat(F.lit("cpu-stack:"), F.col("_n").cast("string")).alias("stackId"),
        "stackLabel",
        "sampleCount",
        "totalTimeMs",
        F.col("first.nodeId").alias("topNodeId"),
    )


def cpu_timeline(samples: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """``devtools.views.cpuTimeline``: 5 ms buckets with their five busiest functions."""
    bucket = F.floor(F.col("tsUs") / bucket_us)
    per_function = samples.groupBy("trace_id", bucket.alias("bucket"), "functionName").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("timeDeltaUs").alias("us"),
        F.min(F.struct("chunk", "pos")).alias("first"),
    )
    key = ["trace_id", "bucket"]
    totals = per_function.groupBy(*key).agg(
        F.sum("count").alias("sampleCount"), (F.sum("us") / 1000).alias("totalTimeMs")
    )
    best = top_per_group(per_function, key, [F.col("count").desc(), F.col("first")], TOP_FUNCTIONS)
    tops = best.groupBy(*key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", "functionName", "count"))),
            lambda t: F.struct(t["functionName"].alias("functionName"), t["count"].alias("count")),
        ).alias("topFunctions")
    )
    start = F.col("bucket") * bucket_us
    return totals.join(tops, key).select(
        "trace_id",
        F.concat(F.lit("cpu-bucket:"), F.col("bucket").cast("string")).alias("bucketId"),
        start.alias("startTsUs"),
        (start + bucket_us).alias("endTsUs"),
        "sampleCount",
        "totalTimeMs",
        "topFunctions",
    )


def cpu_hotspots(nodes: DataFrame) -> DataFrame:
    """``devtools.views.cpuHotspots``: nodes that were sampled themselves."""
    return nodes.filter(F.col("selfSampleCount") > 0).select(
        "trace_id",
        F.concat(F.lit("cpu:"), "nodeId").alias("cpuHotspotId"),
        "nodeId",
        "functionName",
        "url",
        "scriptId",
        "lineNumber",
        "columnNumber",
        "codeType",
        F.col("selfSampleCount").alias("sampleCount"),
        "totalSampleCount",
        "selfTimeMs",
        "totalTimeMs",
    )


def window_cpu_hotspots(
    samples: DataFrame, windows: DataFrame, scope: str, scope_id: Column, start: str, end: str
) -> DataFrame:
    """Samples inside each window, per node: count and time.

    Samples of one node at one time are summed before the join.  A task holds a bounded number of
    samples, and of pairs of them and windows, however many bytes they take between tasks.
    """
    grain = ["trace_id", "nodeId", "functionName", "url", "tsUs"]
    sampled = cut(samples.select(*grain, "timeDeltaUs", "scriptId"))
    known = point_stats(sampled, ["trace_id"], "tsUs", ["nodeId", "functionName", "url"])
    points = spread_counted(sampled, known.rows, "trace_id", "nodeId", "tsUs").groupBy(*grain).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("timeDeltaUs").alias("us"),
        F.min("scriptId").alias("scriptId"),
    )
    scopes = windows.select(
        "trace_id", scope_id.alias("scopeId"), F.col(start).alias("winStart"), F.col(end).alias("winEnd")
    )
    inside, tasks = spread_range_join(
        points, scopes, ["trace_id"], "tsUs", "winStart", "winEnd", known_points=known
    )
    found = ["trace_id", "scopeId", "nodeId", "functionName", "url"]
    in_cell = inside.groupBy(*found, *CELL).agg(
        F.min(F.struct("tsUs", "scriptId")).alias("first"), F.sum("n").alias("n"), F.sum("us").alias("us")
    )
    return (
        in_cell.repartition(tasks, "trace_id", "scopeId")
        .groupBy(*found)
        .agg(
            F.min("first")["scriptId"].alias("scriptId"),
            F.sum("n").alias("sampleCount"),
            (F.sum("us") / 1000).alias("totalTimeMs"),
        )
        .withColumn(
            f"{scope}CpuHotspotId",
            F.concat(F.lit(f"{scope}-cpu:"), "scopeId", F.lit(":"), "nodeId"),
        )
    )


def interaction_cpu_hotspots(samples: DataFrame, interactions: DataFrame) -> DataFrame:
    return window_cpu_hotspots(
        samples, interactions, "interaction", F.col("interactionId"), "startTsUs", "endTsUs"
    )


def task_cpu_hotspots(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    end = F.col("tsUs") + F.col("durationMs") * 1000
    spans = tasks.withColumn("taskEnd", end).withColumnRenamed("tsUs", "taskStart")
    return window_cpu_hotspots(samples, spans, "task", F.col("taskId"), "taskStart", "taskEnd")
