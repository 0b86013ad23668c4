"""One opened source: its tables, reports, artifacts and file collections.

Every table is a lazy DataFrame, built when first asked for.  A dataset may span
many files; ``trace_id`` tells them apart and leads every key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.operators.json_walk import walk_json
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordering import ordering
from quarrylens.operators.spreading import spread_rows
from quarrylens.plans import artifacts as art
from quarrylens.plans import chunks as ch
from quarrylens.plans import cpu, dims, facts, rawjson, reports, views
from quarrylens.plans import module_graph as mg
from quarrylens.plans.provenance import provenance
from quarrylens.plans.shredded import carried
from quarrylens.plans.table_plan import TablePlan, TableQuery
from quarrylens.sources import module_graph as mg_files
from quarrylens.sources.classify import classify
from quarrylens.sources.documents import dataset_id, document_errors, read_documents
from quarrylens.sources.export import ExportResult, export_collection, materialize_artifact
from quarrylens.sources.json_stream import ingest_documents
from quarrylens.sources.trace_events import trace_events, trace_metadata
from quarrylens.sources.trace_stream import failed_files, ingest_traces, list_files, split_metadata
from quarrylens.shipping import ship_package

INFERRED = "raw.inferred."
FOUND_ARRAY = "Array found in the document"


@dataclass
class TableSpec:
    """How a table is built, and the order its rows are listed in."""

    build: Callable[[], DataFrame]
    order: Sequence[str] = ()
    description: str = ""
    units: dict[str, str] = field(default_factory=dict)


@dataclass
class CollectionSpec:
    """Items of a collection, and the artifacts they are taken from."""

    items: Callable[[], DataFrame]
    description: str = ""
    artifacts: Callable[[], DataFrame] | None = None


class Dataset:
    """Tables, reports, artifacts and collections of one source."""

    def __init__(self, spark: SparkSession, kind: str, manifest: DataFrame, collation: str | None = None):
        self.spark = spark
        self.kind = kind
        self.manifest = manifest
        self.collation = collation
        self.specs: dict[str, TableSpec] = {}
        self.report_specs: dict[str, tuple[Callable[..., Any], str]] = {}
        self.collection_specs: dict[str, CollectionSpec] = {}
        self.raw_specs: dict[str, Callable[[], DataFrame]] = {}
        self.capability_builder: Callable[[], DataFrame] | None = None
        self.artifact_builder: Callable[[], DataFrame] | None = None
        self.document_builder: Callable[[], DataFrame] | None = None
        self.error_builder: Callable[[], DataFrame] | None = None
        # Tables that are found by name instead of being listed: any number may exist.
        self.found_table: Callable[[str], TableSpec | None] = lambda name: None
        self.found_names: Callable[[], DataFrame] | None = None
        self._frames: dict[str, DataFrame] = {}

    # Registration -----------------------------------------------------------------
    def add_table(self, name: str, build, order=(), description: str = "", units=None) -> None:
        self.specs[name] = TableSpec(build, order, description, units or _units_of(name))

    def add_report(self, name: str, run, description: str = "") -> None:
        self.report_specs[name] = (run, description)

    # Tables -----------------------------------------------------------------------
    def spec(self, name: str) -> TableSpec:
        spec = self.specs.get(name) or self.found_table(name)
        if spec is None:
            raise KeyError(f"Table not found: {name}")
        return spec

    def frame(self, name: str) -> DataFrame:
        """The table as a DataFrame without an order; trees, samples and windows write parts of it."""
        if name not in self._frames:
            self._frames[name] = self.spec(name).build()
        return self._frames[name]

    def table(self, name: str) -> TableQuery:
        """Query handle with select, where, order_by, offset, limit, rows, count."""
        frame = self.frame(name)
        return TableQuery(frame, ordering(self.spec(name).order), TablePlan(), self.collation)

    def materialize(self, *names: str) -> None:
        """Write tables to the checkpoint folder, so later tables read instead of redo them."""
        for name in names:
            self._frames[name] = cut(self.frame(name))

    def provenance(self, name: str) -> DataFrame:
        """(trace_id, layer, rowId, eventId): the events behind each row of a trace table.

        Events that look like a row's source, but gave none, are left out.
        """
        if name in EVENT_TABLES:
            rows = self.frame(name)
            event = F.col("eventId") if "eventId" in rows.columns else facts.event_id()
            row_id = F.col(EVENT_TABLES[name]).cast("string")
            return rows.select("trace_id", F.lit(name).alias("layer"), row_id.alias("rowId"), event.alias("eventId"))
        found = provenance(self.frame("devtools.facts.events"), name)
        if name not in ROW_IDS:
            return found
        rows = self.frame(name).select("trace_id", F.col(ROW_IDS[name]).cast("string").alias("rowId"))
        return found.join(rows, ["trace_id", "rowId"], "left_semi").select("trace_id", "layer", "rowId", "eventId")

    def errors(self) -> DataFrame:
        """(trace_id, path, reason) of the files that could not be read; they give no rows."""
        if self.error_builder is None:
            return self.spark.createDataFrame([], "trace_id string, path string, reason string")
        return self.error_builder()

    def create_views(self, prefix: str = "") -> list[str]:
        """Register every table as a temporary view named with underscores."""
        names = []
        found = [] if self.found_names is None else [r["name"] for r in self.found_names().toLocalIterator()]
        for name in [*self.specs, *sorted(found)]:
            view = prefix + name.replace(".", "_").replace("-", "_")
            self.frame(name).createOrReplaceTempView(view)
            names.append(view)
        return names

    # Catalog ----------------------------------------------------------------------
    def tables(self) -> DataFrame:
        rows = [(n, n.split(".")[0], s.description) for n, s in sorted(self.specs.items())]
        listed = self.spark.createDataFrame(rows, "name string, namespace string, description string")
        return listed if self.found_names is None else listed.unionByName(self.found_names())

    def columns(self, name: str) -> DataFrame:
        """(name, type, unit) of one table's columns."""
        units = self.spec(name).units
        rows = [
            (f.name, f.dataType.simpleString(), units.get(f.name) or _unit(f.name))
            for f in self.frame(name).schema.fields
        ]
        return self.spark.createDataFrame(rows, "name string, type string, unit string")

    def reports(self) -> DataFrame:
        rows = [(n, d) for n, (_, d) in sorted(self.report_specs.items())]
        return self.spark.createDataFrame(rows, "name string, description string")

    def collections(self) -> DataFrame:
        rows = [(n, s.description) for n, s in sorted(self.collection_specs.items())]
        return self.spark.createDataFrame(rows, "id string, description string")

    def namespaces(self) -> list[str]:
        return sorted({n.split(".")[0] for n in (*self.specs, *self.report_specs)})

    def capabilities(self) -> DataFrame:
        return self.capability_builder()

    # Reports ----------------------------------------------------------------------
    def report(self, name: str, **args: Any) -> Any:
        if name not in self.report_specs:
            raise KeyError(f"Report not found: {name}")
        return self.report_specs[name][0](**args)

    # Raw access -------------------------------------------------------------------
    def raw_document(self) -> DataFrame:
        """(trace_id, path, text, doc): whole documents, which must fit a Spark value."""
        return self.document_builder()

    def raw_rows(self, name: str) -> DataFrame:
        if name in self.raw_specs:
            return self.raw_specs[name]()
        if name.startswith(INFERRED) and "raw.inferred" in self.raw_specs:
            return self.raw_specs["raw.inferred"]().filter(F.col("name") == name)
        raise KeyError(f"Raw rows not found: {name}")

    def _nodes(self) -> DataFrame:
        return walk_json(self.raw_document(), ["trace_id"], "text")

    def schema_paths(self) -> DataFrame:
        return rawjson.path_catalog(self._nodes()).orderBy("path")

    def schema_samples(self, path: str) -> DataFrame:
        return rawjson.path_samples(self._nodes(), path)

    # Artifacts and files ----------------------------------------------------------
    def artifacts(self) -> DataFrame:
        if self.artifact_builder is None:
            schema = "trace_id string, id string, kind string, mediaType string, sizeBytes bigint, filenameHint string, hash string, metadata map<string,string>, content binary"
            return self.spark.createDataFrame([], schema)
        return self.artifact_builder()

    def list_artifacts(self) -> DataFrame:
        return self.artifacts().drop("content").orderBy("id", "trace_id")

    def _of_trace(self, trace_id: str | None) -> DataFrame:
        found = self.artifacts()
        return found if trace_id is None else found.filter(F.col("trace_id") == trace_id)

    def artifact(self, artifact_id: str, trace_id: str | None = None) -> DataFrame:
        """The artifact with its text and JSON forms, one row per trace that has it."""
        return art.artifact_views(self._of_trace(trace_id).filter(F.col("id") == artifact_id))

    def materialize_artifact(self, artifact_id: str, out: str, trace_id: str | None = None) -> str:
        """Write one artifact; ``trace_id`` is needed where several traces have the id."""
        return materialize_artifact(self._of_trace(trace_id), artifact_id, out)

    def collection_items(self, collection_id: str) -> DataFrame:
        if collection_id not in self.collection_specs:
            raise KeyError(f"Collection not found: {collection_id}")
        return self.collection_specs[collection_id].items()

    def export_collection(self, collection_id: str, out: str, per_trace: bool | None = None) -> ExportResult:
        """Write a collection; with several traces, or ``per_trace``, each gets its own folder."""
        items = self.collection_items(collection_id)
        source = self.collection_specs[collection_id].artifacts or self.artifacts
        return export_collection(collection_id, items, source(), out, per_trace)


# The column that identifies a row, where an event that looks like its source may give none.
ROW_IDS = {
    "devtools.dims.interactions": "interactionId",
    "devtools.dims.layoutShifts": "layoutShiftId",
    "devtools.dims.softNavigations": "softNavigationId",
    "devtools.views.renderMeasures": "renderMeasureId",
    "devtools.views.framePipeline": "frameReportId",
}


# Tables with one row per event, and the column that identifies the row.
EVENT_TABLES = {
    "devtools.facts.cpuSamples": "sampleId",
    "devtools.dims.screenshots": "screenshotId",
    "devtools.dims.requestBodies": "requestBodyId",
    "devtools.dims.tasks": "taskId",
    "devtools.views.mainThreadTasks": "taskId",
    "devtools.views.visualChanges": "changeId",
}


def manifest_of(kind: str, files: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per file: what was opened, when, and how much it holds."""
    return files.join(counts, "trace_id", "left").select(
        "trace_id",
        dataset_id(F.col("path")).alias("id"),
        F.lit(kind).alias("kind"),
        F.lit(kind).alias("driverId"),
        F.col("path").alias("source"),
        F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("loadedAt"),
        "fileSizeBytes",
        F.coalesce("itemCount", F.lit(0)).alias("itemCount"),
    )


def _unit(column: str) -> str | None:
    if column.endswith("Us"):
        return "µs"
    if column.endswith("Ms"):
        return "ms"
    return "bytes" if column.endswith(("Size", "Bytes")) else None


def _units_of(table: str) -> dict[str, str]:
    return {"ts": "µs"} if table == "devtools.raw.events" else {}


# Traces -------------------------------------------------------------------------------
def trace_dataset(
    spark: SparkSession,
    events: DataFrame,
    metadata: DataFrame,
    manifest: DataFrame | None = None,
    documents: Callable[[], DataFrame] | None = None,
    collation: str | None = None,
) -> Dataset:
    """A dataset over event rows and (trace_id, metadata JSON text).

    Every report takes a ``trace_id``, since ids repeat between traces.
    """
    if manifest is None:
        manifest = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("itemCount"))
    ds = Dataset(spark, "devtools", manifest, collation)
    t = ds.frame

    def of(trace_id: str | None) -> Callable[[str], DataFrame]:
        return t if trace_id is None else lambda name: t(name).filter(F.col("trace_id") == trace_id)

    def events_of(trace_id: str | None) -> DataFrame:
        return events if trace_id is None else events.filter(F.col("trace_id") == trace_id)

    def add(name: str, build, *order, description: str = "") -> None:
        ds.add_table(name, build, order, description)

    e = "devtools.facts.events"
    add("devtools.raw.events", lambda: facts.raw_events(events), "trace_id", "rawIndex", description="Events as parsed")
    wide = facts.event_facts(events)  # with the argument columns of ingested events
    add(e, lambda: wide.drop(*carried(wide)), "trace_id", "rawIndex", description="Normalized events")
    for name, build in {
        "instantEvents": facts.instant_events,
        "sliceEvents": facts.slice_events,
        "asyncFlows": facts.async_flows,
    }.items():
        add(f"devtools.facts.{name}", lambda b=build: b(t(e)), "trace_id", "rawIndex", description="Events by phase")
    add("devtools.facts.objectLifecycles", lambda: facts.object_lifecycles(t(e)), "-eventCount", "firstTsUs", "trace_id", "objectId", description="Span and events of each object id")
    add("devtools.facts.cpuSamples", lambda: cpu.number_samples(cpu.cpu_samples(events, t("devtools.dims.scripts"))), "tsUs", "sampleId", "trace_id", description="Decoded CPU samples")
    add("devtools.dims.processes", lambda: dims.processes(events), "-eventCount", "pid", "trace_id", description="Processes")
    add("devtools.dims.threads", lambda: dims.threads(events), "-eventCount", "threadKey", "trace_id", description="Threads")
    add("devtools.dims.frames", lambda: dims.frames(t(e)), "-eventCount", "frameId", "trace_id", description="Frames")
    add("devtools.dims.workers", lambda: dims.workers(t(e), t("devtools.dims.threads")), "workerId", "trace_id", description="Workers")
    add("devtools.dims.layers", lambda: dims.layers(t(e)), "-eventCount", "layerId", "trace_id", description="Layers")
    add("devtools.dims.requests", lambda: dims.requests(wide), "startTimeUs", "requestId", "trace_id", description="Request lifecycles")
    add("devtools.dims.requestBodies", lambda: rawjson.request_bodies(events, t("devtools.dims.requests")), "trace_id", "rawIndex", "requestBodyId", description="Payloads of requests")
    add("devtools.dims.screenshots", lambda: dims.screenshots(events), "trace_id", "index", description="Screenshots")
    add("devtools.dims.interactions", lambda: dims.interactions(events), "-durationMs", "startTsUs", "trace_id", "interactionId", description="Interactions")
    add("devtools.dims.tasks", lambda: dims.main_thread_tasks(events), "-durationMs", "tsUs", "trace_id", "rawIndex", description="Main-thread tasks")
    add("devtools.views.mainThreadTasks", lambda: t("devtools.dims.tasks"), "-durationMs", "tsUs", "trace_id", "rawIndex", description="Main-thread tasks")
    add("devtools.dims.scripts", lambda: dims.scripts(events, t("code.dims.sourceMaps")), "#scriptId", "scriptId", "trace_id", description="Scripts")
    add("devtools.dims.layoutShifts", lambda: dims.layout_shifts(events), "trace_id", "rawIndex", description="Layout shifts")
    add("devtools.dims.softNavigations", lambda: dims.soft_navigations(events, t("devtools.dims.tasks")), "startTsUs", "trace_id", "softNavigationId", description="Soft navigations")
    add("devtools.dims.cpuNodes", lambda: cpu.cpu_nodes(events), "-totalSampleCount", "nodeId", "trace_id", description="CPU profile nodes")
    add("devtools.views.renderMeasures", lambda: views.render_measures(events), "trace_id", "rawIndex", description="Component renders")
    add("devtools.views.renderComponentHotspots", lambda: views.render_component_hotspots(t("devtools.views.renderMeasures")), "-totalDurationMs", "-renderCount", "trace_id", "componentName", description="Render time by component")
    add("devtools.views.interactionRenders", lambda: views.interaction_renders(t("devtools.views.renderMeasures"), t("devtools.dims.interactions")), "-totalDurationMs", "interactionId", "trace_id", "componentName", description="Renders inside interactions")
    add("devtools.views.framePipeline", lambda: views.frame_pipeline(events, t("devtools.dims.screenshots")), "trace_id", "rawIndex", description="Frame reports")
    add("devtools.views.codeHotspots", lambda: views.code_hotspots(events, t("devtools.dims.scripts")), *reports.CODE_ORDER, description="Script time by function")
    add("devtools.views.cpuHotspots", lambda: cpu.cpu_hotspots(t("devtools.dims.cpuNodes")), *reports.CPU_ORDER, description="Sampled nodes")
    add("devtools.views.cpuCallTrees", lambda: cpu.cpu_call_trees(t("devtools.facts.cpuSamples")), *reports.STACK_ORDER, description="Folded stacks")
    add("devtools.views.cpuTimeline", lambda: cpu.cpu_timeline(t("devtools.facts.cpuSamples")), "trace_id", "startTsUs", description="CPU samples in 5 ms buckets")
    add("devtools.views.interactionCpuHotspots", lambda: cpu.interaction_cpu_hotspots(t("devtools.facts.cpuSamples"), t("devtools.dims.interactions")), "trace_id", "scopeId", *reports.SCOPED_CPU_ORDER, description="CPU time inside interactions")
    add("devtools.views.taskCpuHotspots", lambda: cpu.task_cpu_hotspots(t("devtools.facts.cpuSamples"), t("devtools.dims.tasks")), "trace_id", "scopeId", *reports.SCOPED_CPU_ORDER, description="CPU time inside tasks")
    add(
        "devtools.views.interactionWindows",
        lambda: views.interaction_windows(
            t("devtools.dims.interactions"),
            t("devtools.views.renderMeasures"),
            t("devtools.dims.requests"),
            t("devtools.dims.screenshots"),
            t("devtools.views.framePipeline"),
            t("devtools.dims.layoutShifts"),
            t("devtools.dims.softNavigations"),
        ),
        "-durationMs",
        "trace_id", "interactionId",
        description="What happened during each interaction",
    )
    add("devtools.views.networkWaterfall", lambda: views.network_waterfall(events, t("devtools.dims.requests")), "trace_id", "startOffsetMs", "requestId", description="Requests in start order")
    add("devtools.views.layoutShiftClusters", lambda: views.layout_shift_clusters(t("devtools.dims.layoutShifts")), "-totalScore", "startTsUs", "trace_id", description="Layout shift sessions")
    add("devtools.views.visualChanges", lambda: views.visual_changes(events, t("devtools.dims.screenshots"), t("devtools.dims.layoutShifts")), "tsUs", "sourceOrder", "rawIndex", "trace_id", description="Screenshots, shifts and paints")
    add("code.dims.sourceMaps", lambda: dims.source_maps(metadata), "trace_id", "mapIndex", description="Source maps")
    add("code.dims.sources", lambda: dims.sources(t("code.dims.sourceMaps")), "trace_id", "mapIndex", "sourceIndex", description="Original sources")

    def hotspots(trace_id=None):
        names = ("codeHotspots", "cpuHotspots", "cpuCallTrees")
        return reports.hotspots_report(*[of(trace_id)(f"devtools.views.{n}") for n in names])

    ds.add_report("devtools.summary", lambda trace_id=None: {"summary": reports.trace_summary(events_of(trace_id), of(trace_id))}, "Counts of everything found")
    ds.add_report("devtools.interaction", lambda id=None, trace_id=None: reports.interaction_report(of(trace_id), id), "One interaction")
    ds.add_report("devtools.frame", lambda frameSequence=None, id=None, trace_id=None: reports.frame_report(of(trace_id), frameSequence or id), "One frame")
    ds.add_report("devtools.request", lambda requestId=None, id=None, url=None, trace_id=None: reports.request_report(of(trace_id), requestId or id, url), "One request")
    ds.add_report("devtools.soft-navigation", lambda softNavigationId=None, id=None, trace_id=None: reports.soft_navigation_report(of(trace_id), softNavigationId or id), "One soft navigation")
    ds.add_report("devtools.hotspots", hotspots, "Code and CPU hotspots of each trace")
    ds.add_report("devtools.script", lambda scriptId=None, url=None, trace_id=None: reports.script_report(of(trace_id), scriptId, url), "One script")

    ds.raw_specs["devtools.raw.events"] = lambda: events
    ds.capability_builder = lambda: reports.trace_capabilities(
        events,
        t("devtools.dims.scripts"),
        t("code.dims.sources"),
        t("code.dims.sourceMaps"),
        t("devtools.dims.screenshots"),
        t("devtools.dims.requestBodies"),
    )
    shots, scripts, bodies = (
        f"devtools.dims.{n}" for n in ("screenshots", "scripts", "requestBodies")
    )
    maps, sources = "code.dims.sourceMaps", "code.dims.sources"

    def collection(name, items, table, build) -> None:
        ds.collection_specs[name] = CollectionSpec(
            lambda: items(t(table)), f"Files of {table}", build
        )

    collection("devtools.screenshots", art.screenshot_files, shots, lambda: art.screenshot_artifacts(t(shots)))
    collection("devtools.scripts", art.script_files, scripts, lambda: art.script_artifacts(t(scripts), dims.script_texts(events)))
    collection("devtools.network-bodies", art.body_files, bodies, lambda: art.body_artifacts(t(bodies)))
    collection("code.source-maps", art.source_map_files, maps, lambda: art.source_map_artifacts(t(maps)))
    collection("code.sources", art.source_files, sources, lambda: art.source_artifacts(t(sources)))
    ds.artifact_builder = lambda: art.all_artifacts(
        *[spec.artifacts() for spec in ds.collection_specs.values()]
    )
    ds.document_builder = documents
    return ds


# Chunk lists --------------------------------------------------------------------------
def chunk_dataset(
    spark: SparkSession, documents: DataFrame, collation: str | None = None, chunks: DataFrame | None = None
) -> Dataset:
    """Tables of chunk lists; ``chunks`` are given where the documents are held item by item."""
    chunks = ch.chunks_of(documents) if chunks is None else chunks
    counts = chunks.groupBy("trace_id").agg(F.count(F.lit(1)).alias("itemCount"))
    manifest = manifest_of("vite-bundle", documents, counts)
    ds = Dataset(spark, "vite-bundle", manifest, collation)
    t = ds.frame
    native = ("trace_id", "chunkIndex", "pos")
    size = "-parsedSize"
    ds.add_table("bundle.views.treemap", lambda: ch.treemap(chunks), native, "Every node of the source trees")
    ds.add_table("bundle.dims.modules", lambda: ch.modules(t("bundle.views.treemap")), native, "Leaf modules")
    ds.add_table("bundle.dims.chunks", lambda: ch.chunk_rows(chunks, t("bundle.dims.modules")), ("trace_id", "chunkIndex"), "Output chunks")
    ds.add_table("bundle.dims.packages", lambda: ch.packages(t("bundle.dims.modules")), (size, "packageName", "trace_id"), "Packages")
    ds.add_table("bundle.dims.chunkImports", lambda: ch.chunk_imports(chunks), native, "Import edges")
    ds.add_table("bundle.views.largestModules", lambda: ch.largest_modules(t("bundle.dims.modules")), (size, "path", "trace_id", "chunkIndex", "pos"), "Largest modules")
    ds.add_table("bundle.views.duplicateModules", lambda: ch.duplicate_modules(t("bundle.dims.modules")), ("-chunkCount", "-totalParsedSize", "path", "trace_id"), "Modules in several chunks")
    ds.add_report("bundle.summary", lambda: ch.bundle_summary(t("bundle.dims.chunks"), t("bundle.dims.packages"), t("bundle.dims.modules")), "Totals and largest parts")
    ds.raw_specs["bundle.document"] = lambda: chunks
    ds.document_builder = lambda: documents
    ds.capability_builder = lambda: ch.bundle_totals(t("bundle.dims.chunks"), t("bundle.dims.modules")).select(
        "trace_id",
        F.lit(True).alias("bundleAnalyzer"),
        F.col("chunks").alias("totalChunks"),
        "totalModules",
        F.lit(True).alias("hasGzipSizes"),
        F.lit(True).alias("hasBrotliSizes"),
        "hasSourceMaps",
        "entryChunks",
    )
    return ds


# Module graphs ------------------------------------------------------------------------
def graph_dataset(spark: SparkSession, roots: str | Sequence[str], collation: str | None = None) -> Dataset:
    """Module-graph folders; each root file gives its folder's main tables, all files the routes.

    ``trace_id`` is the folder in the main tables and the file in those of routes.
    """
    roots = sorted({r.rstrip("/") for r in ([roots] if isinstance(roots, str) else roots)})
    decoded = mg_files.decode_graph_files(spark, roots)
    headers, edges = mg_files.headers(decoded), mg_files.edges(decoded).withColumnRenamed("path", "trace_id")
    analyze = headers.filter(mg_files.is_analyze_header(F.col("header")))

    def of_roots(df: DataFrame, name: str, column: str = "trace_id") -> DataFrame:
        """Rows of the root files of that name, under their folder."""
        own = df.filter(F.col(column).isin([f"{root}/{name}" for root in roots]))
        return own.withColumn(column, F.regexp_replace(column, "/[^/]*$", ""))

    all_sources, all_parts = mg_files.source_rows(analyze), mg_files.part_rows(analyze)
    all_outputs = mg_files.output_rows(analyze)
    all_children = edges.filter(F.col("section") == "source_children")
    sources, parts, outputs, children = (of_roots(df, "analyze.data") for df in (all_sources, all_parts, all_outputs, all_children))
    graph_headers = of_roots(headers, "modules.data", "path")
    module_rows, edges = mg_files.module_rows(graph_headers), of_roots(edges, "modules.data")
    route_rows = reduce(DataFrame.unionByName, [mg_files.read_routes(spark, root) for root in roots])
    analyze_files = analyze.select(F.col("path").alias("trace_id"))
    manifest = mg.count_rows(itemCount=parts)
    ds = Dataset(spark, "nextjs-bundle", manifest, collation)
    t = ds.frame
    src, out = "nextbundle.dims.sources", "nextbundle.dims.outputFiles"
    part, mod = "nextbundle.dims.chunkParts", "nextbundle.dims.modules"
    ds.add_table(src, lambda: mg.source_rows(sources, children, parts), ("sourceIndex",), "Source tree nodes")
    ds.add_table(out, lambda: mg.output_files(outputs, parts), ("fileIndex",), "Output files")
    ds.add_table(part, lambda: mg.chunk_parts(parts, t(src), outputs), ("chunkPartIndex",), "Parts of sources in files")
    ds.add_table(mod, lambda: mg.modules(module_rows, edges), ("moduleIndex",), "Modules with their degrees")
    ds.add_table("nextbundle.dims.routes", lambda: mg.routes(route_rows, analyze_files), ("pos",), "Routes")
    ds.add_table("nextbundle.views.sourceTree", lambda: mg.source_tree(t(src), parts, t(out)), ("sourceIndex",), "Leaf sources with their files")
    ds.add_table("nextbundle.views.moduleDependencies", lambda: mg.module_dependencies(module_rows, edges), ("node", "-kind", "pos"), "Dependency edges")
    ds.add_table("nextbundle.views.packageSizes", lambda: mg.package_sizes(t("nextbundle.views.sourceTree"), t(mod)), ("-totalSize", "packageName"), "Packages")
    ds.add_table("nextbundle.views.routeSizes", lambda: mg.route_sizes(t("nextbundle.dims.routes"), all_sources, all_outputs, all_parts), ("route",), "Totals per route")
    ds.add_table("nextbundle.views.environmentBreakdown", lambda: mg.environment_breakdown(t(out)), ("environment",), "Server and client output")

    def summary():
        return mg.graph_summary(
            t("nextbundle.dims.routes"),
            t(src),
            t(out),
            t(part),
            t(mod),
            t("nextbundle.views.sourceTree"),
            t("nextbundle.views.packageSizes"),
            t("nextbundle.views.moduleDependencies"),
        )

    def route(route: str = "/"):
        # Only the files of the route are worked on.
        table = t("nextbundle.dims.routes")
        files = cut(table.filter(F.col("route") == (route or "/")).select(F.col("analyzePath").alias("trace_id")).distinct())
        own = [df.join(files, "trace_id", "left_semi") for df in (all_sources, all_children, all_parts, all_outputs)]
        route_sources, route_children, route_parts, route_outputs = own
        every_source = mg.source_rows(route_sources, route_children, route_parts)
        return mg.route_report(
            table,
            t("nextbundle.views.routeSizes"),
            every_source,
            mg.output_files(route_outputs, route_parts),
            mg.chunk_parts(route_parts, every_source, route_outputs),
            route or "/",
        )

    ds.add_report("nextbundle.summary", summary, "Totals, largest sources and packages")
    ds.add_report("nextbundle.route", route, "One route")
    ds.raw_specs["nextbundle.analyze"] = lambda: of_roots(analyze, "analyze.data", "path")
    ds.raw_specs["nextbundle.modules"] = lambda: graph_headers
    ds.raw_specs["nextbundle.routes"] = lambda: t("nextbundle.dims.routes")
    ds.document_builder = lambda: headers.select(
        dataset_id(F.col("path")).alias("trace_id"), "path", F.to_json("header").alias("text"), F.col("header").alias("doc")
    )
    ds.capability_builder = lambda: mg.count_rows(
        routeCount=t("nextbundle.dims.routes"),
        totalSources=sources,
        totalModules=module_rows,
        totalOutputFiles=outputs,
        graphFiles=graph_headers,
    ).select(
        F.lit(True).alias("bundleAnalyzer"),
        (F.col("graphFiles") > 0).alias("hasModuleGraph"),
        (F.col("routeCount") > 0).alias("hasRoutes"),
        "routeCount",
        "totalSources",
        "totalModules",
        "totalOutputFiles",
    )
    return ds


# Any other JSON -----------------------------------------------------------------------
def json_dataset(
    spark: SparkSession,
    documents: DataFrame,
    collation: str | None = None,
    items: DataFrame | None = None,
    whole: Callable[[], DataFrame] | None = None,
) -> Dataset:
    """Discovery over documents; ``items`` are their root arrays where they are held item by item.

    ``whole`` gives the documents for what hands them out as such.
    """
    whole = whole or (lambda: documents)
    nodes = walk_json(documents, ["trace_id"], "text")
    counts = None
    if items is None:
        sizes = documents.select("trace_id", F.size(p.v_array(F.col("doc"), "$")).alias("itemCount"))
    else:
        counts = cut(rawjson.item_counts(items))
        nodes = nodes.unionByName(rawjson.item_nodes(items, walk_json))
        sizes = counts.select("trace_id", F.col("rows").alias("itemCount"))
    manifest = manifest_of("raw-json", documents, sizes)
    ds = Dataset(spark, "raw-json", manifest, collation)
    t = ds.frame
    inferred = rawjson.inferred_tables(nodes, counts)
    long_rows = rawjson.inferred_rows(inferred, nodes, items, counts)
    ds.add_table("raw.schema.paths", lambda: rawjson.path_catalog(nodes), ("path", "trace_id"), "JSON paths")
    ds.add_table("raw.embeddedBlobs", lambda: rawjson.embedded_blobs(documents, items=items), ("trace_id", "embeddedBlobId"), "Embedded payloads")

    def typed_rows(name: str, object_type: str) -> DataFrame:
        rows = long_rows.filter(F.col("name") == name)
        struct = object_type.replace("OBJECT<", "STRUCT<")
        value = F.try_variant_get("row", "$", struct)
        return rows.select("trace_id", "row_index", value.alias("r")).select("trace_id", "row_index", "r.*")

    # A document keyed by data may hold any number of arrays, so their tables are not listed here:
    # a table is looked up when it is asked for, and the list of names is a relation.
    shapes: dict[str, str | None] = {}

    def inferred_table(name: str) -> TableSpec | None:
        if not name.startswith(INFERRED):
            return None
        if name not in shapes:
            own = long_rows.filter(F.col("name") == name)
            shapes[name] = own.agg(F.schema_of_variant_agg("row")).first()[0] if not own.isEmpty() else None
        if shapes[name] is None:
            return None
        return TableSpec(lambda: typed_rows(name, shapes[name]), ("trace_id", "row_index"), FOUND_ARRAY)

    ds.raw_specs["raw.inferred"] = lambda: long_rows
    ds.found_table = inferred_table
    ds.found_names = lambda: inferred.select(
        "name", F.lit("raw").alias("namespace"), F.lit(FOUND_ARRAY).alias("description")
    ).distinct()
    ds.raw_specs["raw.document"] = whole
    ds.document_builder = whole
    ds.add_report(
        "raw.summary",
        lambda: rawjson.raw_summary(documents, inferred, t("raw.schema.paths"), t("raw.embeddedBlobs")),
        "What was discovered",
    )
    ds.capability_builder = lambda: rawjson.raw_capabilities(
        inferred, t("raw.schema.paths"), t("raw.embeddedBlobs"), documents
    )
    ds.artifact_builder = lambda: art.raw_artifacts(whole(), t("raw.embeddedBlobs"))
    ds.collection_specs["raw.document"] = CollectionSpec(lambda: art.document_files(whole()), "The document")
    ds.collection_specs["raw.embedded-blobs"] = CollectionSpec(
        lambda: art.blob_files(t("raw.embeddedBlobs")), "Embedded payloads"
    )
    return ds


# Opening ------------------------------------------------------------------------------
def open_dataset(
    spark: SparkSession,
    path: str | Sequence[str],
    kind: str | None = None,
    bronze: str | None = None,
    collation: str | None = None,
) -> Dataset:
    """Open one file, several files of one kind, or a module-graph folder.

    ``bronze`` names a folder where trace events, chunks or the items of JSON arrays are written
    once as Parquet rows; use it for files too large for one value and whenever more than one
    query runs.
    A file that cannot be read gives no rows and is listed by ``errors()``.
    """
    ship_package(spark)
    paths = [path] if isinstance(path, str) else list(path)
    if kind is None:
        found = classify(spark, paths).select("kind").distinct().limit(5).collect()
        kinds = sorted({row["kind"] for row in found})
        if not kinds:
            raise ValueError(f"No source reader found for: {paths}")
        if len(kinds) > 1:
            raise ValueError(f"Files of different kinds, open one kind at a time: {kinds}")
        kind = kinds[0]
    if kind == "nextjs-bundle":
        return graph_dataset(spark, paths, collation)
    if kind == "devtools" and bronze is not None:
        rows = ingest_traces(spark, paths, bronze)
        events, metadata = split_metadata(rows)
        files = list_files(spark, paths)
        counts = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("itemCount"))
        manifest = manifest_of(kind, files.withColumnRenamed("length", "fileSizeBytes"), counts)
        ds = trace_dataset(
            spark, events, metadata, manifest, lambda: read_documents(spark, paths), collation
        )
        ds.error_builder = lambda: failed_files(rows).join(files, "trace_id").select("trace_id", "path", "reason")
        return ds
    if kind != "devtools" and bronze is not None:
        documents, items, failed = ingest_documents(spark, paths, bronze)
        files = list_files(spark, paths).withColumnRenamed("length", "fileSizeBytes")
        documents = documents.join(files.select("trace_id", "path", "fileSizeBytes"), "trace_id")

        def whole() -> DataFrame:
            return read_documents(spark, paths)

        if kind == "vite-bundle":
            ds = chunk_dataset(spark, documents, collation, ch.chunks_of_items(items))
            ds.document_builder = whole
        else:
            ds = json_dataset(spark, documents, collation, items, whole)
        ds.error_builder = lambda: failed.join(files, "trace_id").select("trace_id", "path", "reason")
        return ds
    every = read_documents(spark, paths)
    documents = every.filter(F.col("doc").isNotNull())
    if kind == "devtools":
        events = spread_rows(trace_events(documents), "trace_id", "rawIndex")
        counts = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("itemCount"))
        manifest = manifest_of(kind, documents, counts)
        ds = trace_dataset(spark, events, trace_metadata(documents), manifest, lambda: documents, collation)
    elif kind == "vite-bundle":
        ds = chunk_dataset(spark, documents, collation)
    else:
        ds = json_dataset(spark, documents, collation)
    ds.error_builder = lambda: document_errors(every)
    return ds
