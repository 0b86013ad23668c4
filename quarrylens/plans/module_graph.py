"""Module-graph tables: source trees, output files, dependencies, routes.

Frames come from :mod:`quarrylens.sources.module_graph`; ``trace_id`` names the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import paths
from quarrylens.operators.closure import root_paths, subtree_sums
from quarrylens.operators.counts import count_rows

ROOT = "[root]"
TOTALS = ("totalSize", "compressedSize", "chunkPartCount")


def _part_sums() -> list:
    return [
        F.sum("size").alias("totalSize"),
        F.sum("compressedSize").alias("compressedSize"),
        F.count(F.lit(1)).alias("chunkPartCount"),
    ]


def source_paths(sources: DataFrame, children: DataFrame) -> DataFrame:
    """Sources with their full path, joined from the root's segment down."""
    known = sources.select("trace_id", F.col("sourceIndex").alias("parent")).withColumn(
        "parentIndex", F.col("parent")
    )
    linked = sources.join(known, ["trace_id", "parentIndex"], "left").select(
        "trace_id", "sourceIndex", "segment", "parent", F.lit(0).alias("lo"), F.lit(1).alias("hi")
    )
    walked = root_paths(linked, ["trace_id"], "sourceIndex", "parent", "segment", "lo", "hi").select(
        "trace_id",
        F.col("node").alias("sourceIndex"),
        paths.collapse_roots(F.array_join("labels", "")).alias("full"),
    )
    parents = children.select("trace_id", F.col("node").alias("sourceIndex")).distinct().withColumn(
        "hasChildren", F.lit(True)
    )
    key = ["trace_id", "sourceIndex"]
    path = F.when(F.col("full") != "", F.col("full")).otherwise(
        F.when(F.col("parentIndex").isNull(), ROOT).otherwise(F.col("segment"))
    )
    return (
        sources.join(walked, key, "left")
        .join(parents, key, "left")
        .select(
            *key,
            path.alias("path"),
            "segment",
            "parentIndex",
            (
                F.col("segment").endswith("/") | F.col("hasChildren").isNotNull() | (F.col("segment") == "")
            ).alias("isDirectory"),
        )
    )


def source_totals(sources: DataFrame, children: DataFrame, parts: DataFrame) -> DataFrame:
    """(trace_id, sourceIndex, totals): sums over each source and everything below it."""
    key = ["trace_id", "sourceIndex"]
    direct = parts.groupBy(*key).agg(*_part_sums())
    known = children.join(sources.select("trace_id", F.col("sourceIndex").alias("target")), ["trace_id", "target"], "left_semi")
    direct = direct.join(sources.select(*key), key, "left_semi")
    return subtree_sums(direct, known, ["trace_id"], "sourceIndex", "target", "node", list(TOTALS), repeated_edges=True)


def source_rows(sources: DataFrame, children: DataFrame, parts: DataFrame) -> DataFrame:
    """``nextbundle.dims.sources``."""
    return (
        source_paths(sources, children)
        .join(source_totals(sources, children, parts), ["trace_id", "sourceIndex"], "left")
        .fillna(0, list(TOTALS))
    )


def output_files(outputs: DataFrame, parts: DataFrame) -> DataFrame:
    """``nextbundle.dims.outputFiles``."""
    sums = parts.groupBy("trace_id", F.col("outputFileIndex").alias("fileIndex")).agg(*_part_sums())
    name = F.col("filename")
    return (
        outputs.join(sums, ["trace_id", "fileIndex"], "left")
        .fillna(0, list(TOTALS))
        .select(
            "trace_id",
            "fileIndex",
            "filename",
            paths.strip_output(name).alias("cleanFilename"),
            paths.environment(name).alias("environment"),
            paths.file_type(name).alias("fileType"),
            *TOTALS,
        )
    )


def chunk_parts(parts: DataFrame, source_path_rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """``nextbundle.dims.chunkParts`` with paths looked up."""
    named = source_path_rows.select("trace_id", "sourceIndex", F.col("path").alias("_path"))
    files = outputs.select(
        "trace_id", F.col("fileIndex").alias("outputFileIndex"), F.col("filename").alias("_file")
    )
    return (
        parts.join(named, ["trace_id", "sourceIndex"], "left")
        .join(files, ["trace_id", "outputFileIndex"], "left")
        .select(
            "trace_id",
            "chunkPartIndex",
            "sourceIndex",
            F.coalesce("_path", F.concat(F.lit("source:"), F.col("sourceIndex").cast("string"))).alias("sourcePath"),
            "outputFileIndex",
            F.coalesce(
                "_file", F.concat(F.lit("output:"), F.col("outputFileIndex").cast("string"))
            ).alias("outputFilename"),
            "size",
            "compressedSize",
        )
    )


def source_tree(rows: DataFrame, parts: DataFrame, file_rows: DataFrame) -> DataFrame:
    """``nextbundle.views.sourceTree``: leaf sources with the files they end up in."""
    files = file_rows.select(
        "trace_id", F.col("fileIndex").alias("outputFileIndex"), "cleanFilename", "environment"
    )
    placed = (
        parts.select("trace_id", "sourceIndex", "outputFileIndex")
        .distinct()
        .join(files, ["trace_id", "outputFileIndex"])
        .select("trace_id", "sourceIndex", "cleanFilename", "environment")
        .distinct()
        .groupBy("trace_id", "sourceIndex")
        .agg(
            F.sort_array(F.collect_set("cleanFilename")).alias("files"),
            F.sort_array(F.collect_set("environment")).alias("envs"),
        )
    )
    empty = F.array().cast("array<string>")
    found, envs = F.coalesce("files", empty), F.coalesce("envs", empty)
    return (
        rows.filter(~F.col("isDirectory"))
        .join(placed, ["trace_id", "sourceIndex"], "left")
        .select(
            *rows.columns,
            F.size(found).alias("outputFileCount"),
            F.array_join(found, ", ").alias("outputFiles"),
            F.array_join(envs, ", ").alias("environments"),
        )
    )


def modules(module_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``nextbundle.dims.modules`` with the four degree counts."""

    def count(section: str, name: str):
        return F.count_if(F.col("section") == section).alias(name)

    degrees = edges.groupBy("trace_id", F.col("node").alias("moduleIndex")).agg(
        count("module_dependencies", "dependencyCount"),
        count("async_module_dependencies", "asyncDependencyCount"),
        count("module_dependents", "dependentCount"),
        count("async_module_dependents", "asyncDependentCount"),
    )
    clean = paths.strip_project(F.col("path"))
    in_package = F.contains(clean, F.lit("node_modules/"))
    counts = ["dependencyCount", "asyncDependencyCount", "dependentCount", "asyncDependentCount"]
    return (
        module_rows.join(degrees, ["trace_id", "moduleIndex"], "left")
        .fillna(0, counts)
        .select(
            "trace_id",
            "moduleIndex",
            "ident",
            "path",
            clean.alias("cleanPath"),
            in_package.alias("isNodeModule"),
            F.when(in_package, paths.package_name(clean)).alias("packageName"),
            *counts,
        )
    )


def module_dependencies(module_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``nextbundle.views.moduleDependencies``: edges by path, dangling ones dropped."""
    kind = F.when(F.col("section") == "module_dependencies", "sync").when(
        F.col("section") == "async_module_dependencies", "async"
    )
    own = module_rows.select(
        "trace_id", F.col("moduleIndex").alias("node"), F.col("path").alias("fromModule")
    )
    other = module_rows.select(
        "trace_id", F.col("moduleIndex").alias("target"), F.col("path").alias("toModule")
    )
    return (
        edges.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .join(own, ["trace_id", "node"])
        .join(other, ["trace_id", "target"])
        .select("trace_id", "node", "pos", "fromModule", "toModule", "kind")
    )


def package_sizes(tree: DataFrame, module_table: DataFrame) -> DataFrame:
    """``nextbundle.views.packageSizes``: source sums and module counts merged."""
    from_sources = tree.select(
        "trace_id",
        paths.package_name(paths.strip_project(F.col("path"))).alias("packageName"),
        "totalSize",
        "compressedSize",
        F.lit(0).cast("bigint").alias("moduleCount"),
        F.lit(1).cast("bigint").alias("sourceCount"),
    )
    zero = F.lit(0).cast("bigint")
    from_modules = module_table.select(
        "trace_id",
        "packageName",
        zero.alias("totalSize"),
        zero.alias("compressedSize"),
        F.lit(1).cast("bigint").alias("moduleCount"),
        zero.alias("sourceCount"),
    )
    sums = ("totalSize", "compressedSize", "moduleCount", "sourceCount")
    return (
        from_sources.unionByName(from_modules)
        .filter(F.col("packageName").isNotNull())
        .groupBy("trace_id", "packageName")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def environment_breakdown(file_rows: DataFrame) -> DataFrame:
    """``nextbundle.views.environmentBreakdown``."""
    return file_rows.groupBy("trace_id", "environment").agg(
        F.sum("totalSize").alias("totalSize"),
        F.sum("compressedSize").alias("compressedSize"),
        F.count(F.lit(1)).alias("fileCount"),
    )


def routes(route_rows: DataFrame, analyze_files: DataFrame) -> DataFrame:
    """``nextbundle.dims.routes``: the manifest, flagged where a file exists."""
    existing = analyze_files.select(F.col("trace_id").alias("analyzePath")).distinct().withColumn(
        "_there", F.lit(True)
    )
    return route_rows.join(existing, "analyzePath", "left").select(
        "pos", "route", F.col("_there").isNotNull().alias("hasAnalyzeData"), "analyzePath"
    )


def route_sizes(
    route_table: DataFrame, sources: DataFrame, outputs: DataFrame, parts: DataFrame
) -> DataFrame:
    """``nextbundle.views.routeSizes``: totals of each route's own file."""

    def per_file(df: DataFrame, *aggs) -> DataFrame:
        return df.groupBy(F.col("trace_id").alias("analyzePath")).agg(*aggs)

    counts = ["totalSize", "compressedSize", "sourceCount", "outputFileCount", "chunkPartCount"]
    return (
        route_table.filter("hasAnalyzeData")
        .select("route", "analyzePath")
        .join(per_file(parts, *_part_sums()), "analyzePath", "left")
        .join(per_file(sources, F.count(F.lit(1)).alias("sourceCount")), "analyzePath", "left")
        .join(per_file(outputs, F.count(F.lit(1)).alias("outputFileCount")), "analyzePath", "left")
        .fillna(0, counts)
        .select("route", *counts)
    )


def dependency_stats(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("trace_id").agg(
        F.count_if(F.col("kind") == "sync").alias("syncEdgeCount"),
        F.count_if(F.col("kind") == "async").alias("asyncEdgeCount"),
    )


def most_depended_on(module_table: DataFrame) -> DataFrame:
    """Per graph, the module most others depend on; ties go to the first path."""
    best = F.min(F.struct((-F.col("dependentCount")).alias("n"), "path"))
    return module_table.groupBy("trace_id").agg(best["path"].alias("mostDependedOnModule"))


def graph_summary(
    route_table: DataFrame,
    source_table: DataFrame,
    file_rows: DataFrame,
    part_table: DataFrame,
    module_table: DataFrame,
    tree: DataFrame,
    package_rows: DataFrame,
    dependencies: DataFrame,
    k: int = 10,
) -> dict[str, DataFrame]:
    """``nextbundle.summary`` as frames."""

    totals = count_rows(
        totalSources=source_table,
        totalOutputFiles=file_rows,
        totalChunkParts=part_table,
        totalModules=module_table,
        routeCount=route_table,
    )
    return {
        "totals": totals,
        "routes": route_table.orderBy("pos").select("route", "hasAnalyzeData"),
        "environmentBreakdown": environment_breakdown(file_rows).orderBy("environment"),
        "topSources": tree.orderBy(F.col("totalSize").desc(), "path").limit(k),
        "topPackagesByModuleCount": package_rows.orderBy(
            F.col("moduleCount").desc(), "packageName"
        ).limit(k),
        "moduleDependencyStats": dependency_stats(dependencies).join(
            most_depended_on(module_table), "trace_id", "full_outer"
        ),
    }


def route_report(
    route_table: DataFrame,
    sizes: DataFrame,
    source_table: DataFrame,
    file_rows: DataFrame,
    part_table: DataFrame,
    route: str = "/",
) -> dict[str, DataFrame]:
    """``nextbundle.route``: one route's totals and its tables."""
    chosen = route_table.filter((F.col("route") == route) & F.col("hasAnalyzeData")).select(
        F.col("analyzePath").alias("trace_id")
    )
    return {
        "availableRoutes": route_table.orderBy("pos").select("route", "hasAnalyzeData"),
        "analysis": sizes.filter(F.col("route") == route),
        "sources": source_table.join(chosen, "trace_id", "left_semi").orderBy("sourceIndex"),
        "outputFiles": file_rows.join(chosen, "trace_id", "left_semi").orderBy("fileIndex"),
        "chunkParts": part_table.join(chosen, "trace_id", "left_semi").orderBy("chunkPartIndex"),
    }
