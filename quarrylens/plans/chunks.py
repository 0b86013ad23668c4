"""Bundle chunks: module trees, packages, imports and duplicates.

Input is a *chunks* frame: trace_id, chunkIndex, chunk (VARIANT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.ordinal import top_per_group
from quarrylens.functions import paths
from quarrylens.functions import payload as p
from quarrylens.operators.json_walk import bracket_depth

# Members every chunk has.
REQUIRED_KEYS = (
    "filename",
    "label",
    "parsedSize",
    "gzipSize",
    "brotliSize",
    "mapSize",
    "source",
    "isEntry",
    "imports",
)
SIZES = ("parsedSize", "gzipSize", "brotliSize")
LARGEST = 100


def is_chunk(v: Column) -> Column:
    """The value has every required member with the right type."""
    tests = [
        p.v_str(v, "$.filename"),
        p.v_str(v, "$.label"),
        *[p.v_num(v, f"$.{k}") for k in (*SIZES, "mapSize")],
        p.v_bool(v, "$.isEntry"),
        p.v_array(v, "$.source"),
        p.v_array(v, "$.imports"),
    ]
    out = F.lit(True)
    for test in tests:
        out = out & test.isNotNull()
    return out


def chunks_of(documents: DataFrame) -> DataFrame:
    """Chunks of documents whose first item is a chunk."""
    items = p.v_array(F.col("doc"), "$")
    valid = documents.withColumn("items", items).filter(is_chunk(F.get("items", F.lit(0))))
    return valid.select(
        "trace_id", F.posexplode("items").alias("chunkIndex", "chunk")
    ).withColumn("chunkIndex", F.col("chunkIndex").cast("bigint"))


def chunks_of_items(items: DataFrame) -> DataFrame:
    """The same of documents held as items (trace_id, position, text)."""
    rows = items.select("trace_id", F.col("position").alias("chunkIndex"), F.parse_json("text").alias("chunk"))
    first = rows.filter((F.col("chunkIndex") == 0) & is_chunk(F.col("chunk")))
    return rows.join(first.select("trace_id"), "trace_id", "left_semi")


def _size(v: Column, name: str) -> Column:
    return F.coalesce(p.v_num(v, f"$.{name}").cast("bigint"), F.lit(0))


def tree_depth(chunks: DataFrame) -> int:
    """Upper bound of the tree depth: a level of the tree opens two brackets."""
    top = chunks.select(F.max(bracket_depth(F.to_json("chunk")))).first()[0]
    return int(top or 0) // 2 + 1


def treemap(chunks: DataFrame, depth: int | None = None) -> DataFrame:
    """``bundle.views.treemap``: every node of the source trees, parents first.

    ``pos`` gives the visit order within a chunk.
    """
    depth = tree_depth(chunks) if depth is None else depth
    roots = chunks.select(
        "trace_id",
        "chunkIndex",
        p.v_str(F.col("chunk"), "$.filename").alias("chunkId"),
        F.posexplode(p.v_array(F.col("chunk"), "$.source")).alias("i", "node"),
    ).select(
        "trace_id",
        "chunkIndex",
        "chunkId",
        F.array("i").alias("pos"),
        "node",
        F.lit(0).alias("depth"),
    )
    own = F.array(F.struct("pos", "node", "depth"))
    for level in range(depth):
        groups = p.v_array(F.col("node"), "$.groups")
        below = F.transform(
            groups,
            lambda g, i: F.struct(
                F.concat("pos", F.array(i)).alias("pos"),
                g.alias("node"),
                F.lit(level + 1).alias("depth"),
            ),
        )
        fresh = (F.col("depth") == level) & groups.isNotNull()
        roots = roots.select(
            "trace_id",
            "chunkIndex",
            "chunkId",
            F.inline(F.when(fresh, F.concat(own, below)).otherwise(own)),
        )
    node = F.col("node")
    children = F.coalesce(F.size(p.v_array(node, "$.groups")), F.lit(0))
    return roots.select(
        "trace_id",
        "chunkIndex",
        "chunkId",
        "pos",
        F.coalesce(p.v_text(node, "$.filename"), p.v_str(node, "$.label")).alias("path"),
        p.v_str(node, "$.label").alias("label"),
        *[_size(node, s).alias(s) for s in SIZES],
        (children == 0).alias("isLeaf"),
        children.alias("childCount"),
        "depth",
    )


def modules(tree: DataFrame) -> DataFrame:
    """``bundle.dims.modules``: leaves of the trees."""
    path = F.col("path")
    directory = paths.dirname(path)
    in_package = F.contains(path, F.lit("node_modules/"))
    return tree.filter("isLeaf").select(
        "trace_id",
        "chunkIndex",
        "pos",
        F.concat("chunkId", F.lit("::"), "path").alias("moduleId"),
        "chunkId",
        "path",
        directory.alias("directory"),
        paths.basename(path).alias("basename"),
        *SIZES,
        in_package.alias("isNodeModule"),
        F.when(in_package, paths.package_name(path)).alias("packageName"),
        F.coalesce(paths.path_depth(directory), F.lit(0)).alias("depth"),
    )


def chunk_rows(chunks: DataFrame, module_rows: DataFrame) -> DataFrame:
    """``bundle.dims.chunks``."""
    v = F.col("chunk")
    leaves = module_rows.groupBy("trace_id", "chunkIndex").agg(
        F.count(F.lit(1)).alias("moduleCount")
    )
    filename = p.v_str(v, "$.filename")
    return (
        chunks.select(
            "trace_id",
            "chunkIndex",
            filename.alias("chunkId"),
            filename.alias("filename"),
            p.v_str(v, "$.label").alias("label"),
            p.v_truthy(v, "$.isEntry").alias("isEntry"),
            paths.is_asset(filename).alias("isAsset"),
            *[_size(v, s).alias(s) for s in (*SIZES, "mapSize")],
            F.coalesce(F.size(p.v_array(v, "$.imports")), F.lit(0)).cast("bigint").alias("importCount"),
        )
        .join(leaves, ["trace_id", "chunkIndex"], "left")
        .fillna(0, ["moduleCount"])
    )


def chunk_imports(chunks: DataFrame) -> DataFrame:
    """``bundle.dims.chunkImports``: import edges between chunks."""
    v = F.col("chunk")
    return chunks.select(
        "trace_id",
        "chunkIndex",
        p.v_str(v, "$.filename").alias("fromChunk"),
        F.posexplode(p.v_array(v, "$.imports")).alias("pos", "to"),
    ).select("trace_id", "chunkIndex", "pos", "fromChunk", F.col("to").cast("string").alias("toChunk"))


def _by_chunk(module_rows: DataFrame, key: str) -> DataFrame:
    """Sums per (key, chunk): one row per chunk is what gets listed."""
    return module_rows.groupBy("trace_id", key, "chunkId").agg(
        *[F.sum(s).alias(s) for s in SIZES], F.count(F.lit(1)).alias("n")
    )


def _listed_chunks() -> Column:
    return F.array_join(F.sort_array(F.collect_list("chunkId")), ", ").alias("chunks")


def packages(module_rows: DataFrame) -> DataFrame:
    """``bundle.dims.packages``."""
    named = module_rows.filter(F.col("packageName").isNotNull())
    return (
        _by_chunk(named, "packageName")
        .groupBy("trace_id", "packageName")
        .agg(
            *[F.sum(s).alias(s) for s in SIZES],
            F.sum("n").alias("moduleCount"),
            F.count(F.lit(1)).alias("chunkCount"),
            _listed_chunks(),
        )
    )


def duplicate_modules(module_rows: DataFrame) -> DataFrame:
    """``bundle.views.duplicateModules``: paths found in more than one chunk."""
    return (
        _by_chunk(module_rows, "path")
        .groupBy("trace_id", "path")
        .agg(
            F.count(F.lit(1)).alias("chunkCount"),
            _listed_chunks(),
            F.sum("parsedSize").alias("totalParsedSize"),
        )
        .filter(F.col("chunkCount") > 1)
    )


def largest_modules(module_rows: DataFrame, k: int = LARGEST) -> DataFrame:
    """``bundle.views.largestModules``: each bundle's top k by size, then path."""
    order = [F.col("parsedSize").desc(), F.col("path"), F.col("chunkIndex"), F.col("pos")]
    return top_per_group(module_rows, ["trace_id"], order, k).drop("_rank")


def bundle_totals(rows: DataFrame, module_rows: DataFrame) -> DataFrame:
    """Totals and capability scalars, one row per bundle."""
    leaves = module_rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("totalModules"))
    return (
        rows.groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.count_if("isEntry").alias("entryChunks"),
            F.count_if("isAsset").alias("assetChunks"),
            *[F.sum(s).alias(s) for s in SIZES],
            (F.max("mapSize") > 0).alias("hasSourceMaps"),
        )
        .join(leaves, "trace_id", "left")
        .fillna(0, ["totalModules"])
    )


def bundle_summary(
    rows: DataFrame, package_rows: DataFrame, module_rows: DataFrame, k: int = 5
) -> dict[str, DataFrame]:
    """``bundle.summary``: each bundle's totals and its largest chunks, packages and modules."""
    size = F.col("parsedSize").desc()

    def top(df: DataFrame, name: str) -> DataFrame:
        found = top_per_group(df, ["trace_id"], [size, F.col(name)], k).drop("_rank")
        return found.orderBy("trace_id", size, name)

    return {
        "totals": bundle_totals(rows, module_rows),
        "topChunks": top(rows, "filename"),
        "topPackages": top(package_rows, "packageName"),
        "topModules": largest_modules(module_rows, k).orderBy("trace_id", size, "path", "chunkIndex", "pos"),
    }
