"""Bundle chunks made of pages, and a module graph made of parts, line items, suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.dataset import chunk_dataset
from quarrylens.plans import chunks as ch
from quarrylens.plans import module_graph as mg
from quarrylens.queries.json_queries import turn_documents
from quarrylens.queries.registry import query
from quarrylens.sources.classify import HEAD_BYTES, TRACE_EVENTS, source_kind
from quarrylens.sources.module_graph import decode_contents, edges
from quarrylens.sources.star_events import read_table, spread_table


# Chunks ---------------------------------------------------------------------------------
def page_chunks(spark, sf_dir):
    """Each page is a chunk; its host holds a package file and a file shared by language."""
    pages = spread_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([^/]+)", 1)
    size = F.length("html")

    def sizes(factor):
        return [
            (size * factor).alias("parsedSize"),
            F.floor(size * factor / 3).alias("gzipSize"),
            F.floor(size * factor / 4).alias("brotliSize"),
        ]

    package = F.struct(
        F.lit("index.js").alias("label"),
        F.concat(F.lit("lib/node_modules/"), lang, F.lit("/d"), (F.col("page_id") % 5).cast("string"), F.lit("/index.js")).alias("filename"),
        *sizes(2),
    )
    shared = F.struct(
        F.concat(F.lit("src/shared-"), lang, F.lit(".js")).alias("label"),
        F.lit("").alias("filename"),
        *sizes(1),
    )
    folder = F.struct(F.lit("deep").alias("label"), *sizes(3), F.array(package, shared).alias("groups"))
    single = F.struct(F.lit("main.js").alias("label"), F.lit(7).alias("parsedSize"))
    root = F.struct(host.alias("label"), *sizes(3), F.array(folder).alias("groups"))
    chunk = F.struct(
        F.concat("url", F.when(F.col("page_id") % 4 == 0, ".css").otherwise(".js")).alias("filename"),
        host.alias("label"),
        *sizes(3),
        F.col("page_id").alias("mapSize"),
        (F.col("page_id") % 10 == 0).alias("isEntry"),
        F.array(F.to_variant_object(root), F.to_variant_object(single)).alias("source"),
        F.when(F.col("page_id") % 2 == 0, F.array(lang, host)).otherwise(F.array().cast("array<string>")).alias("imports"),
    )
    return pages.select(
        F.lit("pages").alias("trace_id"),
        F.col("page_id").alias("chunkIndex"),
        F.explode(F.array(F.to_variant_object(chunk))).alias("chunk"),
    )


CHUNKS = """WITH p AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS lang,
    length(html) AS n, url || CASE WHEN page_id % 4 = 0 THEN '.css' ELSE '.js' END AS chunk FROM pages), t AS (
  SELECT page_id, chunk, '0' AS pos, host AS path, host AS label, n * 3 AS s, n AS g, n * 3 // 4 AS b, FALSE AS leaf, 1 AS kids, 0 AS depth FROM p
  UNION ALL SELECT page_id, chunk, '0/0', 'deep', 'deep', n * 3, n, n * 3 // 4, FALSE, 2, 1 FROM p
  UNION ALL SELECT page_id, chunk, '0/0/0', 'lib/node_modules/' || lang || '/d' || (page_id % 5) || '/index.js', 'index.js', n * 2, n * 2 // 3, n * 2 // 4, TRUE, 0, 2 FROM p
  UNION ALL SELECT page_id, chunk, '0/0/1', 'src/shared-' || lang || '.js', 'src/shared-' || lang || '.js', n, n // 3, n // 4, TRUE, 0, 2 FROM p
  UNION ALL SELECT page_id, chunk, '1', 'main.js', 'main.js', 7, 0, 0, TRUE, 0, 0 FROM p), m AS (
  SELECT *, CASE WHEN contains(path, 'node_modules/') THEN split_part(path, '/', 3) END AS package,
    nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS dir FROM t WHERE leaf), c AS (
  SELECT page_id, chunk, host, page_id % 10 = 0 AS entry, page_id % 4 = 0 OR ends_with(chunk, '/.js') AS asset, n * 3 AS s, n AS g, n * 3 // 4 AS b,
    CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS imports FROM p)"""
SIZE_SQL = 's AS "parsedSize", g AS "gzipSize", b AS "brotliSize"'


def _tree(spark, sf_dir):
    return ch.treemap(page_chunks(spark, sf_dir))


def _modules(spark, sf_dir):
    return ch.modules(_tree(spark, sf_dir))


@query(
    "h01_treemap",
    CHUNKS
    + f""" SELECT page_id AS "chunkIndex", chunk AS "chunkId", pos, path, label, {SIZE_SQL}, leaf AS "isLeaf", kids AS "childCount", depth FROM t""",
)
def treemap(spark, sf_dir):
    return _tree(spark, sf_dir).drop("trace_id").withColumn("pos", F.array_join("pos", "/"))


@query(
    "h02_modules",
    CHUNKS
    + f""" SELECT chunk || '::' || path AS "moduleId", chunk AS "chunkId", path, dir AS directory, regexp_extract(path, '[^/]*$') AS basename,
  {SIZE_SQL}, package IS NOT NULL AS "isNodeModule", package AS "packageName", coalesce(len(string_split(dir, '/')), 0) AS depth FROM m""",
)
def modules(spark, sf_dir):
    return _modules(spark, sf_dir).drop("trace_id", "chunkIndex", "pos")


@query(
    "h03_chunks",
    CHUNKS
    + f""" SELECT chunk AS "chunkId", chunk AS filename, host AS label, entry AS "isEntry", asset AS "isAsset", {SIZE_SQL}, page_id AS "mapSize",
  imports AS "importCount", 3 AS "moduleCount" FROM c""",
)
def chunks(spark, sf_dir):
    rows = ch.chunk_rows(page_chunks(spark, sf_dir), _modules(spark, sf_dir))
    return rows.drop("trace_id", "chunkIndex")


PACKAGES = """, pk AS (
  SELECT package AS "packageName", CAST(sum(s) AS BIGINT) AS "parsedSize", CAST(sum(g) AS BIGINT) AS "gzipSize", CAST(sum(b) AS BIGINT) AS "brotliSize",
    count(*) AS "moduleCount", count(DISTINCT chunk) AS "chunkCount", string_agg(DISTINCT chunk, ', ' ORDER BY chunk) AS chunks
  FROM m WHERE package IS NOT NULL GROUP BY 1)"""


@query("h04_packages", CHUNKS + PACKAGES + " SELECT * FROM pk")
def packages(spark, sf_dir):
    return ch.packages(_modules(spark, sf_dir)).drop("trace_id")


@query(
    "h05_chunk_imports",
    """WITH p AS (SELECT url || CASE WHEN page_id % 4 = 0 THEN '.css' ELSE '.js' END AS chunk, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS lang FROM pages WHERE page_id % 2 = 0)
SELECT chunk AS "fromChunk", unnest([lang, host]) AS "toChunk" FROM p""",
)
def chunk_imports(spark, sf_dir):
    return ch.chunk_imports(page_chunks(spark, sf_dir)).select("fromChunk", "toChunk")


@query(
    "h06_largest_modules",
    CHUNKS + """ SELECT path, chunk AS "chunkId", s AS "parsedSize" FROM m ORDER BY s DESC, path, page_id LIMIT 100""",
)
def largest_modules(spark, sf_dir):
    return ch.largest_modules(_modules(spark, sf_dir)).select("path", "chunkId", "parsedSize")


@query(
    "h07_duplicate_modules",
    CHUNKS
    + """ SELECT path, count(DISTINCT chunk) AS "chunkCount", string_agg(DISTINCT chunk, ', ' ORDER BY chunk) AS chunks,
  CAST(sum(s) AS BIGINT) AS "totalParsedSize" FROM m GROUP BY 1 HAVING count(DISTINCT chunk) > 1""",
)
def duplicate_modules(spark, sf_dir):
    return ch.duplicate_modules(_modules(spark, sf_dir)).drop("trace_id")


@query(
    "f11_bundle_summary_totals",
    CHUNKS
    + """ SELECT count(*) AS chunks, count(*) FILTER (entry) AS "entryChunks", count(*) FILTER (asset) AS "assetChunks", CAST(sum(s) AS BIGINT) AS "parsedSize",
  CAST(sum(g) AS BIGINT) AS "gzipSize", CAST(sum(b) AS BIGINT) AS "brotliSize", max(page_id) > 0 AS "hasSourceMaps", 3 * count(*) AS "totalModules" FROM c""",
)
def bundle_summary_totals(spark, sf_dir):
    rows = ch.chunk_rows(page_chunks(spark, sf_dir), _modules(spark, sf_dir))
    return ch.bundle_totals(rows, _modules(spark, sf_dir)).drop("trace_id")


@query(
    "f11_bundle_summary_packages",
    CHUNKS + PACKAGES + """ SELECT "packageName", "parsedSize" FROM pk ORDER BY 2 DESC, 1 LIMIT 5""",
)
def bundle_summary_packages(spark, sf_dir):
    leaves = _modules(spark, sf_dir)
    rows = ch.chunk_rows(page_chunks(spark, sf_dir), leaves)
    report = ch.bundle_summary(rows, ch.packages(leaves), leaves)
    return report["topPackages"].select("packageName", "parsedSize")


@query(
    "f14_bundle_capabilities",
    CHUNKS
    + """ SELECT TRUE AS "bundleAnalyzer", CAST(1 AS BIGINT) AS "totalChunks", CAST(3 AS BIGINT) AS "totalModules", TRUE AS "hasGzipSizes",
  TRUE AS "hasBrotliSizes", page_id > 0 AS "hasSourceMaps", CAST(entry AS BIGINT) AS "entryChunks" FROM c""",
)
def bundle_capabilities(spark, sf_dir):
    """Each page as a bundle of one chunk."""
    docs = page_chunks(spark, sf_dir).select(
        F.col("chunkIndex").cast("string").alias("trace_id"),
        F.concat(F.lit("/"), F.col("chunkIndex").cast("string")).alias("path"),
        F.lit(0).cast("bigint").alias("fileSizeBytes"),
        F.parse_json(F.concat(F.lit("["), F.to_json("chunk"), F.lit("]"))).alias("doc"),
    )
    return chunk_dataset(spark, docs).capabilities().drop("trace_id")


@query(
    "a07_chunk_documents",
    """SELECT page_id % 2 AS valid, count(*) AS chunks FROM pages WHERE page_id % 2 = 1 GROUP BY 1""",
)
def chunk_documents(spark, sf_dir):
    """Each page as a one-chunk document; even ones lack a required member."""
    chunk = F.to_json("chunk")
    text = F.when(F.col("chunkIndex") % 2 == 0, F.replace(chunk, F.lit('"mapSize"'), F.lit('"size"'))).otherwise(chunk)
    docs = page_chunks(spark, sf_dir).select(
        F.col("chunkIndex").cast("string").alias("trace_id"),
        F.parse_json(F.concat(F.lit("["), text, F.lit("]"))).alias("doc"),
    )
    valid = (F.col("trace_id").cast("bigint") % 2).alias("valid")
    return ch.chunks_of(docs).groupBy(valid).agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "a05_source_kinds",
    """SELECT 'devtools' AS kind, count(*) AS n FROM conversations
UNION ALL SELECT 'vite-bundle', count(*) FROM pages
UNION ALL SELECT 'raw-json', (SELECT count(*) FROM events) + (SELECT count(*) FROM customer)
UNION ALL SELECT NULL, count(*) FROM benchmark""",
)
def source_kinds(spark, sf_dir):
    """Trace documents, chunk lists, other JSON and plain text, told apart by their heads."""
    traces = turn_documents(spark, sf_dir).select("text")
    lists = page_chunks(spark, sf_dir).select(F.concat(F.lit(" ["), F.to_json("chunk"), F.lit("]")).alias("text"))
    other = read_table(spark, sf_dir, "events").select(F.col("props").alias("text"))
    arrays = read_table(spark, sf_dir, "customer").select(
        F.to_json(F.array(F.struct("c_custkey", F.col("c_name").alias("name")))).alias("text")
    )
    words = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("# "), "text").alias("text"))
    texts = traces.union(lists).union(other).union(arrays).union(words)
    heads = texts.select(
        F.left("text", F.lit(HEAD_BYTES)).alias("head"),
        F.to_json(F.try_variant_get(F.try_parse_json("text"), "$[0]", "variant")).alias("first_item"),
        F.col("text").rlike(TRACE_EVENTS).alias("has_events"),
        F.lit(None).cast("string").alias("header"),
    )
    return heads.groupBy(source_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _word(number):
    return F.lpad(F.hex(number), 8, "0")


@query(
    "a09_edge_sections",
    """SELECT 'p' || p_partkey AS path, q.section, q.node, q.pos, p_partkey + q.add AS target FROM part, (VALUES
  ('source_children', 0, 0, 0), ('source_children', 2, 0, 7), ('source_children', 2, 1, 9), ('module_dependents', 0, 0, 1)) AS q(section, node, pos, add)""",
)
def edge_sections(spark, sf_dir):
    """Each part as a binary file with two edge sections, decoded again."""
    return edges(decode_contents(graph_contents(spark, sf_dir)))


def graph_contents(spark, sf_dir):
    """(path, content): each part as a binary file with two edge sections."""
    key = F.col("p_partkey")
    children = [F.lit(3), F.lit(1), F.lit(1), F.lit(3), key, key + 7, key + 9]
    dependents = [F.lit(1), F.lit(1), key + 1]
    header = '{"source_children":{"offset":0,"length":28},"module_dependents":{"offset":28,"length":12}}'
    parts = [F.lit(f"{len(header):08X}"), F.hex(F.encode(F.lit(header), "UTF-8")), *[_word(w) for w in (*children, *dependents)]]
    return spread_table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("path"), F.unhex(F.concat(*parts)).alias("content")
    )


# Module graph ---------------------------------------------------------------------------
def _graph(spark, sf_dir):
    """Sources and modules are parts, parts of files are line items, files are suppliers."""
    part = read_table(spark, sf_dir, "part")
    item = read_table(spark, sf_dir, "lineitem")
    supplier = read_table(spark, sf_dir, "supplier")
    graph, key = F.lit("g").alias("trace_id"), F.col("p_partkey")
    brand = F.translate("p_brand", "#", "-")
    segment = (
        F.when(key == 0, "[project]/")
        .when(key < 4, F.concat(F.lit("[project]/node_modules/"), brand, F.lit("/")))
        .otherwise(F.concat(brand, F.lit("."), key.cast("string")))
    )
    sources = part.select(
        graph,
        key.alias("sourceIndex"),
        segment.alias("segment"),
        F.when(key > 0, F.floor(key / 4)).alias("parentIndex"),
    )
    children = part.filter(key > 0).select(
        graph, F.floor(key / 4).alias("node"), key.alias("target")
    )
    parts = item.select(
        graph,
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunkPartIndex"),
        F.col("l_partkey").alias("sourceIndex"),
        F.col("l_suppkey").alias("outputFileIndex"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.floor(F.col("l_quantity") / 2).alias("compressedSize"),
    )
    nation = F.col("s_nationkey") % 4
    folder = F.when(F.col("s_suppkey") % 3 == 0, "a/server/").otherwise("a/static/")
    ext = F.when(nation == 0, ".js").when(nation == 1, ".css").when(nation == 2, ".json").otherwise("")
    # Every part is in one more file that does not exist.
    nowhere = part.select(
        graph,
        (-key - 1).alias("chunkPartIndex"),
        key.alias("sourceIndex"),
        F.lit(-1).cast("bigint").alias("outputFileIndex"),
        F.col("p_size").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("compressedSize"),
    )
    parts = parts.unionByName(nowhere)
    outputs = supplier.select(
        graph,
        F.col("s_suppkey").alias("fileIndex"),
        F.concat(F.lit("[output]/"), folder, F.translate("s_name", "#", "-"), ext).alias("filename"),
    )
    modules = part.select(
        graph,
        key.alias("moduleIndex"),
        F.concat(F.lit("id-"), key.cast("string")).alias("ident"),
        F.when(
            F.col("p_size") % 2 == 0, F.concat(F.lit("[project]/node_modules/"), brand, F.lit("/"), key.cast("string"))
        ).otherwise(F.concat(F.lit("[project]/src/"), key.cast("string"))).alias("path"),
    )
    section = (
        F.when(F.col("l_returnflag") == "A", "module_dependencies")
        .when(F.col("l_returnflag") == "N", "async_module_dependencies")
        .when(F.col("l_linestatus") == "F", "module_dependents")
        .otherwise("async_module_dependents")
    )
    links = item.select(
        graph,
        section.alias("section"),
        F.col("l_partkey").alias("node"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_suppkey") * 25).alias("target"),
    )
    return sources, children, parts, outputs, modules, links


GRAPH = r"""WITH RECURSIVE src AS (
  SELECT p_partkey AS i, CASE WHEN p_partkey = 0 THEN '[project]/' WHEN p_partkey < 4 THEN '[project]/node_modules/' || replace(p_brand, '#', '-') || '/'
    ELSE replace(p_brand, '#', '-') || '.' || p_partkey END AS seg, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS par FROM part), pt AS (
  SELECT i, seg AS path FROM src WHERE par IS NULL UNION ALL SELECT src.i, pt.path || src.seg FROM src JOIN pt ON src.par = pt.i), parts AS (
  SELECT l_orderkey * 8 + l_linenumber AS n, l_partkey AS i, l_suppkey AS f, CAST(l_quantity AS BIGINT) AS size, CAST(floor(l_quantity / 2) AS BIGINT) AS comp FROM lineitem
  UNION ALL SELECT -p_partkey - 1, p_partkey, -1, CAST(p_size AS BIGINT), 0 FROM part), cl AS (
  SELECT i AS d, i AS a FROM src UNION ALL SELECT d, a // 4 FROM cl WHERE a > 0), own AS (
  SELECT i, sum(size) AS size, sum(comp) AS comp, count(*) AS n FROM parts GROUP BY 1), tot AS (
  SELECT a AS i, sum(size) AS size, sum(comp) AS comp, sum(n) AS n FROM cl JOIN own ON own.i = cl.d GROUP BY 1), s AS (
  SELECT src.i, regexp_replace(path, '(\[project\]/){2,}', '[project]/', 'g') AS path, seg, par, ends_with(seg, '/') OR EXISTS (SELECT 1 FROM src k WHERE k.par = src.i) AS dir,
    CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(coalesce(comp, 0) AS BIGINT) AS comp, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM src JOIN pt USING (i) LEFT JOIN tot USING (i)), fo AS (
  SELECT f AS i, sum(size) AS size, sum(comp) AS comp, count(*) AS n FROM parts GROUP BY 1), f0 AS (
  SELECT s_suppkey AS i, CASE WHEN s_suppkey % 3 = 0 THEN 'a/server/' ELSE 'a/static/' END || replace(s_name, '#', '-') ||
    CASE s_nationkey % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.css' WHEN 2 THEN '.json' ELSE '' END AS clean,
    CASE WHEN s_suppkey % 3 = 0 THEN 'server' ELSE 'client' END AS env,
    CASE s_nationkey % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'css' WHEN 2 THEN 'json' ELSE 'other' END AS type FROM supplier), f AS (
  SELECT f0.*, CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(coalesce(comp, 0) AS BIGINT) AS comp, coalesce(n, 0) AS n FROM f0 LEFT JOIN fo USING (i)), pl AS (
  SELECT parts.i, string_agg(DISTINCT clean, ', ' ORDER BY clean) AS files, count(DISTINCT clean) AS nf, string_agg(DISTINCT env, ', ' ORDER BY env) AS envs
  FROM parts JOIN f ON f.i = parts.f GROUP BY 1), tree AS (
  SELECT s.*, coalesce(nf, 0) AS nf, coalesce(files, '') AS files, coalesce(envs, '') AS envs FROM s LEFT JOIN pl USING (i) WHERE NOT dir), ed AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN 'sync' WHEN l_returnflag = 'N' THEN 'async' WHEN l_linestatus = 'F' THEN 'in' ELSE 'async_in' END AS sec, l_partkey AS a, l_suppkey * 25 AS b FROM lineitem), dg AS (
  SELECT a AS i, count(*) FILTER (sec = 'sync') AS d1, count(*) FILTER (sec = 'async') AS d2, count(*) FILTER (sec = 'in') AS d3, count(*) FILTER (sec = 'async_in') AS d4 FROM ed GROUP BY 1), m AS (
  SELECT p_partkey AS i, 'id-' || p_partkey AS ident, CASE WHEN p_size % 2 = 0 THEN 'node_modules/' || replace(p_brand, '#', '-') || '/' || p_partkey ELSE 'src/' || p_partkey END AS clean,
    p_size % 2 = 0 AS nm, CASE WHEN p_size % 2 = 0 THEN replace(p_brand, '#', '-') END AS package, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2, coalesce(d3, 0) AS d3, coalesce(d4, 0) AS d4
  FROM part LEFT JOIN dg ON dg.i = p_partkey), dep AS (
  SELECT '[project]/' || x.clean AS "fromModule", '[project]/' || y.clean AS "toModule", sec AS kind FROM ed JOIN m x ON x.i = ed.a JOIN m y ON y.i = ed.b WHERE sec IN ('sync', 'async')), pk AS (
  SELECT package AS "packageName", CAST(sum(size) AS BIGINT) AS "totalSize", CAST(sum(comp) AS BIGINT) AS "compressedSize", CAST(sum(mc) AS BIGINT) AS "moduleCount", CAST(sum(sc) AS BIGINT) AS "sourceCount" FROM (
    SELECT nullif(regexp_extract(path, '^.*?node_modules/+([^/]+)', 1), '') AS package, size, comp, 0 AS mc, 1 AS sc FROM tree
    UNION ALL SELECT package, 0, 0, 1, 0 FROM m) WHERE package IS NOT NULL GROUP BY 1)"""
TOTAL_SQL = 'size AS "totalSize", comp AS "compressedSize", n AS "chunkPartCount"'
SOURCE_SQL = f'i AS "sourceIndex", path, seg AS segment, par AS "parentIndex", dir AS "isDirectory", {TOTAL_SQL}'


def _sources(spark, sf_dir):
    sources, children, parts, *_ = _graph(spark, sf_dir)
    return mg.source_rows(sources, children, parts)


def _files(spark, sf_dir):
    _, _, parts, outputs, _, _ = _graph(spark, sf_dir)
    return mg.output_files(outputs, parts)


def _source_tree(spark, sf_dir):
    parts = _graph(spark, sf_dir)[2]
    return mg.source_tree(_sources(spark, sf_dir), parts, _files(spark, sf_dir))


def _module_table(spark, sf_dir):
    *_, modules, links = _graph(spark, sf_dir)
    return mg.modules(modules, links)


def _dependencies(spark, sf_dir):
    *_, modules, links = _graph(spark, sf_dir)
    return mg.module_dependencies(modules, links)


@query("i01_source_paths", GRAPH + ' SELECT i AS "sourceIndex", path, seg AS segment, par AS "parentIndex", dir AS "isDirectory" FROM s')
def source_paths(spark, sf_dir):
    sources, children, *_ = _graph(spark, sf_dir)
    return mg.source_paths(sources, children).drop("trace_id")


@query("i02_sources", GRAPH + f" SELECT {SOURCE_SQL} FROM s")
def graph_sources(spark, sf_dir):
    return _sources(spark, sf_dir).drop("trace_id")


@query(
    "i03_output_files",
    GRAPH
    + f""" SELECT i AS "fileIndex", '[output]/' || clean AS filename, clean AS "cleanFilename", env AS environment, type AS "fileType", {TOTAL_SQL} FROM f""",
)
def output_files(spark, sf_dir):
    return _files(spark, sf_dir).drop("trace_id")


@query(
    "i04_chunk_parts",
    GRAPH
    + """ SELECT parts.n AS "chunkPartIndex", parts.i AS "sourceIndex", path AS "sourcePath", parts.f AS "outputFileIndex",
  coalesce('[output]/' || clean, 'output:' || parts.f) AS "outputFilename", parts.size, parts.comp AS "compressedSize"
FROM parts JOIN s USING (i) LEFT JOIN f ON f.i = parts.f""",
)
def chunk_parts(spark, sf_dir):
    sources, children, parts, outputs, *_ = _graph(spark, sf_dir)
    return mg.chunk_parts(parts, mg.source_paths(sources, children), outputs).drop("trace_id")


@query("i05_source_tree", GRAPH + f' SELECT {SOURCE_SQL}, nf AS "outputFileCount", files AS "outputFiles", envs AS environments FROM tree')
def source_tree(spark, sf_dir):
    rows = _source_tree(spark, sf_dir).drop("trace_id")
    return rows.withColumn("outputFileCount", F.col("outputFileCount").cast("bigint"))


@query(
    "i06_modules",
    GRAPH
    + """ SELECT i AS "moduleIndex", ident, '[project]/' || clean AS path, clean AS "cleanPath", nm AS "isNodeModule", package AS "packageName",
  d1 AS "dependencyCount", d2 AS "asyncDependencyCount", d3 AS "dependentCount", d4 AS "asyncDependentCount" FROM m""",
)
def graph_modules(spark, sf_dir):
    return _module_table(spark, sf_dir).drop("trace_id")


@query("i07_module_dependencies", GRAPH + " SELECT * FROM dep")
def module_dependencies(spark, sf_dir):
    return _dependencies(spark, sf_dir).select("fromModule", "toModule", "kind")


@query("i08_package_sizes", GRAPH + " SELECT * FROM pk")
def package_sizes(spark, sf_dir):
    rows = mg.package_sizes(_source_tree(spark, sf_dir), _module_table(spark, sf_dir))
    return rows.drop("trace_id")


@query(
    "i09_environment_breakdown",
    GRAPH
    + """ SELECT env AS environment, CAST(sum(size) AS BIGINT) AS "totalSize", CAST(sum(comp) AS BIGINT) AS "compressedSize", count(*) AS "fileCount" FROM f GROUP BY 1""",
)
def environment_breakdown(spark, sf_dir):
    return mg.environment_breakdown(_files(spark, sf_dir)).drop("trace_id")


def _route_frames(spark, sf_dir):
    """Nations are routes with a file of their orders each, and routes that have none."""
    nation = read_table(spark, sf_dir, "nation")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/x/"), F.col("n_name"), F.lit("/analyze.data"))
    route_rows = nation.select(
        F.col("n_nationkey").alias("pos"),
        F.concat(F.lit("/"), "n_name").alias("route"),
        path.alias("analyzePath"),
    )
    gone = nation.select(
        (F.col("n_nationkey") + 1000).alias("pos"),
        F.concat(F.lit("/gone/"), "n_name").alias("route"),
        F.concat(F.lit("/x/gone/"), "n_name", F.lit("/analyze.data")).alias("analyzePath"),
    )
    route_rows = route_rows.unionByName(gone)
    files = nation.select(path.alias("trace_id"), "n_nationkey")
    owned = customer.join(files, customer.c_nationkey == files.n_nationkey)
    parts = orders.join(owned, orders.o_custkey == owned.c_custkey).select(
        "trace_id",
        F.floor("o_totalprice").alias("size"),
        F.floor(F.col("o_totalprice") / 2).alias("compressedSize"),
    )
    return route_rows, files, owned.select("trace_id"), owned.filter("c_acctbal > 0").select("trace_id"), parts


@query(
    "i10_routes",
    """SELECT n_nationkey AS pos, '/' || n_name AS route, TRUE AS "hasAnalyzeData" FROM nation
UNION ALL SELECT n_nationkey + 1000, '/gone/' || n_name, FALSE FROM nation""",
)
def routes(spark, sf_dir):
    route_rows, files, *_ = _route_frames(spark, sf_dir)
    return mg.routes(route_rows, files).drop("analyzePath")


@query(
    "i11_route_sizes",
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS sources, count(*) FILTER (c_acctbal > 0) AS files FROM customer GROUP BY 1), o AS (
  SELECT c_nationkey AS k, CAST(sum(floor(o_totalprice)) AS BIGINT) AS size, CAST(sum(floor(o_totalprice / 2)) AS BIGINT) AS comp, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT '/' || n_name AS route, coalesce(size, 0) AS "totalSize", coalesce(comp, 0) AS "compressedSize", coalesce(sources, 0) AS "sourceCount",
  coalesce(files, 0) AS "outputFileCount", coalesce(n, 0) AS "chunkPartCount"
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey""",
)
def route_sizes(spark, sf_dir):
    route_rows, files, sources, outputs, parts = _route_frames(spark, sf_dir)
    return mg.route_sizes(mg.routes(route_rows, files), sources, outputs, parts)


@query(
    "i12_dependency_stats",
    GRAPH
    + """, b AS (SELECT '[project]/' || clean AS path FROM m ORDER BY d3 DESC, '[project]/' || clean LIMIT 1)
SELECT count(*) FILTER (kind = 'sync') AS "syncEdgeCount", count(*) FILTER (kind = 'async') AS "asyncEdgeCount", (SELECT path FROM b) AS "mostDependedOnModule" FROM dep""",
)
def dependency_stats(spark, sf_dir):
    stats = mg.dependency_stats(_dependencies(spark, sf_dir))
    best = mg.most_depended_on(_module_table(spark, sf_dir))
    return stats.join(best, "trace_id", "full_outer").drop("trace_id")


@query(
    "f12_graph_summary_sources",
    GRAPH + """ SELECT path, size AS "totalSize" FROM tree ORDER BY size DESC, path LIMIT 10""",
)
def graph_summary_sources(spark, sf_dir):
    return _graph_summary(spark, sf_dir)["topSources"].select("path", "totalSize")


@query(
    "f12_graph_summary_totals",
    """SELECT (SELECT count(*) FROM part) AS "totalSources", (SELECT count(*) FROM supplier) AS "totalOutputFiles",
  (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part) AS "totalChunkParts", (SELECT count(*) FROM part) AS "totalModules",
  (SELECT 2 * count(*) FROM nation) AS "routeCount" """,
)
def graph_summary_totals(spark, sf_dir):
    return _graph_summary(spark, sf_dir)["totals"]


def _graph_summary(spark, sf_dir):
    route_rows, files, *_ = _route_frames(spark, sf_dir)
    sources, children, parts, outputs, modules, links = _graph(spark, sf_dir)
    rows, file_rows = mg.source_rows(sources, children, parts), mg.output_files(outputs, parts)
    tree, table = mg.source_tree(rows, parts, file_rows), mg.modules(modules, links)
    return mg.graph_summary(
        mg.routes(route_rows, files),
        sources,
        file_rows,
        parts,
        table,
        tree,
        mg.package_sizes(tree, table),
        mg.module_dependencies(modules, links),
    )


@query(
    "f13_route_report",
    """WITH c AS (SELECT count(*) AS sources, count(*) FILTER (c_acctbal > 0) AS files FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3)), o AS (
  SELECT CAST(sum(floor(o_totalprice)) AS BIGINT) AS size, CAST(sum(floor(o_totalprice / 2)) AS BIGINT) AS comp, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)
SELECT '/' || n_name AS route, size AS "totalSize", comp AS "compressedSize", sources AS "sourceCount", files AS "outputFileCount", n AS "chunkPartCount" FROM nation, c, o WHERE n_nationkey = 3""",
)
def route_report(spark, sf_dir):
    route_rows, files, sources, outputs, parts = _route_frames(spark, sf_dir)
    table = mg.routes(route_rows, files)
    name = route_rows.filter("pos = 3").first()["route"]
    sizes = mg.route_sizes(table, sources, outputs, parts)
    indexed = [
        df.withColumn(column, F.lit(0))
        for df, column in ((sources, "sourceIndex"), (outputs, "fileIndex"), (parts, "chunkPartIndex"))
    ]
    return mg.route_report(table, sizes, *indexed, name)["analysis"]
