"""Documents, JSON discovery, embedded blobs, artifacts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import blobs, paths
from quarrylens.operators.json_walk import walk_json
from quarrylens.plans import artifacts as art
from quarrylens.plans import dims, rawjson
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.documents import dataset_id
from quarrylens.sources.star_events import base_rows, by_type, read_table, spread_table, trace_of
from quarrylens.sources.trace_events import trace_events, trace_metadata


# Trace documents ------------------------------------------------------------------------
def turn_documents(spark, sf_dir):
    """Each conversation turn as a trace document: an object, or a bare event array."""
    turns = spread_table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")

    def event(name, offset):
        return F.struct(
            F.lit(name).alias("name"),
            F.lit("X").alias("ph"),
            F.col("conv_id").alias("pid"),
            F.col("turn").alias("tid"),
            (F.col("turn") * 1000 + offset).alias("ts"),
            F.length("text").alias("dur"),
            F.struct(F.struct("role", "text").alias("data")).alias("args"),
        )

    events = F.array(event("say", 0), event("end", 500))
    whole = F.struct(F.col("role").alias("origin"), events.alias("traceEvents"))
    text = F.when(F.col("turn") % 3 == 2, F.to_json(events)).otherwise(F.to_json(whole))
    return turns.select(dataset_id(key).alias("trace_id"), text.alias("text")).withColumn(
        "doc", F.parse_json("text")
    )


TURN_EVENTS = """SELECT left(sha256(conv_id || '-' || turn), 8) AS trace_id, n AS "rawIndex",
  CASE n WHEN 0 THEN 'say' ELSE 'end' END AS name, 'X' AS ph, conv_id AS pid, turn AS tid,
  turn * 1000 + n * 500 AS ts, CAST(length(text) AS DOUBLE) AS dur, role, md5(text) AS digest
FROM conversations, (SELECT unnest([0, 1]) AS n)"""


@query("a02_trace_document_events", TURN_EVENTS)
def trace_document_events(spark, sf_dir):
    rows = trace_events(turn_documents(spark, sf_dir))
    return rows.select(
        "trace_id",
        "rawIndex",
        "name",
        "ph",
        "pid",
        "tid",
        "ts",
        "dur",
        F.try_variant_get("args", "$.data.role", "string").alias("role"),
        F.md5(F.encode(F.try_variant_get("args", "$.data.text", "string"), "UTF-8")).alias("digest"),
    )


@query(
    "a03_trace_metadata",
    """SELECT left(sha256(conv_id || '-' || turn), 8) AS trace_id,
  CASE WHEN turn % 3 = 2 THEN '{}' ELSE '{"origin":"' || role || '"}' END AS metadata FROM conversations""",
)
def trace_document_metadata(spark, sf_dir):
    return trace_metadata(turn_documents(spark, sf_dir))


# Discovery ------------------------------------------------------------------------------
def _turn_nodes(spark, sf_dir):
    turns = spread_table(spark, sf_dir, "conversations")
    inner = F.struct(
        F.col("turn").alias("startTurn"),
        F.array(F.col("role"), F.col("turn").cast("string")).alias("mix"),
        F.when(F.col("turn") > 1, F.lit(True)).alias("late"),
    )
    body = F.struct(F.col("role"), F.array(inner, inner).alias("items"))
    docs = turns.select("conv_id", "turn", F.to_json(body).alias("text"))
    return walk_json(docs, ["conv_id", "turn"], "text")


@query(
    "g01_path_catalog",
    """WITH t AS (SELECT conv_id, turn, role, CAST(turn AS VARCHAR) AS n FROM conversations), n AS (
  SELECT conv_id, turn, '$' AS path, 'object' AS kind, NULL AS v, 0 AS i FROM t
  UNION ALL SELECT conv_id, turn, '$.role', 'string', '"' || role || '"', 0 FROM t
  UNION ALL SELECT conv_id, turn, '$.items', 'array', NULL, 0 FROM t
  UNION ALL SELECT conv_id, turn, p, k, CASE s WHEN 'n' THEN n WHEN 'r' THEN '"' || role || '"' WHEN 't' THEN 'true' END, i
    FROM t, (SELECT unnest([0, 1]) AS j), (VALUES ('$.items[]', 'object', 'x', 0), ('$.items[].startTurn', 'number', 'n', 0),
      ('$.items[].mix', 'array', 'x', 0), ('$.items[].mix[]', 'string', 'r', 0), ('$.items[].mix[]', 'string', 's', 1), ('$.items[].late', 'boolean', 't', 0)) AS q(p, k, s, i)
    WHERE p <> '$.items[].late' OR turn > 1), m AS (
  SELECT conv_id, turn, path, kind, CASE WHEN path = '$.items[].mix[]' AND v IS NULL THEN '"' || turn || '"' ELSE v END AS v, i FROM n), f AS (
  SELECT path, v, min(struct_pack(a := conv_id, b := turn, c := i)) AS first_at FROM m WHERE v IS NOT NULL GROUP BY 1, 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_at) AS rn FROM f), s AS (
  SELECT path, string_agg(v, ',' ORDER BY rn) AS samples FROM r WHERE rn <= 5 GROUP BY 1), c AS (
  SELECT path, count(*) AS count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM m GROUP BY 1)
SELECT path, count, types, coalesce(samples, '') AS samples FROM c LEFT JOIN s USING (path)""",
)
def path_catalog(spark, sf_dir):
    rows = rawjson.path_catalog(_turn_nodes(spark, sf_dir), keys=(), order=("conv_id", "turn", "pos"))
    return rows.withColumn("types", F.array_join("types", ",")).withColumn(
        "samples", F.array_join("samples", ",")
    )


@query(
    "g01_event_props_paths",
    """SELECT '$' AS path, count(*) AS count, 'object' AS types FROM events
UNION ALL SELECT '$.k', count(*), 'number' FROM events""",
)
def event_props_paths(spark, sf_dir):
    nodes = walk_json(spread_table(spark, sf_dir, "events"), ["event_id"], "props")
    rows = rawjson.path_catalog(nodes, keys=(), order=("event_id",))
    return rows.withColumn("types", F.array_join("types", ",")).drop("samples")


@query(
    "g02_path_samples",
    """SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events ORDER BY 'e' || event_id LIMIT 5""",
)
def path_samples(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("trace_id"), "props"
    )
    return rawjson.path_samples(walk_json(docs, ["trace_id"], "props"), "$.k").select("value")


@query("g03_json_kinds", """SELECT 'array' AS kind, 4 * count(*) - count(*) AS n FROM conversations
UNION ALL SELECT 'object', 3 * count(*) FROM conversations
UNION ALL SELECT 'string', 5 * count(*) FROM conversations
UNION ALL SELECT 'number', 2 * count(*) FROM conversations
UNION ALL SELECT 'boolean', 2 * count(*) FILTER (turn > 1) FROM conversations""")
def json_kinds(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    return nodes.groupBy(rawjson.json_kind_of(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("g04_time_like_paths", "SELECT unnest(['$.items[].startTurn']) AS path")
def time_like_paths(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    return rawjson.time_like_paths(rawjson.path_catalog(nodes, keys=(), order=("conv_id", "turn", "pos")))


def _conversation_documents(spark, sf_dir):
    """A document per turn with two arrays of one name and one nested in objects."""
    turns = spread_table(spark, sf_dir, "conversations")
    word = F.split("text", " ")
    parts = F.transform(word, lambda w: F.struct(w.alias("w"), F.length(w).alias("n")))
    body = F.struct(
        parts.alias("words"),
        F.array(F.struct(F.array("turn").alias("ids")), F.struct(F.array("turn", "turn").alias("ids"))).alias("pair"),
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.to_json(body).alias("text")
    )


@query(
    "g05_inferred_tables",
    """WITH t AS (SELECT conv_id || '-' || turn AS trace_id, len(string_split(text, ' ')) AS n FROM conversations)
SELECT trace_id, 'raw.inferred.words' AS name, '$.words' AS path, n AS rows FROM t
UNION ALL SELECT trace_id, 'raw.inferred.pair', '$.pair', 2 FROM t
UNION ALL SELECT trace_id, 'raw.inferred.pair.ids', '$.pair[].ids', 1 FROM t
UNION ALL SELECT trace_id, 'raw.inferred.pair.ids.2', '$.pair[].ids', 2 FROM t""",
)
def inferred_tables(spark, sf_dir):
    nodes = walk_json(_conversation_documents(spark, sf_dir), ["trace_id"], "text")
    rows = rawjson.inferred_tables(nodes).drop("pos", "occurrence")
    return rows.withColumn("rows", F.col("rows").cast("bigint"))


@query(
    "g06_inferred_rows",
    """WITH t AS (SELECT conv_id || '-' || turn AS trace_id, turn, string_split(text, ' ') AS ws FROM conversations), w AS (
  SELECT trace_id, unnest(ws) AS w FROM t)
SELECT trace_id, 'raw.inferred.words' AS name, count(*) AS rows, CAST(sum(length(w)) AS BIGINT) AS total FROM w GROUP BY 1
UNION ALL SELECT trace_id, 'raw.inferred.pair', 2, 0 FROM t
UNION ALL SELECT trace_id, 'raw.inferred.pair.ids', 1, turn FROM t
UNION ALL SELECT trace_id, 'raw.inferred.pair.ids.2', 2, 2 * turn FROM t""",
)
def inferred_rows(spark, sf_dir):
    nodes = rawjson.held_arrays(walk_json(_conversation_documents(spark, sf_dir), ["trace_id"], "text", leaves=False))
    rows = rawjson.inferred_rows(rawjson.inferred_tables(nodes), nodes)
    number = F.coalesce(
        F.try_variant_get("row", "$.n", "bigint"), F.try_variant_get("row", "$.value", "bigint"), F.lit(0)
    )
    return rows.groupBy("trace_id", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(number).alias("total")
    )


@query(
    "g06_inferred_columns",
    """SELECT conv_id || '-' || turn AS trace_id, q.* FROM conversations, (VALUES ('raw.inferred.words', 'w', 'string'), ('raw.inferred.words', 'n', 'number'),
  ('raw.inferred.pair', 'ids', 'array'), ('raw.inferred.pair.ids', 'index', 'number'), ('raw.inferred.pair.ids', 'value', 'number'),
  ('raw.inferred.pair.ids.2', 'index', 'number'), ('raw.inferred.pair.ids.2', 'value', 'number')) AS q(name, "column", type)""",
)
def inferred_columns(spark, sf_dir):
    nodes = rawjson.held_arrays(walk_json(_conversation_documents(spark, sf_dir), ["trace_id"], "text", leaves=False))
    return rawjson.inferred_columns(rawjson.inferred_rows(rawjson.inferred_tables(nodes), nodes))


@query(
    "f09_raw_summary",
    """SELECT conv_id || '-' || turn AS trace_id, 'object' AS "topLevelType", 9 AS "pathCount", 0 AS "embeddedBlobCount" FROM conversations""",
)
def raw_summary(spark, sf_dir):
    docs = _conversation_documents(spark, sf_dir).withColumn("doc", F.parse_json("text"))
    nodes = walk_json(docs, ["trace_id"], "text")
    none = spark.createDataFrame([], "trace_id string")
    report = rawjson.raw_summary(docs, rawjson.inferred_tables(nodes), rawjson.path_catalog(nodes), none)
    return report["totals"]


@query(
    "f10_raw_capabilities",
    """SELECT conv_id || '-' || turn AS trace_id, TRUE AS json, 4 AS "inferredTables", 0 AS "embeddedBlobs", 0 AS "timeFields", 4 AS "nestedInferredTables" FROM conversations""",
)
def raw_capabilities(spark, sf_dir):
    docs = _conversation_documents(spark, sf_dir)
    nodes = walk_json(docs, ["trace_id"], "text")
    none = spark.createDataFrame([], "trace_id string")
    return rawjson.raw_capabilities(
        rawjson.inferred_tables(nodes), rawjson.path_catalog(nodes), none, docs
    )


# Blobs ----------------------------------------------------------------------------------
def blob_documents(spark, sf_dir):
    """Documents wrapping their text in each of the ways a payload may be held."""
    docs = spread_table(spark, sf_dir, "documents")
    coded = F.base64(F.encode("text", "UTF-8"))
    coded = F.regexp_replace(coded, r"[\r\n]", "")
    body = F.struct(
        F.struct(
            F.lit("base64").alias("encoding"),
            F.lit("text/markdown").alias("mimeType"),
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
            coded.alias("body"),
        ).alias("attachment"),
        F.concat(F.lit("data:text/plain;base64,"), coded).alias("picture"),
        coded.alias("rawImage"),
        F.array(*[F.lit(x) for x in (137, 80, 78, 71, 1, 2, 3, 4)]).alias("bytes"),
        F.col("lang").alias("note"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("trace_id"), F.to_json(body).alias("text"), F.lit("d.json").alias("path")
    )


# Base64 of fewer than ten bytes is too short to be taken for a payload by itself.
BLOBS = """, d AS (SELECT CAST(doc_id AS VARCHAR) AS trace_id, text, sha256(text) AS h, octet_length(encode(text)) AS n FROM documents), b0 AS (
  SELECT trace_id, 0 AS o, '$.attachment.body' AS path, 'text/markdown' AS "mediaType", n AS "sizeBytes", 'doc-' || trace_id || '.md' AS hinted,
    'high' AS confidence, 'base64' AS encoding, 'text' AS "decodedKind", 'wrapper-object' AS "containerKind", h AS hash FROM d
  UNION ALL SELECT trace_id, 1, '$.picture', 'text/plain', n, NULL, 'high', 'data-url+base64', 'text', 'data-url', h FROM d
  UNION ALL SELECT trace_id, 2, '$.rawImage', 'text/plain', n, NULL, 'medium', 'base64', 'text', 'base64-string', h FROM d WHERE n >= 10
  UNION ALL SELECT trace_id, 3, '$.bytes', 'image/png', 8, NULL, 'medium', 'bytes', 'binary', 'byte-array', sha256(unhex('89504E4701020304')) FROM d), b1 AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY o) - 1 AS i FROM b0), b AS (
  SELECT *, coalesce(hinted, 'embedded-000' || i || '.bin') AS filename FROM b1)"""


@query(
    "g13_embedded_blobs",
    "WITH " + BLOBS[2:] + """
SELECT trace_id, 'embedded-blob:' || i AS "embeddedBlobId", 'artifact:raw:embedded:' || i AS "artifactId", path, "mediaType", "sizeBytes",
  filename, confidence, encoding, "decodedKind", "containerKind", hash FROM b""",
)
def embedded_blobs(spark, sf_dir):
    return rawjson.embedded_blobs(blob_documents(spark, sf_dir)).drop("bytes")


@query(
    "g08_base64_texts",
    """SELECT doc_id, length(base64(encode(text))) >= 16 AS whole, FALSE AS cut,
  length(lang || source) >= 16 AND length(lang || source) % 4 = 0 AS plain FROM documents""",
)
def base64_texts(spark, sf_dir):
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    return spread_table(spark, sf_dir, "documents").select(
        "doc_id",
        blobs.is_base64(coded).alias("whole"),
        blobs.is_base64(F.substr(coded, F.lit(2))).alias("cut"),
        blobs.is_base64(F.concat("lang", "source")).alias("plain"),
    )


@query(
    "g11_media_sniff",
    """WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + page_id, html FROM pages
  UNION ALL SELECT 2000000000 + event_id, props FROM events)
SELECT CASE WHEN doc_id >= 2000000000 THEN 'application/json' ELSE 'text/plain' END AS "mediaType", count(*) AS n,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM t GROUP BY 1""",
)
def media_sniff(spark, sf_dir):
    def texts(name, column):
        return read_table(spark, sf_dir, name).select(F.encode(column, "UTF-8").alias("data"))

    data = texts("documents", "text").union(texts("pages", "html")).union(texts("events", "props"))
    return data.groupBy(blobs.sniff_media_type(F.col("data")).alias("mediaType")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes")
    )


def stored_gzip(data):
    """Gzip of bytes in stored blocks: header, blocks of at most 65,535 bytes, CRC, size."""

    def little(number, digits):
        text = F.lpad(F.hex(number), digits, "0")
        return F.concat(*[F.substring(text, i, 2) for i in range(digits - 1, 0, -2)])

    size = F.octet_length(data)
    last = F.floor((size - 1) / 65_535)

    def block(i):
        length = F.least(F.lit(65_535), size - i * 65_535)
        return F.concat(
            F.when(i == last, "01").otherwise("00"),
            little(length, 4),
            little(65_535 - length, 4),
            F.substr(F.hex(data), i.cast("int") * 131_070 + 1, length.cast("int") * 2),
        )

    blocks = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), last), block), "")
    return F.unhex(
        F.concat(F.lit("1F8B0800000000000000"), blocks, little(F.crc32(data), 8), little(size, 8))
    )


@query(
    "g12_gunzip",
    "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS bytes, TRUE AS plain FROM documents",
)
def gunzip(spark, sf_dir):
    """Gzipped texts come back whole; texts that are not gzip give NULL."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    packed = docs.withColumn("packed", stored_gzip(F.col("data")))
    opened = packed.select(
        "doc_id", blobs.gunzip(F.col("packed")).alias("out"), blobs.gunzip(F.col("data")).isNull().alias("plain")
    )
    return opened.select(
        "doc_id",
        F.sha2("out", 256).alias("hash"),
        F.octet_length("out").cast("bigint").alias("bytes"),
        "plain",
    )


# Request bodies and artifacts -----------------------------------------------------------
def body_trace(spark, sf_dir):
    """Errors carry a data URL, views a wrapper object, both under a request id."""
    names = {t: t for t in ("error", "view", "click", "signup", "purchase")}

    def args():
        text = F.concat(F.lit('{"answer":'), F.col("k").cast("string"), F.lit("}"))
        coded = F.base64(F.encode(text, "UTF-8"))
        wrapper = F.struct(F.lit("text/css").alias("contentType"), text.alias("content"))
        data = F.struct(
            F.when(F.col("et").isin("error", "view"), F.concat(F.lit("req-"), F.col("k").cast("string"))).alias("requestId"),
            by_type({"error": F.concat(F.lit("data:application/json;base64,"), coded)}).alias("body"),
            by_type({"view": wrapper}).alias("inner"),
        )
        return F.struct(data.alias("data"))

    return trace_of(spark, sf_dir, names, {t: "I" for t in names}, args)


BODIES = """, bd AS (
  SELECT trace_id, idx, 'request-body:' || idx || ':0' AS "requestBodyId", 'artifact:devtools:request-body:' || idx || ':0' AS "artifactId",
    'req-' || k AS "requestId", 'https://r/' || k AS url, ts AS "tsUs", CASE et WHEN 'error' THEN 'application/json' ELSE 'text/css' END AS "mediaType",
    11 + length(CAST(k AS VARCHAR)) AS "sizeBytes", CASE et WHEN 'error' THEN '$.body' ELSE '$.inner.content' END AS path,
    CASE et WHEN 'error' THEN 'json' ELSE 'text' END AS "decodedKind", CASE et WHEN 'error' THEN 'high' ELSE 'medium' END AS confidence,
    sha256('{"answer":' || k || '}') AS hash FROM e WHERE et IN ('error', 'view'))"""


def _bodies(spark, sf_dir):
    owners = (
        base_rows(spark, sf_dir)
        .select(
            "trace_id",
            F.concat(F.lit("req-"), F.col("k").cast("string")).alias("requestId"),
            F.concat(F.lit("https://r/"), F.col("k").cast("string")).alias("url"),
            F.lit("text/html").alias("mimeType"),
        )
        .distinct()
    )
    return rawjson.request_bodies(body_trace(spark, sf_dir), owners)


@query(
    "d09_request_bodies",
    with_events(BODIES + ' SELECT * EXCLUDE (idx), "requestId" || \'-00\' AS filename FROM bd'),
)
def request_bodies(spark, sf_dir):
    return _bodies(spark, sf_dir).withColumn("hash", F.sha2("bytes", 256)).drop("bytes", "rawIndex")


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def _document_maps(spark, sf_dir):
    """Documents as source maps: every document is the content of one source."""
    docs = spread_table(spark, sf_dir, "documents")
    entry = F.struct(
        F.concat(F.lit("https://m/"), F.col("source")).alias("url"),
        F.lit("x.map").alias("sourceMapUrl"),
        F.struct(
            F.array(F.concat(F.lit("./src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))).alias("sources"),
            F.array("text").alias("sourcesContent"),
        ).alias("sourceMap"),
    )
    whole = F.struct(F.array(entry).alias("sourceMaps"))
    return docs.select(F.col("doc_id").cast("string").alias("trace_id"), F.to_json(whole).alias("metadata"))


@query(
    "d16_source_maps",
    """SELECT CAST(doc_id AS VARCHAR) AS trace_id, 0 AS "mapIndex", 'sourcemap:0' AS "sourceMapId", 'artifact:code:sourcemap:0' AS "artifactId",
  'https://m/' || source AS url, 'x.map' AS "sourceMapUrl", 1 AS "sourceCount", TRUE AS "hasSourcesContent" FROM documents""",
)
def source_maps(spark, sf_dir):
    return dims.source_maps(_document_maps(spark, sf_dir)).drop("content")


@query(
    "d17_sources",
    """SELECT CAST(doc_id AS VARCHAR) AS trace_id, 'source:0:0' AS "sourceId", 'artifact:code:source:0:0' AS "artifactId", 'sourcemap:0' AS "sourceMapId",
  './src/' || lang || '/' || doc_id AS "sourcePath", octet_length(encode(text)) AS bytes, TRUE AS "hasContent", sha256(text) AS hash FROM documents""",
)
def sources(spark, sf_dir):
    rows = dims.sources(dims.source_maps(_document_maps(spark, sf_dir)))
    return rows.select(
        "trace_id",
        "sourceId",
        "artifactId",
        "sourceMapId",
        "sourcePath",
        F.octet_length(F.encode("content", "UTF-8")).cast("bigint").alias("bytes"),
        "hasContent",
        F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"),
    )


def trace_artifact_rows(spark, sf_dir):
    from quarrylens.queries.dim_queries import media_trace

    media = media_trace(spark, sf_dir)
    maps = dims.source_maps(_document_maps(spark, sf_dir))
    no_maps = _empty(spark, "trace_id string, url string, mapIndex bigint")
    return art.all_artifacts(
        art.screenshot_artifacts(dims.screenshots(media)),
        art.script_artifacts(dims.scripts(media, no_maps), dims.script_texts(media)),
        art.source_map_artifacts(maps),
        art.source_artifacts(dims.sources(maps)),
        art.body_artifacts(_bodies(spark, sf_dir)),
    )


ARTIFACTS = BODIES + """, sh AS (SELECT trace_id, k, row_number() OVER (PARTITION BY trace_id ORDER BY ts, idx) - 1 AS n FROM e WHERE et = 'view'), sc AS (
  SELECT trace_id, 's' || k AS sid, arg_max('https://u/' || uid, idx) FILTER (k < 50) AS url,
    arg_min('text é' || uid, idx) FILTER (k > 80) AS text FROM e WHERE et = 'error' GROUP BY 1, 2), a AS (
  SELECT trace_id, 'artifact:devtools:screenshot:' || n AS id, 'image' AS kind, 'image/jpeg' AS "mediaType", 8 + length(CAST(k AS VARCHAR)) AS "sizeBytes",
    sha256('picture ' || k) AS hash FROM sh
  UNION ALL SELECT trace_id, 'artifact:devtools:script:' || sid, 'text', 'text/javascript', octet_length(encode(text)), sha256(text) FROM sc WHERE text IS NOT NULL
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'artifact:code:source:0:0', 'text', 'text/plain', octet_length(encode(text)), sha256(text) FROM documents
  UNION ALL SELECT trace_id, "artifactId", "decodedKind", "mediaType", "sizeBytes", hash FROM bd
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'artifact:code:sourcemap:0', 'json', 'application/source-map+json', NULL, NULL FROM documents)"""


@query("j01_trace_artifacts", with_events(ARTIFACTS + " SELECT * FROM a"))
def trace_artifacts(spark, sf_dir):
    """Sizes and hashes but for source maps, whose text depends on how a writer escapes characters."""
    rows = trace_artifact_rows(spark, sf_dir)
    plain = F.col("mediaType") != "application/source-map+json"
    return rows.select(
        "trace_id",
        "id",
        "kind",
        "mediaType",
        F.when(plain, F.col("sizeBytes")).alias("sizeBytes"),
        F.when(plain, F.col("hash")).alias("hash"),
    )


@query(
    "j01_source_map_contents",
    """SELECT CAST(doc_id AS VARCHAR) AS trace_id, './src/' || lang || '/' || doc_id AS source, sha256(text) AS hash FROM documents""",
)
def source_map_contents(spark, sf_dir):
    """What the source-map artifacts hold, read back from their bytes."""
    maps = art.source_map_artifacts(dims.source_maps(_document_maps(spark, sf_dir)))
    held = F.from_json(F.decode("content", "UTF-8"), "sourceMap struct<sources: array<string>, sourcesContent: array<string>>")["sourceMap"]
    text = F.get(held["sourcesContent"], F.lit(0))
    return maps.select("trace_id", F.get(held["sources"], F.lit(0)).alias("source"), F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"))


@query(
    "j02_script_texts",
    with_events("""
SELECT trace_id, 's' || k AS "scriptId", arg_min('text é' || uid, idx) FILTER (k > 80) AS text FROM e WHERE et = 'error' GROUP BY 1, 2 HAVING text IS NOT NULL"""),
)
def script_texts(spark, sf_dir):
    from quarrylens.queries.dim_queries import media_trace

    return dims.script_texts(media_trace(spark, sf_dir))


@query(
    "j03_raw_artifacts",
    "WITH " + BLOBS[2:] + """
SELECT trace_id, 'artifact:raw:embedded:' || i AS id, "decodedKind" AS kind, "mediaType", "sizeBytes", filename AS "filenameHint", hash, encoding FROM b
UNION ALL SELECT trace_id, 'artifact:raw:document', 'json', 'application/json', NULL, 'd.json', NULL, NULL FROM d""",
)
def raw_artifacts(spark, sf_dir):
    docs = blob_documents(spark, sf_dir)
    rows = art.raw_artifacts(docs, rawjson.embedded_blobs(docs))
    is_doc = F.col("id") == "artifact:raw:document"
    return rows.select(
        "trace_id",
        "id",
        "kind",
        "mediaType",
        F.when(~is_doc, F.col("sizeBytes")).alias("sizeBytes"),
        "filenameHint",
        F.when(~is_doc, F.col("hash")).alias("hash"),
        F.col("metadata")["encoding"].alias("encoding"),
    )


@query(
    "j04_artifact_views",
    with_events(BODIES + """
SELECT trace_id, "artifactId" AS id, hash, CASE WHEN "decodedKind" = 'json' THEN substr("requestId", 5) END AS answer FROM bd"""),
)
def artifact_views(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    rows = art.artifact_views(
        bodies.select("trace_id", F.col("artifactId").alias("id"), F.col("decodedKind").alias("kind"), F.col("bytes").alias("content"))
    )
    return rows.select(
        "trace_id",
        "id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"),
        F.try_variant_get("json", "$.answer", "string").alias("answer"),
    )


@query(
    "a12_export_manifest",
    with_events(BODIES + """
SELECT trace_id, 'network-bodies/' || "requestId" || '-' || "requestId" || '-00.' || CASE "mediaType" WHEN 'application/json' THEN 'json' ELSE 'txt' END AS "relativePath",
  "artifactId", "mediaType", "sizeBytes", url FROM bd"""),
)
def export_manifest(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    artifacts = bodies.withColumn("id", F.col("artifactId"))
    items = art.manifest_items(art.body_files(bodies), artifacts.select("trace_id", "id", "mediaType", "sizeBytes"))
    return items.withColumn("url", F.col("metadata")["url"]).drop("metadata")


@query(
    "a12_manifest_metadata",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN '[truncated: ' || length(text) || ' chars]' ELSE text END AS text FROM documents""",
)
def manifest_metadata(spark, sf_dir):
    short = art.shorten(F.create_map(F.lit("text"), F.col("text")))
    return spread_table(spark, sf_dir, "documents").select("doc_id", short["text"].alias("text"))


@query(
    "a13_artifact_names",
    """WITH s AS (SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS s FROM pages)
SELECT page_id, CASE WHEN ends_with(s, '.html') THEN s ELSE s || '.html' END AS name FROM s""",
)
def artifact_names(spark, sf_dir):
    name = paths.artifact_filename(F.col("url"), F.col("page_id").cast("string"), F.lit("text/html; charset=x"))
    return read_table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(
    "a14_screenshot_files",
    with_events("""
, sh AS (SELECT trace_id, ts, row_number() OVER (PARTITION BY trace_id ORDER BY ts, idx) - 1 AS n FROM e WHERE et = 'view')
SELECT trace_id, 'screenshots/screenshot-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END || '.jpg' AS "relativePath",
  'artifact:devtools:screenshot:' || n AS "artifactId", CAST(ts AS VARCHAR) AS ts FROM sh"""),
)
def screenshot_files(spark, sf_dir):
    from quarrylens.queries.dim_queries import media_trace

    items = art.screenshot_files(dims.screenshots(media_trace(spark, sf_dir)))
    return items.withColumn("ts", F.col("metadata")["tsUs"]).drop("metadata")


@query(
    "a15_script_files",
    with_events(ARTIFACTS + """
SELECT trace_id, 'scripts/' || sid || '-' || CASE WHEN url IS NULL THEN 'script-' || sid || '.js' ELSE regexp_extract(url, '[^/]*$') END AS "relativePath",
  'artifact:devtools:script:' || sid AS "artifactId" FROM sc WHERE text IS NOT NULL"""),
)
def script_files(spark, sf_dir):
    from quarrylens.queries.dim_queries import media_trace

    no_maps = _empty(spark, "trace_id string, url string, mapIndex bigint")
    return art.script_files(dims.scripts(media_trace(spark, sf_dir), no_maps)).drop("metadata")


@query(
    "a16_source_map_files",
    """SELECT CAST(doc_id AS VARCHAR) AS trace_id, 'source-maps/sourcemap:0.json' AS "relativePath", 'artifact:code:sourcemap:0' AS "artifactId",
  'https://m/' || source AS url FROM documents""",
)
def source_map_files(spark, sf_dir):
    items = art.source_map_files(dims.source_maps(_document_maps(spark, sf_dir)))
    return items.withColumn("url", F.col("metadata")["url"]).drop("metadata")


@query(
    "a17_source_files",
    """SELECT CAST(doc_id AS VARCHAR) AS trace_id, 'sources/src/' || lang || '/' || doc_id AS "relativePath", 'artifact:code:source:0:0' AS "artifactId" FROM documents""",
)
def source_files(spark, sf_dir):
    return art.source_files(dims.sources(dims.source_maps(_document_maps(spark, sf_dir)))).drop("metadata")


@query(
    "a19_blob_files",
    "WITH " + BLOBS[2:] + """
SELECT trace_id, 'embedded/' || filename AS "relativePath", 'artifact:raw:embedded:' || i AS "artifactId", confidence FROM b""",
)
def blob_files(spark, sf_dir):
    items = art.blob_files(rawjson.embedded_blobs(blob_documents(spark, sf_dir)))
    return items.withColumn("confidence", F.col("metadata")["confidence"]).drop("metadata")


# Scalars --------------------------------------------------------------------------------
@query(
    "k01_package_names",
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', CASE page_id % 3 WHEN 0 THEN 'a/node_modules/' WHEN 1 THEN 'b/node_modules//@s' ELSE '' END) AS path FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN split_part(substr(path, 17), '/', 1) WHEN 1 THEN '@s/' || split_part(substr(path, 20), '/', 1) END AS package FROM p""",
)
def package_names(spark, sf_dir):
    head = F.when(F.col("page_id") % 3 == 0, "a/node_modules/").when(
        F.col("page_id") % 3 == 1, "b/node_modules//@s"
    ).otherwise("")
    path = F.concat(head, F.regexp_replace("url", "^https?://[^/]*", ""))
    return read_table(spark, sf_dir, "pages").select("page_id", paths.package_name(path).alias("package"))


@query(
    "k02_path_parts",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS u FROM pages)
SELECT page_id, regexp_extract(u, '^(.*[^/])/+[^/]*$', 1) AS directory, regexp_extract(u, '[^/]*$') AS basename,
  len(list_filter(string_split(u, '/'), lambda x: x <> '')) AS depth, CASE WHEN ends_with(u, '.html') THEN '.html' ELSE '' END AS extension FROM p""",
)
def path_parts(spark, sf_dir):
    url = F.regexp_replace("url", "[?#].*$", "")
    return read_table(spark, sf_dir, "pages").select(
        "page_id",
        paths.dirname(url).alias("directory"),
        paths.basename(url).alias("basename"),
        paths.path_depth(url).cast("bigint").alias("depth"),
        paths.extension(url).alias("extension"),
    )


@query(
    "k03_file_kinds",
    """WITH f AS (SELECT p_partkey, p_partkey % 6 AS m, p_name FROM part)
SELECT p_partkey, m >= 2 AS asset, CASE m WHEN 0 THEN 'js' WHEN 1 THEN 'js' WHEN 2 THEN 'css' WHEN 3 THEN 'json' ELSE 'other' END AS type,
  CASE WHEN m = 4 THEN 'server' ELSE 'client' END AS environment FROM f""",
)
def file_kinds(spark, sf_dir):
    m = F.col("p_partkey") % 6
    ext = F.element_at(F.array(*[F.lit(x) for x in (".js", ".MJS", ".css", ".Json", ".png", "")]), (m + 1).cast("int"))
    folder = F.when(m == 4, "/x/server/").otherwise("/x/client/")
    name = F.concat(folder, F.translate("p_name", " .", "__"), ext)
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        paths.is_asset(name).alias("asset"),
        paths.file_type(name).alias("type"),
        paths.environment(name).alias("environment"),
    )


@query(
    "k05_prefix_cleaning",
    """SELECT p_partkey, p_name AS project, '[project]/' || p_name AS twice, p_name AS output FROM part""",
)
def prefix_cleaning(spark, sf_dir):
    once = F.concat(F.lit("[project]/"), F.col("p_name"))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        paths.strip_project(once).alias("project"),
        paths.collapse_roots(F.concat(F.lit("[project]/[project]/"), once)).alias("twice"),
        paths.strip_output(F.concat(F.lit("[output]/"), F.col("p_name"))).alias("output"),
    )


@query(
    "k06_human_sizes",
    """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * o_custkey AS b FROM orders), u AS (
  SELECT *, CASE WHEN b < 1048576 THEN 1024 WHEN b < 1073741824 THEN 1048576 WHEN b < 1099511627776 THEN 1073741824 ELSE 1099511627776 END AS unit FROM s), c AS (
  SELECT *, (b * 100 + unit // 2) // unit AS cents FROM u)
SELECT o_orderkey, CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ||
  CASE unit WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' WHEN 1073741824 THEN ' GB' ELSE ' TB' END END AS size FROM c""",
)
def human_sizes(spark, sf_dir):
    size = F.floor("o_totalprice").cast("bigint") * F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", paths.human_bytes(size).alias("size"))


@query(
    "k12_decode_and_hash",
    """SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS bytes FROM documents""",
)
def decode_and_hash(spark, sf_dir):
    coded = F.base64(F.encode("text", "UTF-8"))
    data = spread_table(spark, sf_dir, "documents").select("doc_id", blobs.from_base64(coded).alias("data"))
    return data.select("doc_id", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("bigint").alias("bytes"))
