"""Discovery over arbitrary JSON: path catalog, inferred tables, embedded blobs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions import blobs
from quarrylens.functions import payload as p
from quarrylens.operators.large_join import shuffle_join
from quarrylens.operators.lineage import cut
from quarrylens.operators.ordinal import top_per_group

SAMPLE_LIMIT = 5
BATCH_BYTES = 4 << 20
KINDS = ("null", "array", "object", "string", "boolean", "number")
# Words in the paths of times and of payloads.
TIME_LIKE = r"(?i)(time|timestamp|duration|start|end|ts)"
BLOB_PATH = r"(?i)(snapshot|base64|blob|image|payload|body|content)$"
_BLOB_PATH = re.compile(BLOB_PATH)

# Members of an object that may hold a payload, in order.
WRAPPER_KEYS = ("data", "body", "content", "payload", "bytesBase64", "base64", "snapshot")
# Members that describe it.
_WRAPPER_MEMBERS = (*WRAPPER_KEYS, "mimeType", "contentType", "mediaType", "encoding", "filename", "name")


def path_catalog(
    nodes: DataFrame, keys: Sequence[str] = ("trace_id",), order: Sequence[str] = ("pos",)
) -> DataFrame:
    """``raw.schema.paths``: visits, types and first five distinct values per path.

    Values are reduced to one row each before any are ranked.
    """
    keys = list(keys)
    is_leaf = ~F.col("kind").isin("array", "object")
    kinds = nodes.withColumn("kind", json_kind_of(F.col("v"))).select(
        *keys,
        "path",
        "kind",
        F.when(is_leaf, F.to_json("v")).alias("text"),
        F.struct(*order).alias("at"),
    )
    counts = (
        kinds.groupBy(*keys, "path", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys, "path")
        .agg(
            F.sum("n").alias("count"), F.sort_array(F.collect_list("kind")).alias("types")
        )
    )
    values = kinds.filter(is_leaf).groupBy(*keys, "path", "text").agg(F.min("at").alias("at"))
    first = top_per_group(values, [*keys, "path"], [F.col("at")], SAMPLE_LIMIT)
    samples = first.groupBy(*keys, "path").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", "text"))), lambda s: s["text"]
        ).alias("samples")
    )
    empty = F.array().cast("array<string>")
    return counts.join(samples, [*keys, "path"], "left").select(
        *keys, "path", "count", "types", F.coalesce("samples", empty).alias("samples")
    )


def json_kind_of(v: Column) -> Column:
    # The shallow casts avoid describing whole containers.
    return (
        F.when(p.v_array(v, "$").isNotNull(), "array")
        .when(p.v_object(v, "$").isNotNull(), "object")
        .otherwise(p.json_kind(F.when(p.v_array(v, "$").isNull() & p.v_object(v, "$").isNull(), v)))
    )


def path_samples(nodes: DataFrame, path: str, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """First values found at ``path``, in visit order."""
    return nodes.filter(F.col("path") == path).orderBy("trace_id", "pos").limit(limit).select(
        "trace_id", F.to_json("v").alias("value")
    )


def time_like_paths(catalog: DataFrame) -> DataFrame:
    typed = F.array_contains("types", "number") | F.array_contains("types", "string")
    return catalog.filter(F.col("path").rlike(TIME_LIKE) & typed).drop("count", "types", "samples")


def table_name(path: Column) -> Column:
    """Dotted table name of an array path; ``main`` for the root."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\$\.?", ""), r"\[\d*\]", "")
    parts = F.array_join(F.filter(F.split(bare, r"\."), lambda s: s != ""), ".")
    return F.concat(F.lit("raw.inferred."), F.when(parts == "", "main").otherwise(parts))


def item_nodes(items: DataFrame, walk) -> DataFrame:
    """(trace_id, path, pos, v) of the values inside items (trace_id, position, text) of root arrays.

    ``walk(documents, keys, text)`` gives the values of each text on its own; here they get the
    paths and positions that they have in the document.
    """
    own = walk(items, ["trace_id", "position"], "text")
    return own.select(
        "trace_id",
        F.concat(F.lit("$[]"), F.substr("path", F.lit(2))).alias("path"),
        F.concat(F.array(F.col("position").cast("int")), "pos").alias("pos"),
        "v",
    )


def item_counts(items: DataFrame) -> DataFrame:
    """(trace_id, rows, whole): size of each root array held as items, and whether all are objects."""
    is_object = p.v_object(F.parse_json("text"), "$").isNotNull()
    return items.groupBy("trace_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(is_object).alias("whole"))


def _arrays(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("items", p.v_array(F.col("v"), "$")).filter(F.size("items") > 0)


def held_arrays(nodes: DataFrame) -> DataFrame:
    """The non-empty arrays of ``nodes``, written once: tables and their rows both read them."""
    return cut(nodes.filter(F.size(p.v_array(F.col("v"), "$")) > 0))


def inferred_tables(nodes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per non-empty array: name, path, occurrence, row count and its position.

    A name met again in the same document gets ``.2``, ``.3`` ...; the window that
    counts them is bounded by one document and holds no array.  ``counts`` are those of
    :func:`item_counts`, of root arrays that ``nodes`` holds empty.
    """
    arrays = _arrays(nodes).select("trace_id", "path", "pos", F.size("items").cast("bigint").alias("rows"))
    if counts is not None:
        root = F.array().cast(arrays.schema["pos"].dataType)
        arrays = arrays.unionByName(counts.select("trace_id", F.lit("$").alias("path"), root.alias("pos"), "rows"))
    window = Window.partitionBy("trace_id", "base").orderBy("pos")
    numbered = arrays.withColumn("base", table_name(F.col("path"))).withColumn(
        "occurrence", F.row_number().over(window)
    )
    name = F.when(F.col("occurrence") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit("."), F.col("occurrence").cast("string"))
    )
    return numbered.select(
        "trace_id", name.alias("name"), "path", "occurrence", "rows", "pos"
    )


def inferred_rows(
    tables: DataFrame, nodes: DataFrame, items: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Rows of the inferred tables: objects as they are, other values as (index, value).

    Arrays are found by their document and position; ``items`` are root arrays held item by item.
    """
    whole = F.forall("items", lambda x: p.v_object(x, "$").isNotNull())
    named = tables.select("trace_id", "name", "path", "occurrence", "pos")
    rows = (
        _arrays(nodes)
        .select("trace_id", F.col("pos"), "items")
        # Settled once for each array; beside the explode it would be for each item.
        .withColumn("whole", whole)
        .join(named, ["trace_id", "pos"])
        .select("trace_id", "name", "path", "occurrence", "whole", F.posexplode("items"))
    )
    if items is not None:
        roots = named.filter(F.size("pos") == 0).drop("pos").join(counts.select("trace_id", "whole"), "trace_id")
        own = items.select("trace_id", F.col("position").alias("pos"), F.parse_json("text").alias("col"))
        rows = rows.unionByName(roots.join(own, "trace_id").select(*rows.columns))
    wrapped = F.to_variant_object(
        F.create_map(
            F.lit("index"),
            F.col("pos").cast("variant"),
            F.lit("value"),
            F.col("col"),
        )
    )
    return rows.select(
        "trace_id",
        "name",
        "path",
        "occurrence",
        F.col("pos").cast("bigint").alias("row_index"),
        F.when(F.col("whole"), F.col("col")).otherwise(wrapped).alias("row"),
    )


def inferred_columns(rows: DataFrame) -> DataFrame:
    """(trace_id, name, column, type): all keys, typed by the first row."""
    cells = rows.select(
        "trace_id", "name", "row_index", F.explode(p.v_object(F.col("row"), "$"))
    ).select("trace_id", "name", F.col("key").alias("column"), "row_index", "value")
    # A table has one row 0; numbers for the kinds let the aggregate hash instead of sort.
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), json_kind_of(F.col("value")))
    first = F.max(F.when(F.col("row_index") == 0, number))
    kind = F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_first").cast("int"))
    found = cells.groupBy("trace_id", "name", "column").agg(first.alias("_first"))
    return found.withColumn("type", F.coalesce(kind, F.lit("undefined"))).drop("_first")


def _numbers(v: Column) -> Column:
    return F.transform(p.v_array(v, "$"), lambda x: p.v_num(x, "$"))


def _found(loc, mode, text, numbers, hint, confidence, encoding, container) -> Column:
    """A payload still encoded: how to decode it, and what is known about it."""
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(
        loc.alias("loc"),
        F.lit(mode).alias("mode"),
        text.alias("text"),
        numbers.alias("numbers"),
        hint.alias("hint"),
        confidence.alias("confidence"),
        F.lit(encoding).alias("encoding"),
        F.lit(container).alias("containerKind"),
    )


def _no_numbers() -> Column:
    return F.lit(None).cast("array<double>")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _wrapper(v: Column, loc: Column) -> Column:
    """Payload of an object by its first member that qualifies."""
    members = p.v_object(v, "$")

    def text_at(key: str) -> Column:
        return p.v_str(F.try_element_at(members, F.lit(key)), "$")

    media = F.coalesce(text_at("mimeType"), text_at("contentType"), text_at("mediaType"))
    declared = F.coalesce(F.lower(text_at("encoding")) == "base64", F.lit(False))
    texty = F.coalesce(media.startswith("text/") | (media == "application/json"), F.lit(False))

    def candidate(key: Column) -> Column:
        at = F.concat(loc, F.lit("."), key)
        value = F.try_element_at(members, key)
        text, numbers = p.v_str(value, "$"), _numbers(value)
        coded = declared | F.contains(F.lower(key), F.lit("base64")) | blobs.is_base64(text)
        kind = "wrapper-object"
        of_text = (
            F.when(
                text.rlike(blobs.DATA_URL),
                _found(at, "url", text, _no_numbers(), blobs.data_url_media(text), "high", "data-url+base64", kind),
            )
            .when(
                coded,
                _found(
                    at,
                    "base64",
                    text,
                    _no_numbers(),
                    media,
                    F.when(declared, "high").otherwise("medium"),
                    "base64",
                    kind,
                ),
            )
            .when(
                texty & (text != ""),
                _found(at, "utf8", text, _no_numbers(), media, "medium", "utf8", kind),
            )
        )
        return F.when(text.isNotNull(), of_text).when(
            blobs.is_byte_array(numbers),
            _found(at, "bytes", _no_text(), numbers, media, "high", "bytes", kind),
        )

    present = F.filter(
        F.array(*[F.lit(k) for k in WRAPPER_KEYS]), lambda k: F.map_contains_key(members, k)
    )
    fitting = F.filter(F.transform(present, candidate), lambda c: c.isNotNull())
    return F.get(fitting, F.lit(0))


def _leaf(v: Column, loc: Column) -> Column:
    """Payload of a string or an array standing on its own."""
    text, numbers = p.v_str(v, "$"), _numbers(v)
    return F.when(
        text.isNotNull(),
        F.when(
            text.rlike(blobs.DATA_URL),
            _found(loc, "url", text, _no_numbers(), blobs.data_url_media(text), "high", "data-url+base64", "data-url"),
        ).when(
            loc.rlike(BLOB_PATH) & blobs.is_base64(text),
            _found(loc, "base64", text, _no_numbers(), _no_text(), "medium", "base64", "base64-string"),
        ),
    ).when(
        blobs.is_byte_array(numbers),
        _found(loc, "bytes", _no_text(), numbers, _no_text(), "medium", "bytes", "byte-array"),
    )


def _filename_hint(v: Column) -> Column:
    name = p.v_str(v, "$.name")
    return F.coalesce(p.v_str(v, "$.filename"), F.when(F.contains(name, F.lit(".")), name))


def _is_numbers(value) -> bool:
    return isinstance(value, list) and bool(value) and all(type(x) in (int, float) for x in value)


def _payload_nodes(text: str) -> Iterator[tuple[str, list[int], str]]:
    """(loc, pos, JSON) of the values that may hold a payload, members in written order.

    Of an object only the members that say something about a payload are given.
    """
    stack = [("$", (), json.loads(text))]
    while stack:
        loc, pos, value = stack.pop()
        if isinstance(value, str):
            if value.startswith("data:") or (len(value) >= 16 and _BLOB_PATH.search(loc)):
                yield loc, list(pos), json.dumps(value)
        elif _is_numbers(value):
            yield loc, list(pos), json.dumps(value)
        elif isinstance(value, list):
            stack.extend((f"{loc}[{i}]", (*pos, i), x) for i, x in enumerate(value) if isinstance(x, str | list | dict))
        elif isinstance(value, dict):
            own = {k: value[k] for k in _WRAPPER_MEMBERS if k in value and (isinstance(value[k], str) or _is_numbers(value[k]))}
            if not own.keys().isdisjoint(WRAPPER_KEYS):
                yield loc, list(pos), json.dumps(own)
            members = enumerate(value.items())
            stack.extend((f"{loc}.{k}", (*pos, i), x) for i, (k, x) in members if isinstance(x, str | list | dict))


def item_payload_nodes(items: DataFrame) -> DataFrame:
    """(trace_id, loc, pos, v) of the values that may hold a payload, of items of root arrays."""
    own = payload_nodes(items, ["trace_id", "position"], "text")
    return own.select(
        "trace_id",
        F.concat(F.lit("$["), F.col("position").cast("string"), F.lit("]"), F.substr("loc", F.lit(2))).alias("loc"),
        F.concat(F.array(F.col("position").cast("int")), "pos").alias("pos"),
        "v",
    )


def payload_nodes(documents: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, loc, pos, v) of the values that may hold a payload, in one pass over each text.

    ``pos`` lists the positions from the root, so sorting by it gives visit order.
    """
    width = len(keys)

    def batch_of(batch: pa.RecordBatch, owners: list[int], found: list[tuple]) -> pa.RecordBatch:
        at = pa.array(owners, pa.int32())
        columns = [
            *[c.take(at) for c in batch.columns[:width]],
            pa.array([x[0] for x in found], pa.string()),
            pa.array([x[1] for x in found], pa.list_(pa.int32())),
            pa.array([x[2] for x in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "loc", "pos", "json"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One text at a time, and given on after a few megabytes: a batch holds many large texts.
        for batch in batches:
            owners, found, size = [], [], 0
            for row, text in enumerate(batch.column(width)):
                for node in _payload_nodes(text.as_py()) if text.is_valid else ():
                    owners.append(row)
                    found.append(node)
                    size += len(node[2])
                    if size >= BATCH_BYTES:
                        yield batch_of(batch, owners, found)
                        owners, found, size = [], [], 0
            if found:
                yield batch_of(batch, owners, found)

    rows = documents.select(*keys, text)
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(
        [
            *fields,
            T.StructField("loc", T.StringType()),
            T.StructField("pos", T.ArrayType(T.IntegerType())),
            T.StructField("json", T.StringType()),
        ]
    )
    return rows.mapInArrow(run, schema).select(*keys, "loc", "pos", F.parse_json("json").alias("v"))


def blob_candidates(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payloads found in walked JSON, first candidate per location, with ``blobIndex``.

    ``nodes`` are those of :func:`payload_nodes`.  An object comes before its members,
    so a payload named by its wrapper wins over the bare member.  Payloads are passed
    on as found; :func:`decode_blobs` decodes each once.
    """
    keys = list(keys)
    v, loc = F.col("v"), F.col("loc")
    is_object = p.v_object(v, "$").isNotNull()
    # Exploding keeps the search from being repeated for every field read below.
    search = F.array(F.when(is_object, _wrapper(v, loc)).otherwise(_leaf(v, loc)))
    found = cut(
        nodes.select(
            *keys,
            "pos",
            F.when(is_object, _filename_hint(v)).alias("filenameHint"),
            F.explode(search).alias("c"),
        )
        .filter(F.col("c").isNotNull())
        .select(*keys, "pos", "filenameHint", "c.*")
    )
    # Positions are numbered without the payloads, which are joined back by their own place.
    # pos of a wrapper is the object's, which sorts before its members.
    places = found.select(*keys, "loc", "pos").repartition(*[F.col(k) for k in keys])
    per_loc = Window.partitionBy(*keys, "loc").orderBy("pos")
    inside_document = Window.partitionBy(*keys).orderBy("pos")
    numbered = (
        places.withColumn("_rn", F.row_number().over(per_loc))
        .filter("_rn = 1")
        .withColumn("blobIndex", F.row_number().over(inside_document) - 1)
        .drop("_rn")
    )
    return shuffle_join(found, numbered, [*keys, "loc", "pos"]).withColumnRenamed("loc", "path").drop("pos")


def _raw_bytes() -> Column:
    text, mode = F.col("text"), F.col("mode")
    return (
        F.when(mode == "url", blobs.from_base64(blobs.data_url_payload(text)))
        .when(mode == "base64", blobs.from_base64(text))
        .when(mode == "utf8", F.encode(text, "UTF-8"))
        .otherwise(blobs.bytes_of(F.col("numbers")))
    )


def decode_blobs(candidates: DataFrame) -> DataFrame:
    """Unpack gzip, find the media type and the kind of content."""
    raw = candidates.withColumn("raw", _raw_bytes()).drop("text", "numbers", "mode")
    unpacked = raw.withColumn("plain", blobs.gunzip(F.col("raw")))
    data = unpacked.withColumn("bytes", F.coalesce("plain", "raw"))
    hint = F.col("hint")
    media = F.when(hint.isNotNull() & (hint != "") & (hint != "application/octet-stream"), hint)
    return (
        data.withColumn("mediaType", F.coalesce(media, blobs.sniff_media_type(F.col("bytes"))))
        .withColumn(
            "encoding",
            F.when(F.col("plain").isNotNull(), F.concat("encoding", F.lit("+gzip"))).otherwise(
                F.col("encoding")
            ),
        )
        .withColumn("decodedKind", blobs.decoded_kind(F.col("mediaType")))
        .withColumn("sizeBytes", F.octet_length("bytes").cast("bigint"))
        .drop("raw", "hint", "plain")
    )


def embedded_blobs(
    documents: DataFrame, text: str = "text", keys: Sequence[str] = ("trace_id",), items: DataFrame | None = None
) -> DataFrame:
    """``raw.embeddedBlobs``: payloads held in documents, decoded and hashed.

    ``items`` are root arrays held item by item; such an array of numbers is not seen as one payload.
    """
    nodes = payload_nodes(documents, keys, text)
    if items is not None:
        nodes = nodes.unionByName(item_payload_nodes(items))
    index = F.col("blobIndex").cast("string")
    padded = F.when(F.length(index) < 4, F.lpad(index, 4, "0")).otherwise(index)
    return decode_blobs(blob_candidates(nodes, keys)).select(
        *keys,
        F.concat(F.lit("embedded-blob:"), index).alias("embeddedBlobId"),
        F.concat(F.lit("artifact:raw:embedded:"), index).alias("artifactId"),
        "path",
        "mediaType",
        "sizeBytes",
        F.coalesce(
            "filenameHint", F.concat(F.lit("embedded-"), padded, F.lit(".bin"))
        ).alias("filename"),
        "bytes",
        "confidence",
        "encoding",
        "decodedKind",
        "containerKind",
        F.sha2("bytes", 256).alias("hash"),
    )


def request_bodies(events: DataFrame, requests: DataFrame) -> DataFrame:
    """``devtools.dims.requestBodies``: payloads in the data of request events."""
    args = F.col("args")
    holders = (
        events.select(
            "trace_id",
            "rawIndex",
            F.col("ts").alias("tsUs"),
            p.v_text(args, "$.data.requestId").alias("requestId"),
            F.to_json(F.try_variant_get(args, "$.data", "variant")).alias("data"),
        )
        .filter(F.col("requestId").isNotNull())
    )
    keys = ["trace_id", "rawIndex", "tsUs", "requestId"]
    found = decode_blobs(blob_candidates(payload_nodes(holders, keys, "data"), keys))
    both = F.concat_ws(":", "rawIndex", "blobIndex")
    owner = requests.select("trace_id", "requestId", "url", "mimeType")
    index = F.col("blobIndex").cast("string")
    padded = F.when(F.length(index) < 2, F.lpad(index, 2, "0")).otherwise(index)
    media = F.when(
        F.col("mediaType") == "application/octet-stream", F.coalesce("mimeType", "mediaType")
    ).otherwise(F.col("mediaType"))
    return shuffle_join(found, owner, ["trace_id", "requestId"], "left").select(
        "trace_id",
        F.concat(F.lit("request-body:"), both).alias("requestBodyId"),
        F.concat(F.lit("artifact:devtools:request-body:"), both).alias("artifactId"),
        "requestId",
        "url",
        "tsUs",
        media.alias("mediaType"),
        "sizeBytes",
        "path",
        "decodedKind",
        "confidence",
        "bytes",
        F.concat("requestId", F.lit("-"), padded).alias("filename"),
        "rawIndex",
    )


def raw_summary(
    documents: DataFrame, tables: DataFrame, catalog: DataFrame, blob_rows: DataFrame
) -> dict[str, DataFrame]:
    """``raw.summary`` as frames: one totals row per document, tables, time fields."""
    kinds = documents.select("trace_id", json_kind_of(F.col("doc")).alias("topLevelType"))
    paths = catalog.groupBy("trace_id").agg(F.count(F.lit(1)).alias("pathCount"))
    found = blob_rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("embeddedBlobCount"))
    totals = kinds.join(paths, "trace_id", "left").join(found, "trace_id", "left")
    return {
        "totals": totals.fillna(0, ["pathCount", "embeddedBlobCount"]),
        "inferredTables": tables.select("trace_id", "name", "rows", "path"),
        "timeFields": time_like_paths(catalog),
    }


def raw_capabilities(tables: DataFrame, catalog: DataFrame, blob_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of what was discovered, one row per document."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("trace_id").agg(F.count(F.lit(1)).alias(name))

    nested = tables.filter(F.contains(F.col("path"), F.lit(".")))
    parts = [
        counted(tables, "inferredTables"),
        counted(blob_rows, "embeddedBlobs"),
        counted(time_like_paths(catalog), "timeFields"),
        counted(nested, "nestedInferredTables"),
    ]
    out = documents.select("trace_id", F.lit(True).alias("json"))
    for part in parts:
        out = out.join(part, "trace_id", "left")
    return out.fillna(0)
