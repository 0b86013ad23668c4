"""Which kind of source each file is, from its name and its first bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.plans.chunks import is_chunk
from quarrylens.sources.documents import clean_path, dataset_id
from quarrylens.sources.json_ranges import Bytes, open_bytes
from quarrylens.sources.module_graph import header_text, is_analyze_header
from quarrylens.sources.trace_stream import JsonReader, TraceFormatError

HEAD_BYTES = 4096
WIDE_HEAD_BYTES = 8 * 1024 * 1024

# Text near the start that marks a trace object.
TRACE_MARKERS = (
    r'"source"\s*:\s*"DevTools"',
    r'"dataOrigin"\s*:\s*"TraceEvents"',
    r'"enhancedTraceVersion"\s*:',
)
TRACE_EVENTS = r'"traceEvents"\s*:\s*\['

_COLUMNS = ["path", "head", "first_item", "has_events", "header"]
_SCHEMA = "path string, head string, first_item string, has_events boolean, header string"


class _Replay:
    """A stream that first gives back the bytes already read from it."""

    def __init__(self, head: bytes, stream):
        self._head, self._stream = head, stream

    def read(self, size: int) -> bytes:
        if self._head:
            out, self._head = self._head[:size], self._head[size:]
            return out
        return self._stream.read(size)


def _first_object(head: bytes, stream) -> str | None:
    """First item of an array when it is an object, as JSON text, however long it is."""
    reader = JsonReader(_Replay(head, stream))
    try:
        if reader.peek() != "[":
            return None
        reader.take("[")
        while reader.peek() == ",":
            reader.take(",")
        if reader.peek() != "{":
            return None
        return json.dumps(reader.value())
    except (TraceFormatError, RecursionError):
        return None


def _peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for uri, path in zip(batch["uri"], batch["path"], strict=True):
            system, name = fs.FileSystem.from_uri(uri)
            if path.endswith(".data"):
                try:
                    handle, length = open_bytes(uri)
                    with handle:
                        header = header_text(Bytes(handle, length))
                except (OSError, ValueError):
                    header = None
                out.append([path, None, None, False, header])
                continue
            raw, first = b"", None
            try:
                with system.open_input_stream(name, compression="detect") as stream:
                    raw = stream.read(WIDE_HEAD_BYTES)
                    first = _first_object(raw, stream)
            except OSError:
                pass
            text = raw.decode("utf-8", "replace")
            has_events = re.search(TRACE_EVENTS, text) is not None
            out.append([path, text[:HEAD_BYTES], first, has_events, None])
        yield pd.DataFrame(out, columns=_COLUMNS)


def source_kind() -> Column:
    """Kind told by the columns head, first_item, has_events and header.

    The first test that holds wins: trace, chunk list, module graph, other JSON.
    """
    start = F.ltrim(F.regexp_replace("head", r"^[\s\x{FEFF}]+", ""))
    first = F.try_parse_json("first_item")
    marked = p.any_of([F.col("head").rlike(m) for m in TRACE_MARKERS])
    event_like = (
        p.v_str(first, "$.name").isNotNull()
        & p.v_str(first, "$.ph").isNotNull()
        & p.v_num(first, "$.pid").isNotNull()
        & p.v_num(first, "$.ts").isNotNull()
    )
    return (
        F.when(start.startswith("{") & (marked | F.col("has_events")), "devtools")
        .when(start.startswith("[") & event_like, "devtools")
        .when(start.startswith("[") & is_chunk(first), "vite-bundle")
        .when(is_analyze_header(F.try_parse_json("header")), "nextjs-bundle")
        .when(start.rlike(r'^[\[{"\-0-9tfn]'), "raw-json")
    )


def classify(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dataset_id, path, kind, driverId) for every recognised file below ``paths``.

    Only the heads of files are read, and the first item of an array to its end.  A module
    graph is named by its folder.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select(F.col("path").alias("uri"), clean_path(F.col("path")).alias("path"))
    )
    wanted = listing.filter(
        F.col("path").rlike(r"(\.json|\.gz)$") | F.col("path").endswith("/analyze.data")
    )
    heads = wanted.repartition(spark.sparkContext.defaultParallelism * 4, "uri").mapInPandas(
        _peek, _SCHEMA
    )
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return (
        heads.withColumn("kind", source_kind())
        .filter(F.col("kind").isNotNull())
        .withColumn("path", F.when(F.col("kind") == "nextjs-bundle", folder).otherwise(F.col("path")))
        .select(dataset_id(F.col("path")).alias("dataset_id"), "path", "kind", F.col("kind").alias("driverId"))
    )
