"""Binary module-graph files: a JSON header and compressed-row edge sections.

Layout: big-endian u32 header length, the header, then sections the header points
at.  A section is u32 node count, u32 end offsets, u32 targets.

A file is not read whole: one small read gives its header, and each section is cut into ranges
of nodes, whose offsets and targets are fetched by position in tasks of their own.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.operators.lineage import cut
from quarrylens.sources.documents import clean_path
from quarrylens.sources.json_ranges import Bytes, open_bytes
from quarrylens.sources.listing import list_tree

ANALYZE_SECTIONS = ("output_file_chunk_parts", "source_chunk_parts", "source_children")
MODULE_SECTIONS = (
    "module_dependents",
    "async_module_dependents",
    "module_dependencies",
    "async_module_dependencies",
)
ANALYZE_ARRAYS = ("sources", "chunk_parts", "output_files", "source_roots")
EDGE_BATCH = 1 << 18
BATCH_BYTES = 4 << 20
RANGE_NODES = 1 << 18
TASK_RANGES = 1 << 14
DECODED = "path string, section string, node bigint, pos bigint, target bigint, header string"


class GraphFormatError(ValueError):
    """The file is not a module-graph file."""


def header_of(content: bytes) -> tuple[dict, memoryview]:
    if len(content) < 4:
        raise GraphFormatError("missing header length")
    (size,) = struct.unpack_from(">I", content)
    if len(content) < 4 + size:
        raise GraphFormatError("truncated header")
    return json.loads(bytes(content[4 : 4 + size])), memoryview(content)[4 + size :]


def section_edges(body: memoryview, ref: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, position, target) arrays of one section."""
    start, length = int(ref["offset"]), int(ref["length"])
    if start < 0 or length < 4 or start + length > len(body):
        raise GraphFormatError("edge reference outside the file")
    if length % 4:
        raise GraphFormatError("edge section is not made of 32-bit words")
    words = np.frombuffer(body[start : start + length], dtype=">u4").astype(np.int64)
    count = int(words[0])
    if 1 + count > len(words):
        raise GraphFormatError("edge section shorter than its offsets")
    ends, targets = words[1 : 1 + count], words[1 + count :]
    begins = np.concatenate(([0], ends[:-1])) if count else ends
    sizes = np.maximum(np.minimum(ends, len(targets)) - np.minimum(begins, len(targets)), 0)
    node = np.repeat(np.arange(count), sizes)
    pos = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return node, pos, targets[np.repeat(begins, sizes) + pos]


class _Rows:
    """Rows of many small parts, given on as batches of many rows each."""

    def __init__(self):
        self._parts: list[tuple] = []
        self._count = self._chars = 0

    def add(self, path: str, section: str, node, pos, target, header: str | None = None) -> Iterator[pa.RecordBatch]:
        """Take a part; a batch once there is enough for one."""
        self._parts.append((path, section, node, pos, target, header))
        self._count += len(node)
        self._chars += len(header or "")
        if self._count >= EDGE_BATCH or self._chars >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        parts, self._parts, self._count, self._chars = self._parts, [], 0, 0
        owner = np.repeat(np.arange(len(parts)), [len(x[2]) for x in parts])
        if not len(owner):
            return
        empty = np.array([x[5] is not None for x in parts])[owner]
        texts = [pa.array([x[i] for x in parts], pa.string()).take(pa.array(owner)) for i in (0, 1, 5)]
        numbers = [pa.array(np.concatenate([x[i] for x in parts]).astype(np.int64), mask=empty) for i in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([*texts[:2], *numbers, texts[2]], names=["path", "section", "node", "pos", "target", "header"])


_NONE = np.zeros(1, dtype=np.int64)  # of a header row, whose numbers are null


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all files, small files together in one batch."""
    rows = _Rows()
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            header, body = header_of(content.as_py())
            yield from rows.add(path, "header", _NONE, _NONE, _NONE, json.dumps(header, ensure_ascii=False))
            for name in (*ANALYZE_SECTIONS, *MODULE_SECTIONS):
                if not isinstance(header.get(name), dict):
                    continue
                edges = section_edges(body, header[name])
                for at in range(0, len(edges[0]), EDGE_BATCH):
                    yield from rows.add(path, name, *[column[at : at + EDGE_BATCH] for column in edges])
    yield from rows.rest()


def _words(data: Bytes, offset: int, first: int, stop: int) -> np.ndarray:
    """32-bit words ``first`` up to ``stop`` counted from ``offset``."""
    return np.frombuffer(data.at(offset + 4 * first, 4 * (stop - first)), dtype=">u4").astype(np.int64)


def header_text(data: Bytes) -> str:
    """The header's JSON text; its length is checked before it is read."""
    if data.length < 4:
        raise GraphFormatError("missing header length")
    (size,) = struct.unpack(">I", data.at(0, 4))
    if 4 + size > data.length:
        raise GraphFormatError("truncated header")
    return data.at(4, size).decode("utf-8")


def section_range(data: Bytes, offset: int, words: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, position, target) arrays of the nodes from ``low`` up to ``high``, in bounded parts.

    The section has ``words`` words from ``offset`` on.
    """
    count = int(_words(data, offset, 0, 1)[0])
    length = words - 1 - count
    ends = _words(data, offset, 1 + low, 1 + high)
    begins = np.concatenate((_words(data, offset, low, 1 + low) if low else [0], ends[:-1]))
    sizes = np.maximum(np.minimum(ends, length) - np.minimum(begins, length), 0)
    upto = np.cumsum(sizes)
    for at in range(0, int(upto[-1]) if len(upto) else 0, EDGE_BATCH):
        edge = np.arange(at, min(at + EDGE_BATCH, int(upto[-1])))
        node = np.searchsorted(upto, edge, side="right")
        pos = edge - (upto[node] - sizes[node])
        place = begins[node] + pos
        # Ends that fall instead of rise make a part reach over more than its own targets.
        breaks = np.flatnonzero(np.diff(place) != 1) + 1
        for own in np.split(np.arange(len(edge)), breaks):
            first = int(place[own[0]])
            targets = _words(data, offset + 4 * (1 + count), first, first + len(own))
            yield low + node[own], pos[own], targets


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, uri, header, sections: name, offset in the file, words, nodes)."""
    for batch in batches:
        out = []
        for path, uri in zip(batch["path"], batch["uri"], strict=True):
            handle, length = open_bytes(uri)
            with handle:
                data = Bytes(handle, length)
                text = header_text(data)
                header, body = json.loads(text), 4 + len(text.encode())
                sections = []
                for name in (*ANALYZE_SECTIONS, *MODULE_SECTIONS):
                    ref = header.get(name)
                    if not isinstance(ref, dict):
                        continue
                    start, size = int(ref["offset"]), int(ref["length"])
                    if start < 0 or size < 4 or body + start + size > length:
                        raise GraphFormatError("edge reference outside the file")
                    if size % 4:
                        raise GraphFormatError("edge section is not made of 32-bit words")
                    nodes = int(_words(data, body + start, 0, 1)[0])
                    if 4 * (1 + nodes) > size:
                        raise GraphFormatError("edge section shorter than its offsets")
                    sections.append({"section": name, "offset": body + start, "words": size // 4, "nodes": nodes})
            out.append((path, uri, json.dumps(header, ensure_ascii=False), sections))
        yield pd.DataFrame(out, columns=["path", "uri", "header", "sections"])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges; a file stays open while its ranges follow each other."""
    rows = _Rows()
    uri = handle = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["uri"] != uri:
                if handle is not None:
                    handle.close()
                uri = r["uri"]
                handle, length = open_bytes(uri)
            for edges in section_range(Bytes(handle, length), r["offset"], r["words"], r["low"], r["high"]):
                yield from rows.add(r["path"], r["section"], *edges)
    if handle is not None:
        handle.close()
    yield from rows.rest()


def decode_graph_files(spark: SparkSession, roots: str | Sequence[str], range_nodes: int = RANGE_NODES) -> DataFrame:
    """Header and edge rows of every ``*.data`` file under ``roots``, a task per range of nodes."""
    listed = list_tree(spark, [roots] if isinstance(roots, str) else list(roots), ".data")
    files = listed.select(clean_path(F.col("uri")).alias("path"), "uri")
    cores = spark.sparkContext.defaultParallelism
    found = cut(
        files.repartition(4 * cores, "uri").mapInPandas(
            _read_headers,
            "path string, uri string, header string, sections array<struct<section:string,offset:bigint,words:bigint,nodes:bigint>>",
        )
    )
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nodes") - 1, F.lit(range_nodes).cast("bigint")))
    ranges = found.select("path", "uri", F.inline("sections")).filter("nodes > 0").withColumn("low", low)
    ranges = cut(ranges.withColumn("high", F.least(F.col("low") + range_nodes, "nodes")))
    # A range of few nodes costs less than a task of its own.
    count = ranges.count()
    tasks = max(1, min(count, max(4 * cores, count * range_nodes // RANGE_NODES, count // TASK_RANGES)))
    spread = ranges.repartition(tasks, "uri", F.floor(F.col("low") / RANGE_NODES)).sortWithinPartitions("uri", "section", "low")
    edge_rows = spread.mapInArrow(_read_ranges, DECODED)
    none = F.lit(None).cast("bigint")
    header_rows = found.select("path", F.lit("header").alias("section"), none.alias("node"), none.alias("pos"), none.alias("target"), "header")
    return header_rows.unionByName(edge_rows)


def decode_contents(files: DataFrame) -> DataFrame:
    """Header and edge rows of (path, content)."""
    return files.mapInArrow(_decode, DECODED)


def headers(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("section") == "header").select(
        "path", F.parse_json("header").alias("header")
    )


def edges(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("section") != "header").select(
        "path", "section", "node", "pos", "target"
    )


def is_analyze_header(header: Column) -> Column:
    out = F.lit(True)
    for name in ANALYZE_ARRAYS:
        out = out & p.v_array(header, f"$.{name}").isNotNull()
    for name in ANALYZE_SECTIONS:
        out = out & p.v_object(header, f"$.{name}").isNotNull()
    return out


def _items(header_rows: DataFrame, name: str, index: str) -> DataFrame:
    exploded = F.posexplode(p.v_array(F.col("header"), f"$.{name}")).alias(index, "item")
    return header_rows.select("path", exploded).withColumn(index, F.col(index).cast("bigint"))


def source_rows(header_rows: DataFrame) -> DataFrame:
    item = F.col("item")
    return _items(header_rows, "sources", "sourceIndex").select(
        F.col("path").alias("trace_id"),
        "sourceIndex",
        p.v_str(item, "$.path").alias("segment"),
        p.v_long(item, "$.parent_source_index").alias("parentIndex"),
    )


def part_rows(header_rows: DataFrame) -> DataFrame:
    item = F.col("item")
    return _items(header_rows, "chunk_parts", "chunkPartIndex").select(
        F.col("path").alias("trace_id"),
        "chunkPartIndex",
        p.v_long(item, "$.source_index").alias("sourceIndex"),
        p.v_long(item, "$.output_file_index").alias("outputFileIndex"),
        F.coalesce(p.v_long(item, "$.size"), F.lit(0)).alias("size"),
        F.coalesce(p.v_long(item, "$.compressed_size"), F.lit(0)).alias("compressedSize"),
    )


def output_rows(header_rows: DataFrame) -> DataFrame:
    return _items(header_rows, "output_files", "fileIndex").select(
        F.col("path").alias("trace_id"),
        "fileIndex",
        p.v_str(F.col("item"), "$.filename").alias("filename"),
    )


def module_rows(header_rows: DataFrame) -> DataFrame:
    item = F.col("item")
    return _items(header_rows, "modules", "moduleIndex").select(
        F.col("path").alias("trace_id"),
        "moduleIndex",
        p.v_str(item, "$.ident").alias("ident"),
        p.v_str(item, "$.path").alias("path"),
    )


def read_routes(spark: SparkSession, root: str) -> DataFrame:
    """(pos, route, analyzePath) from the folder's ``routes.json``; empty when missing or not a list."""
    empty = spark.createDataFrame([], "pos int, route string, analyzePath string")
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", "routes.json").load(root)
    )
    text = listing.select(F.decode("content", "UTF-8").alias("text"))
    found = text.select(
        F.posexplode(p.v_array(F.try_parse_json("text"), "$")).alias("pos", "item")
    ).select("pos", p.v_str(F.col("item"), "$").alias("route")).filter(F.col("route").isNotNull())
    relative = F.regexp_replace("route", "^/", "")
    base = root.rstrip("/")
    path = F.when(F.col("route") == "/", F.lit(f"{base}/analyze.data")).otherwise(
        F.concat(F.lit(f"{base}/"), F.regexp_replace(relative, "/+$", ""), F.lit("/analyze.data"))
    )
    return empty.unionByName(found.withColumn("analyzePath", path))
