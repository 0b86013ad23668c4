"""Ingest of trace files too large for one value: file -> event rows -> Parquet.

A compressed file is read by one task in constant memory, a large plain one by as many tasks as
it has ranges; see :mod:`quarrylens.sources.json_ranges`.  The rows are written once, into a
folder of the file's own key; every later query runs on the Parquet rows with full
parallelism.  A file that was ingested before and has not changed is left as it is.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut
from quarrylens.plans.shredded import bloom_filters, shred
from quarrylens.sources.documents import clean_path, trace_key
from quarrylens.sources.json_ranges import SPLIT_BYTES, read_members
from quarrylens.sources.trace_events import event_columns

EVENTS_KEY = "traceEvents"
METADATA_INDEX = -1
ERROR_INDEX = -2
TASK_BYTES = 64 << 20
LOG = "_ingested"
ROWS = "events"
ROW_SCHEMA = "trace_id string, rawIndex bigint, event_json string"
# Endings of files that one reader must unpack from the start.
PACKED = r"(?i)\.(gz|bz2|zst|lz4|br|snappy|xz)$"
BATCH_EVENTS = 4096
READ_BYTES = 1 << 20
_SPACE = re.compile(r"[\s]*")


class TraceFormatError(ValueError):
    """The document is not a trace: no event array, a cut array or a non-object item."""


class JsonReader:
    """A text window over a byte stream that grows only as far as one value needs."""

    def __init__(self, stream):
        self._stream = stream
        self._pending = b""
        self._decoder = json.JSONDecoder()
        self.text = ""
        self.at = 0
        self.done = False

    def more(self, size: int = READ_BYTES) -> bool:
        raw = self._stream.read(size)
        if not raw:
            self.done = True
            return False
        data = self._pending + raw
        keep = len(data)
        while keep and data[keep - 1] & 0xC0 == 0x80:
            keep -= 1
        if keep and data[keep - 1] >= 0xC0:
            keep -= 1
        else:
            keep = len(data)
        try:
            fresh = data.decode("utf-8")
            self._pending = b""
        except UnicodeDecodeError:
            fresh, self._pending = data[:keep].decode("utf-8", "replace"), data[keep:]
        self.text = self.text[self.at :] + fresh
        self.at = 0
        return True

    def peek(self) -> str:
        """Next character that is not white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise TraceFormatError(f"expected {char!r} in trace document")
        self.at += 1

    def value(self):
        """Decode one JSON value, reading twice as much on each attempt."""
        return self.value_and_text()[0]

    def value_and_text(self):
        """One JSON value and its text as it stands in the document."""
        self.peek()
        size = READ_BYTES
        while True:
            try:
                found, end = self._decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.done:
                    text = self.text[self.at : end]
                    self.at = end
                    return found, text
            except json.JSONDecodeError as error:
                if self.done:
                    raise TraceFormatError("unterminated trace document") from error
            self.more(size)
            size *= 2


def _items(reader: JsonReader) -> Iterator[tuple[dict, str]]:
    reader.take("[")
    while True:
        nxt = reader.peek()
        if nxt == "":
            raise TraceFormatError("unterminated event array")
        if nxt == "]":
            reader.at += 1
            return
        if nxt == ",":
            reader.at += 1
            continue
        item, text = reader.value_and_text()
        if not isinstance(item, dict):
            raise TraceFormatError("event array holds an item that is not an object")
        yield item, text


def iter_trace(stream) -> Iterator[tuple[int, dict]]:
    """Yield (index, event) in order, then (-1, metadata)."""
    for index, found, _ in iter_trace_text(stream):
        yield index, found


def iter_trace_text(stream) -> Iterator[tuple[int, dict, str]]:
    """Yield (index, event, its text) in order, then (-1, metadata, its text)."""
    reader = JsonReader(stream)
    rest: dict = {}
    index = 0
    if reader.peek() == "[":
        for event, text in _items(reader):
            yield index, event, text
            index += 1
        yield METADATA_INDEX, {}, "{}"
        return
    reader.take("{")
    found = False
    while reader.peek() != "}":
        if reader.peek() == "":
            raise TraceFormatError("unterminated trace document")
        if reader.peek() == ",":
            reader.at += 1
            continue
        key = reader.value()
        reader.take(":")
        if key == EVENTS_KEY and reader.peek() == "[":
            found = True
            for event, text in _items(reader):
                yield index, event, text
                index += 1
        else:
            rest[key] = reader.value_and_text()
    if not found:
        raise TraceFormatError(f"missing {EVENTS_KEY} array")
    own = rest.get("metadata", (None, ""))
    if isinstance(own[0], dict):
        yield METADATA_INDEX, *own
        return
    members = ",".join(f"{json.dumps(key, ensure_ascii=False)}:{text}" for key, (_, text) in rest.items())
    yield METADATA_INDEX, {key: value for key, (value, _) in rest.items()}, "{" + members + "}"


Texts = Callable[..., Iterator[tuple[int, str]]]


def trace_texts(stream) -> Iterator[tuple[int, str]]:
    """(index, text) of the events and the metadata."""
    for index, _, text in iter_trace_text(stream):
        yield index, text


def _file_reader(texts: Texts):
    """A function of batches of (trace_id, uri) that gives the files' rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for trace_id, uri in zip(batch["trace_id"], batch["uri"], strict=True):

                def rows(uri=uri) -> Iterator[tuple[int, str]]:
                    system, path = fs.FileSystem.from_uri(uri)
                    with system.open_input_stream(path, compression="detect") as stream:
                        yield from texts(stream)

                yield from _guarded(trace_id, rows)

    return read


def _guarded(trace_id: str, found: Texts) -> Iterator[pd.DataFrame]:
    """Frames of a file's rows; a file that cannot be read to its end gives an error row last."""
    rows: list[tuple[int, str]] = []
    try:
        for row in found():
            rows.append(row)
            if len(rows) >= BATCH_EVENTS:
                yield _frame(trace_id, rows)
                rows = []
    except (TraceFormatError, OSError, RecursionError) as error:
        # The rows so far are left out when the table is read; see split_metadata.
        rows = [(ERROR_INDEX, f"{type(error).__name__}: {error}")]
    if rows:
        yield _frame(trace_id, rows)


def _rest_reader(texts: Texts):
    """A function of batches of (trace_id, skeleton) that gives the rows beside the members."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for trace_id, text in zip(batch["trace_id"], batch["skeleton"], strict=True):
                if text is None:
                    yield _frame(trace_id, [(ERROR_INDEX, "TraceFormatError: not a closed JSON array or object")])
                else:
                    yield from _guarded(trace_id, lambda text=text: texts(io.BytesIO(text.encode())))

    return read


def _frame(trace_id: str, rows: list[tuple[int, str]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["rawIndex", "event_json"])
    out.insert(0, "trace_id", trace_id)
    return out


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(trace_id, path, uri, length, modified) of the files, without reading them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(
            trace_key(clean_path(F.col("path"))).alias("trace_id"),
            clean_path(F.col("path")).alias("path"),
            F.col("path").alias("uri"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def stream_texts(files: DataFrame, texts: Texts, key: str | None, split_bytes: int) -> DataFrame:
    """Rows of listed files: members of the arrays of ``key`` and what ``texts`` says of the rest.

    Files that one reader must unpack, and files of one range, are read by one task each, and
    the files are spread over as many tasks as their sizes ask for.
    """
    divisible = ~F.col("uri").rlike(PACKED) & (F.col("length") > split_bytes)
    whole, large = cut(files.filter(~divisible)), cut(files.filter(divisible))
    total, count = whole.agg(F.sum("length"), F.count(F.lit(1))).first()
    spread = max(files.sparkSession.sparkContext.defaultParallelism * 4, (total or 0) // TASK_BYTES)
    rows = (
        whole.select("trace_id", "uri")
        .repartition(max(1, min(count, spread)))
        .mapInPandas(_file_reader(texts), ROW_SCHEMA)
    )
    if large.isEmpty():
        return rows
    members, rest = read_members(large.select("trace_id", "uri", "length"), key, split_bytes)
    members = members.select("trace_id", F.col("position").alias("rawIndex"), F.col("text").alias("event_json"))
    return rows.unionByName(members).unionByName(rest.mapInPandas(_rest_reader(texts), ROW_SCHEMA))


def stream_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(trace_id, rawIndex, event_json) of listed files.

    The metadata row has rawIndex -1, and the row of a file that cannot be read -2 with the
    reason.
    """
    rows = stream_texts(files, trace_texts, EVENTS_KEY, split_bytes)
    strange = (F.col("rawIndex") >= 0) & ~F.startswith(F.col("event_json"), F.lit("{"))
    reason = F.lit("TraceFormatError: event array holds an item that is not an object")
    return rows.select(
        "trace_id",
        F.when(strange, F.lit(ERROR_INDEX)).otherwise(F.col("rawIndex")).cast("bigint").alias("rawIndex"),
        F.when(strange, reason).otherwise(F.col("event_json")).alias("event_json"),
    )


def stream_trace_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows of the trace files of ``paths``, as :func:`stream_files` gives them."""
    return stream_files(list_files(spark, paths))


def typed_rows(rows: DataFrame) -> DataFrame:
    """Event columns of streamed rows; metadata and error rows keep their text instead."""
    is_event = F.col("rawIndex") >= 0
    parsed = rows.select(
        "trace_id",
        "rawIndex",
        F.when(is_event, F.try_parse_json("event_json")).alias("event"),
        F.when(~is_event, F.col("event_json")).alias("metadata"),
        (is_event & F.try_parse_json("event_json").isNull()).alias("_broken"),
    )
    # Python reads a few spellings, such as NaN, that are no JSON: such an event is an error row.
    broken = F.col("_broken")
    return parsed.select(
        "trace_id",
        F.when(broken, F.lit(ERROR_INDEX)).otherwise(F.col("rawIndex")).cast("bigint").alias("rawIndex"),
        *event_columns(F.col("event")),
        F.when(broken, F.concat(F.lit("event "), F.col("rawIndex").cast("string"), F.lit(" is not JSON")))
        .otherwise(F.col("metadata"))
        .alias("metadata"),
    )


def _log(spark: SparkSession, out: str) -> DataFrame:
    """The last entry of each file in the folder's log, empty before the first ingest."""
    schema = "trace_id string, length bigint, modified timestamp, at timestamp"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/{LOG}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    entries = spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{LOG}")
    last = entries.groupBy("trace_id").agg(F.max_by(F.struct("length", "modified"), "at").alias("last"))
    return last.select("trace_id", "last.*")


def ingest_traces(
    spark: SparkSession, paths: str | Sequence[str], out: str, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Write the events of ``paths`` to Parquet below ``out`` and return those of ``paths``.

    Rows are sorted by event name within each file, so a filter on the name, which nearly every
    table starts with, skips row groups.  The arguments that tables read are columns of their own;
    see :mod:`quarrylens.plans.shredded`.
    """
    return ingest_rows(
        spark, paths, out, lambda files: shred(typed_rows(stream_files(files, split_bytes))), ("name", "rawIndex"), bloom_filters()
    )


def ingest_rows(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    make: Callable[[DataFrame], DataFrame],
    order: Sequence[str],
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Write the rows that ``make`` gives of the files of ``paths`` to Parquet below ``out``; return those of ``paths``.

    Each file has a folder of its own, replaced as a whole when the file has changed, so
    ingesting again neither repeats nor mixes rows.
    """
    base = out.rstrip("/")
    asked = list_files(spark, paths)
    new = asked.join(_log(spark, base), ["trace_id", "length", "modified"], "left_anti")
    new = cut(new)
    typed = make(new)
    if not new.isEmpty():
        (
            typed.sortWithinPartitions("trace_id", *order)
            .write.partitionBy("trace_id")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .options(**(options or {}))
            .parquet(f"{base}/{ROWS}")
        )
        entries = new.select("trace_id", "length", "modified", F.current_timestamp().alias("at"))
        entries.write.mode("append").parquet(f"{base}/{LOG}")
    # The schema is given: a key of digits alone would be read as a number.
    rows = spark.read.schema(typed.schema).parquet(f"{base}/{ROWS}").select(*typed.columns)
    return rows.join(asked.select("trace_id"), "trace_id", "left_semi")


def failed_files(rows: DataFrame) -> DataFrame:
    """(trace_id, reason) of the files that could not be read to their end."""
    return rows.filter(F.col("rawIndex") == ERROR_INDEX).select("trace_id", F.col("metadata").alias("reason")).dropDuplicates(["trace_id"])


def split_metadata(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and (trace_id, metadata) with the metadata as JSON text.

    A file that could not be read to its end gives neither; :func:`failed_files` names it.
    """
    whole = rows.join(failed_files(rows).select("trace_id"), "trace_id", "left_anti")
    events = whole.filter(F.col("rawIndex") >= 0).drop("metadata")
    metadata = whole.filter(F.col("rawIndex") == METADATA_INDEX).select("trace_id", "metadata")
    return events, metadata
