"""JSON documents too large for one value: file -> one row per array item -> Parquet.

A document that is an array becomes a row per item; what is not an array is one row.  Plain
files are read by as many tasks as they have ranges, compressed ones by one task in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.json_ranges import SPLIT_BYTES
from quarrylens.sources.trace_stream import (
    ERROR_INDEX,
    METADATA_INDEX,
    JsonReader,
    TraceFormatError,
    failed_files,
    ingest_rows,
    stream_texts,
)

EMPTY_ARRAY = "[]"


def document_texts(stream) -> Iterator[tuple[int, str]]:
    """(index, text) of the items of an array, then (-1, the document without them)."""
    reader = JsonReader(stream)
    if reader.peek() != "[":
        yield METADATA_INDEX, reader.value_and_text()[1]
        return
    reader.take("[")
    index = 0
    while reader.peek() != "]":
        if reader.peek() == "":
            raise TraceFormatError("unterminated array")
        if reader.peek() == ",":
            reader.at += 1
            continue
        yield index, reader.value_and_text()[1]
        index += 1
    yield METADATA_INDEX, EMPTY_ARRAY


def stream_documents(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(trace_id, rawIndex, event_json) of listed files: items from 0 on, -1 the rest, -2 an error."""
    rows = stream_texts(files, document_texts, None, split_bytes)
    broken = (F.col("rawIndex") >= METADATA_INDEX) & F.try_parse_json("event_json").isNull()
    return rows.select(
        "trace_id",
        F.when(broken, F.lit(ERROR_INDEX)).otherwise(F.col("rawIndex")).cast("bigint").alias("rawIndex"),
        F.when(broken, F.lit("not a JSON document")).otherwise(F.col("event_json")).alias("event_json"),
    )


def ingest_documents(
    spark: SparkSession, paths: str | Sequence[str], out: str, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the documents of ``paths`` below ``out`` once; return (documents, items, errors).

    Documents are (trace_id, text, doc), an array without its items; items are (trace_id,
    position, text); errors are (trace_id, reason) of files that give neither.
    """
    rows = ingest_rows(spark, paths, out, lambda files: stream_documents(files, split_bytes), ("rawIndex",))
    failed = failed_files(rows.withColumnRenamed("event_json", "metadata"))
    whole = rows.join(failed.select("trace_id"), "trace_id", "left_anti")
    documents = whole.filter(F.col("rawIndex") == METADATA_INDEX).select(
        "trace_id", F.col("event_json").alias("text"), F.try_parse_json("event_json").alias("doc")
    )
    items = whole.filter(F.col("rawIndex") >= 0).select("trace_id", F.col("rawIndex").alias("position"), F.col("event_json").alias("text"))
    return documents, items, failed
