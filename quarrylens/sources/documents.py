"""JSON and JSON.gz documents, one row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """File path without a local scheme, as the user would write it."""
    return F.url_decode(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "^file:/+", "/"))


def dataset_id(path: Column) -> Column:
    """First eight hex digits of the SHA-256 of the path, for display."""
    return F.left(F.sha2(path, 256), F.lit(8))


def trace_key(path: Column) -> Column:
    """128 bits of the SHA-256 of the path: the key of a file among any number of files."""
    return F.left(F.sha2(path, 256), F.lit(32))


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(trace_id, path, fileSizeBytes, text, doc): whole documents parsed to VARIANT.

    Gzip is decompressed by file extension.  A document must fit a Spark value;
    larger traces go through :mod:`quarrylens.sources.trace_stream`.  ``doc`` is null for a
    file that is not JSON; see :func:`document_errors`.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.text(paths, wholetext=True).select(
        clean_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("fileSizeBytes"),
        F.col("value").alias("text"),
    )
    return files.select(
        trace_key(F.col("path")).alias("trace_id"),
        "path",
        "fileSizeBytes",
        "text",
        F.try_parse_json("text").alias("doc"),
    )


def document_errors(documents: DataFrame) -> DataFrame:
    """(trace_id, path, reason) of the files that are not JSON."""
    return documents.filter(F.col("doc").isNull()).select(
        "trace_id", "path", F.lit("not a JSON document").alias("reason")
    )
