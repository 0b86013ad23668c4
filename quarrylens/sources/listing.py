"""Listing folders of any number of files.

Spark's own file sources list on the driver and keep an entry for each file there.  Here a level of
folders at a time is listed by the executors, and only the folders and files asked for are
looked at on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

BATCH_ENTRIES = 1 << 14
ENTRY = "uri string, folder boolean"


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    marked = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return marked and not name.startswith(("_common_metadata", "_metadata"))


def _opened(uri: str):
    """The file system of a URI, in which nothing is escaped, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _lister(ending: str):
    """Folders, and files of that ending, right below the given folders."""

    def entries(uris: Iterator[str]) -> Iterator[tuple[str, bool]]:
        from pyarrow import fs

        for uri in uris:
            system, path = _opened(uri)
            for found in system.get_file_info(fs.FileSelector(path)):
                folder = found.type == fs.FileType.Directory
                if not _hidden(found.base_name) and (folder or found.base_name.endswith(ending)):
                    yield f"{uri.rstrip('/')}/{found.base_name}", folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bool]] = []
        for row in entries(uri for batch in batches for uri in batch["uri"].to_pylist()):
            rows.append(row)
            if len(rows) == BATCH_ENTRIES:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
    uris, folders = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(folders, pa.bool_())], names=["uri", "folder"])


def _roots(spark: SparkSession, roots: Sequence[str]) -> list[tuple[str, bool]]:
    """(URI, whether it is a folder) of what the paths and patterns name."""
    out = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = list(system.globStatus(system.makeQualified(path)) or [])
        if not found:
            spark.read.format("binaryFile").load(root)  # Spark's own error of a path that is not there
        out += [(x.getPath().toString(), x.isDirectory()) for x in found]
    return out


def list_tree(spark: SparkSession, roots: Sequence[str], ending: str) -> DataFrame:
    """(uri) of the files below ``roots`` whose names have that ending, but for hidden files and folders.

    One folder is listed by one task, so its own entries must fit there; there may be any number of folders.
    """
    given = _roots(spark, roots)
    files = [(uri,) for uri, folder in given if not folder and uri.endswith(ending) and not _hidden(uri.rsplit("/", 1)[-1])]
    found = spark.createDataFrame(files, "uri string")
    folders = spark.createDataFrame([(uri,) for uri, folder in given if folder], "uri string")
    count, most = folders.count(), 4 * spark.sparkContext.defaultParallelism
    while count:
        level = cut(folders.repartition(min(count, most), "uri").mapInArrow(_lister(ending), ENTRY))
        found = found.unionByName(level.filter(~F.col("folder")).select("uri"))
        folders = level.filter("folder").select("uri")
        count = folders.count()
    return found
