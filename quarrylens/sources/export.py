"""Writing artifacts as files, from the executors, to any shared file system.

Files are written in two steps.  Each attempt of a task writes into a staging folder of its own
and hands on where its files are; Spark keeps the rows of one attempt of each task.  Then those
files are moved to their places.  A task that fails, or runs twice, leaves no half file and no
file of its own in the result, and what it staged is removed at the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarrylens.functions.paths import artifact_filename
from quarrylens.operators.lineage import cut
from quarrylens.plans.artifacts import shorten


STAGING = "_staging"


@dataclass(frozen=True)
class ExportResult:
    path: str
    manifest_path: str
    collection_id: str
    file_count: int


def _target(out: str, relative: str) -> str:
    """Path below ``out``; parent steps in the stored name are dropped."""
    parts = [p for p in relative.split("/") if p not in ("", ".", "..")]
    return "/".join([out.rstrip("/"), *parts])


def _stager(out: str, job: str):
    """Write the files of a task below a folder of this attempt; give (relativePath, staged)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system = base = None
        attempt, number = uuid.uuid4().hex, 0
        for batch in batches:
            if system is None:
                system, base = _file_system(fs, out)
                system.create_dir(f"{base.rstrip('/')}/{STAGING}/{job}/{attempt}", recursive=True)
            placed = []
            for path, kind, body in zip(batch["relativePath"], batch["kind"], batch["body"], strict=True):
                staged = f"{STAGING}/{job}/{attempt}/{number}"
                number += 1
                with system.open_output_stream(f"{base.rstrip('/')}/{staged}") as sink:
                    sink.write(_laid_out(kind, body))
                placed.append((path, staged))
            yield pd.DataFrame(placed, columns=["relativePath", "staged"])

    return write


def _mover(out: str):
    """Move staged files to their places; one that was moved before is left where it is."""

    def move(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        made: set[str] = set()
        system = base = None
        for row in rows:
            if system is None:
                system, base = _file_system(fs, out)
            staged, target = f"{base.rstrip('/')}/{row['staged']}", _target(base, row["relativePath"])
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            try:
                system.move(staged, target)
            except OSError:
                there = fs.FileType.File
                if system.get_file_info(staged).type == there or system.get_file_info(target).type != there:
                    raise

    return move


def write_files(files: DataFrame, out: str) -> None:
    """Write rows (relativePath, kind, body) as files below ``out``, all or none of a row's bytes."""
    from pyarrow import fs

    job = uuid.uuid4().hex
    system, base = _file_system(fs, out)
    try:
        staged = files.select("relativePath", "kind", "body").mapInPandas(_stager(out, job), "relativePath string, staged string")
        cut(staged).foreachPartition(_mover(out))
    finally:
        folder = f"{base.rstrip('/')}/{STAGING}/{job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
        above = f"{base.rstrip('/')}/{STAGING}"
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def _laid_out(kind: str, body: bytes) -> bytes:
    """Stored bytes; JSON content is indented."""
    body = bytes(body)
    if kind != "json":
        return body
    return json.dumps(json.loads(body), indent=2, ensure_ascii=False).encode()


def _file_system(fs, out: str):
    if "://" in out or out.startswith("file:"):
        return fs.FileSystem.from_uri(out)
    return fs.LocalFileSystem(), out


def _distinct_paths(items: DataFrame) -> DataFrame:
    """``items`` with no relative path twice: equal ones get a part of their artifact's hash.

    Two events of one request, or names cut to the same slug, may ask for one path.
    """
    times = items.groupBy(F.lower("relativePath").alias("_path")).agg(F.count(F.lit(1)).alias("_times"))
    shared = items.join(times.filter(F.col("_times") > 1), F.lower("relativePath") == F.col("_path"), "left")
    parts = F.regexp_extract("relativePath", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("relativePath", r"(\.[^./]*)?$", 1)
    mark = F.left(F.sha2(F.concat_ws("|", "trace_id", "artifactId"), 256), F.lit(16))
    unique = F.concat(parts[0], F.lit("-"), mark, F.coalesce(parts[1], F.lit("")))
    path = F.when(F.col("_times").isNull(), F.col("relativePath")).otherwise(unique)
    return shared.withColumn("relativePath", path).drop("_path", "_times")


def export_collection(
    collection_id: str, items: DataFrame, artifacts: DataFrame, out: str, per_trace: bool | None = None
) -> ExportResult:
    """Write every item of a collection below ``out`` and list them in a manifest.

    Items without an artifact are skipped.  ``manifest.json`` names the collection;
    its items are JSON lines under ``manifest-items``, so no list of files passes
    through the driver.  ``per_trace`` puts each trace in its own folder, which is done
    whenever there are several; no file overwrites another.
    """
    content = artifacts.select(
        "trace_id", F.col("id").alias("artifactId"), "kind", "mediaType", "sizeBytes", F.col("content").alias("body")
    )
    # Decoding the artifacts is the work, so they are written once and read twice.
    found = cut(items.join(content, ["trace_id", "artifactId"]).dropDuplicates(["trace_id", "artifactId", "relativePath"]))
    if per_trace is None:
        per_trace = found.select("trace_id").distinct().limit(2).count() > 1
    folder = F.concat("trace_id", F.lit("/"), "relativePath") if per_trace else F.col("relativePath")
    placed = _distinct_paths(found.withColumn("relativePath", folder))
    write_files(placed, out)
    listed = placed.select(
        "trace_id", "relativePath", "artifactId", shorten(F.col("metadata")).alias("metadata"), "mediaType", "sizeBytes"
    )
    items_path = f"{out.rstrip('/')}/manifest-items"
    listed.write.mode("overwrite").json(items_path)
    count = listed.sparkSession.read.text(items_path).count()
    manifest_path = f"{out.rstrip('/')}/manifest.json"
    manifest = {
        "type": "collection",
        "collectionId": collection_id,
        "fileCount": count,
        "items": "manifest-items",
    }
    _write_text(out, "manifest.json", json.dumps(manifest, indent=2))
    return ExportResult(out, manifest_path, collection_id, count)


def materialize_artifact(artifacts: DataFrame, artifact_id: str, out: str) -> str:
    """Write one artifact below ``out`` under a safe name and return its path.

    Raises where more than one trace has the id.
    """
    name = artifact_filename(F.col("filenameHint"), F.col("id"), F.col("mediaType"))
    rows = cut(
        artifacts.filter(F.col("id") == artifact_id)
        .select("trace_id", name.alias("relativePath"), "kind", F.col("content").alias("body"))
        .orderBy("trace_id", "relativePath")
        .limit(2)
    )
    found = rows.select("trace_id", "relativePath").collect()
    if not found:
        raise KeyError(f"Artifact not found: {artifact_id}")
    if len({r["trace_id"] for r in found}) > 1:
        raise ValueError(f"Several traces have {artifact_id}, name one by trace_id")
    path = min(r["relativePath"] for r in found)
    write_files(rows.filter(F.col("relativePath") == path).limit(1), out)
    _write_text(
        out,
        "manifest.json",
        json.dumps({"type": "artifact", "artifactId": artifact_id, "path": path}),
    )
    return _target(out, path)


def _write_text(out: str, name: str, text: str) -> None:
    from pyarrow import fs

    system, base = _file_system(fs, out)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base.rstrip('/')}/{name}") as sink:
        sink.write(text.encode())
