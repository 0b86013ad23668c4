"""Catalog of payloads held in a dataset, and the file collections made of them.

Artifacts are (trace_id, id, kind, mediaType, sizeBytes, filenameHint, hash,
metadata, content).  Collections are (trace_id, relativePath, artifactId, metadata).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import blobs, paths
from quarrylens.operators.large_join import shuffle_join

METADATA_LIMIT = 500


def _artifact(kind, media, hint, content: Column, metadata: dict[str, Column], artifact_id: Column) -> list:
    flat = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    media = F.lit(media) if isinstance(media, str) else media
    known = F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())
    return [
        F.col("trace_id"),
        artifact_id.alias("id"),
        kind.alias("kind"),
        media.alias("mediaType"),
        F.octet_length(content).cast("bigint").alias("sizeBytes"),
        hint.alias("filenameHint"),
        F.sha2(content, 256).alias("hash"),
        known.alias("metadata"),
        content.alias("content"),
    ]


def _text(column: str) -> Column:
    return F.encode(F.col(column), "UTF-8")


def _kind_of(decoded: Column) -> Column:
    return F.when(decoded.isin("binary", "json"), decoded).otherwise("text")


def screenshot_artifacts(screenshots: DataFrame) -> DataFrame:
    c = F.col
    return screenshots.select(
        *_artifact(
            "image",
            c("mediaType"),
            c("filename"),
            blobs.from_base64(c("base64")),
            {"screenshotId": c("screenshotId")},
            c("artifactId"),
        )
    )


def script_artifacts(scripts: DataFrame, texts: DataFrame) -> DataFrame:
    """Source texts: the first one of each script."""
    c = F.col
    with_text = shuffle_join(scripts.filter(c("sourceTextArtifactId").isNotNull()), texts, ["trace_id", "scriptId"])
    unnamed = F.concat(F.lit("script-"), c("scriptId"))
    return with_text.select(
        *_artifact(
            "text",
            "text/javascript",
            F.concat("scriptId", F.lit("-"), paths.basename(F.coalesce("url", unnamed))),
            _text("text"),
            {"scriptId": c("scriptId"), "url": c("url")},
            c("sourceTextArtifactId"),
        )
    )


def source_map_artifacts(source_maps: DataFrame) -> DataFrame:
    c = F.col
    return source_maps.select(
        *_artifact(
            "json",
            "application/source-map+json",
            F.concat("sourceMapId", F.lit(".json")),
            _text("content"),
            {"url": c("url"), "sourceMapUrl": c("sourceMapUrl")},
            c("artifactId"),
        )
    )


def source_artifacts(sources: DataFrame) -> DataFrame:
    c = F.col
    return sources.filter(c("artifactId").isNotNull()).select(
        *_artifact(
            "text",
            "text/plain",
            c("sourcePath"),
            _text("content"),
            {"sourcePath": c("sourcePath")},
            c("artifactId"),
        )
    )


def body_artifacts(bodies: DataFrame) -> DataFrame:
    c = F.col
    return bodies.select(
        *_artifact(
            _kind_of(c("decodedKind")),
            c("mediaType"),
            c("filename"),
            c("bytes"),
            {n: c(n) for n in ("requestId", "url", "path", "confidence")},
            c("artifactId"),
        )
    )


def all_artifacts(*parts: DataFrame) -> DataFrame:
    """Artifacts of every kind as one list."""
    return reduce(DataFrame.unionByName, parts)


def raw_artifacts(documents: DataFrame, blob_rows: DataFrame) -> DataFrame:
    """The document itself and every payload embedded in it."""
    c = F.col
    whole = documents.select(
        *_artifact(
            "json",
            "application/json",
            paths.basename(c("path")),
            _text("text"),
            {"path": F.lit(None)},
            F.lit("artifact:raw:document"),
        )
    )
    names = ("path", "confidence", "encoding", "decodedKind", "containerKind")
    found = blob_rows.select(
        *_artifact(
            _kind_of(c("decodedKind")),
            c("mediaType"),
            c("filename"),
            c("bytes"),
            {n: c(n) for n in names},
            c("artifactId"),
        )
    )
    return whole.unionByName(found)


def artifact_views(artifacts: DataFrame) -> DataFrame:
    """Artifacts with their content as text and, where it parses, as JSON."""
    text = F.when(F.col("kind").isin("text", "json"), F.decode("content", "UTF-8"))
    return artifacts.withColumn("text", text).withColumn(
        "json", F.when(F.col("kind") == "json", F.try_parse_json("text"))
    )


def _items(df: DataFrame, path: Column, artifact_id: str, metadata: dict[str, str]) -> DataFrame:
    flat = [x for name, col in metadata.items() for x in (F.lit(name), F.col(col).cast("string"))]
    return df.filter(F.col(artifact_id).isNotNull()).select(
        "trace_id",
        path.alias("relativePath"),
        F.col(artifact_id).alias("artifactId"),
        F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def screenshot_files(screenshots: DataFrame) -> DataFrame:
    path = F.concat(F.lit("screenshots/"), F.col("filename"))
    return _items(screenshots, path, "artifactId", _same("screenshotId", "tsUs"))


def script_files(scripts: DataFrame) -> DataFrame:
    unnamed = F.concat(F.lit("script-"), F.col("scriptId"), F.lit(".js"))
    name = paths.basename(F.coalesce("url", unnamed))
    path = F.concat(F.lit("scripts/"), F.col("scriptId"), F.lit("-"), name)
    return _items(scripts, path, "sourceTextArtifactId", _same("scriptId", "url"))


def source_map_files(source_maps: DataFrame) -> DataFrame:
    path = F.concat(F.lit("source-maps/"), F.col("sourceMapId"), F.lit(".json"))
    return _items(source_maps, path, "artifactId", _same("url"))


def source_files(sources: DataFrame) -> DataFrame:
    path = F.concat(F.lit("sources/"), F.regexp_replace("sourcePath", r"^[./]+", ""))
    return _items(sources, path, "artifactId", _same("sourceMapId"))


def body_files(bodies: DataFrame) -> DataFrame:
    media = F.col("mediaType")
    ext = F.when(F.contains(media, F.lit("json")), "json").when(
        media.startswith("text/"), "txt"
    ).otherwise("bin")
    path = F.concat(
        F.lit("network-bodies/"),
        paths.slug(F.col("requestId")),
        F.lit("-"),
        paths.slug(F.col("filename")),
        F.lit("."),
        ext,
    )
    return _items(bodies, path, "artifactId", _same("requestId", "url", "mediaType"))


def document_files(documents: DataFrame) -> DataFrame:
    rows = documents.withColumn("artifactId", F.lit("artifact:raw:document"))
    return _items(rows, paths.basename(F.col("path")), "artifactId", {"path": "path"}).withColumn(
        "metadata", F.lit(None).cast("map<string,string>")
    )


def blob_files(blob_rows: DataFrame) -> DataFrame:
    path = F.concat(F.lit("embedded/"), F.col("filename"))
    names = _same("path", "mediaType", "confidence", "encoding", "decodedKind")
    return _items(blob_rows, path, "artifactId", names)


def shorten(metadata: Column) -> Column:
    """Metadata with long strings replaced by a note of their length."""
    return F.transform_values(
        metadata,
        lambda k, v: F.when(
            F.length(v) > METADATA_LIMIT,
            F.concat(F.lit("[truncated: "), F.length(v).cast("string"), F.lit(" chars]")),
        ).otherwise(v),
    )


def manifest_items(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Collection items whose artifact exists, as the manifest lists them."""
    known = artifacts.select("trace_id", F.col("id").alias("artifactId"), "mediaType", "sizeBytes")
    return shuffle_join(items, known, ["trace_id", "artifactId"]).select(
        "trace_id",
        "relativePath",
        "artifactId",
        shorten(F.col("metadata")).alias("metadata"),
        "mediaType",
        "sizeBytes",
    )
