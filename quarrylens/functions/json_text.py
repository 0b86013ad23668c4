"""JSON text as it was written, where VARIANT would change it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
ENTRIES = "trace_id string, mapIndex bigint, content string"


def _entries(text: str | None) -> list[str]:
    found = json.loads(text) if text else {}
    entries = found.get("sourceMaps") if isinstance(found, dict) else None
    if not isinstance(entries, list):
        return []
    return [json.dumps(e, ensure_ascii=False, separators=(",", ":")) for e in entries]


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["trace_id", "mapIndex", "content"]
    rows: list[tuple[str, int, str]] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    for batch in batches:
        for trace_id, text in zip(batch["trace_id"], batch["metadata"], strict=True):
            for index, content in enumerate(_entries(text.as_py())):
                rows.append((trace_id.as_py(), index, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield batch_of()
                    rows, size = [], 0
    if rows:
        yield batch_of()


def source_map_entries(metadata: DataFrame) -> DataFrame:
    """(trace_id, mapIndex, content): compact text of each entry of ``sourceMaps``, where that is a list.

    VARIANT sorts members and the built-in text readers escape some characters, which
    would change the hash of the artifact made from the text.
    """
    return metadata.select("trace_id", "metadata").mapInArrow(_entry_rows, ENTRIES)
