"""Batches of large texts are given on in parts, small ranges share tasks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from quarrylens.functions.json_text import _entry_rows
from quarrylens.sources.json_ranges import range_tasks
from quarrylens.sources.module_graph import _decode


def test_source_maps_come_in_bounded_batches():
    text = json.dumps({"sourceMaps": [{"x": "é" * 3_000_000}, {"y": 1}]}, ensure_ascii=False)
    batch = pa.RecordBatch.from_pydict({"trace_id": ["a", "b", "c", "d"], "metadata": [text, None, text, '{"sourceMaps":7}']})
    found = list(_entry_rows([batch]))
    assert [(r["trace_id"], r["mapIndex"]) for b in found for r in b.to_pylist()] == [("a", 0), ("a", 1), ("c", 0), ("c", 1)]
    assert len(found) == 2


def test_many_graph_files_are_one_batch():
    header = json.dumps({"source_children": {"offset": 0, "length": 16}}).encode()
    content = len(header).to_bytes(4, "big") + header + np.array([2, 0, 1, 9], dtype=">u4").tobytes()
    found = list(_decode([pa.RecordBatch.from_pydict({"path": ["p", "q"], "content": [content, content]})]))
    assert len(found) == 1
    rows = [tuple(r.values())[:5] for r in found[0].to_pylist()]
    assert rows == [(p, *x) for p in "pq" for x in (("header", None, None, None), ("source_children", 1, 0, 9))]


def test_small_ranges_share_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert range_tasks(spark, 100_000, 1 << 16) < 200
    assert range_tasks(spark, 100_000, 1 << 16) >= 4 * cores
    assert range_tasks(spark, 3, 1 << 16) == 3
