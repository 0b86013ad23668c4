"""Large JSON files read in ranges: the same rows as one reader, wherever the cuts are."""

import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from traces import full_trace

from quarrylens.dataset import open_dataset
from quarrylens.sources import json_ranges
from quarrylens.sources.json_ranges import Bytes, State, array_ends, escaped_at, members, skeleton, summary
from quarrylens.sources.trace_stream import ingest_traces, iter_trace_text, list_files, split_metadata, stream_files

TRACE = {
    "before": [1, [2, 3], {"x": "]"}],
    "traceEvents": [
        {"name": 'quote \\" bracket [{', "v": [1, {"q": "\\\\"}]},
        {"name": "ends in a backslash \\", "args": {"a": [[], {}]}},
        {},
        {"t": "é☃🙂, ]}"},
    ],
    "metadata": {"k": ["traceEvents"], "s": '"traceEvents": ['},
    "after": '{["\\',
}


def read(raw, key, cuts):
    """Members and the rest, by ranges that end at ``cuts``."""
    data = Bytes(io.BytesIO(raw), len(raw))
    edges = [0, *sorted(cuts), len(raw)]
    splits = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
    quotes, depth, states = 0, 0, []
    for a, b in splits:
        count, if_outside, if_inside = summary(data, a, b)
        states.append(State(quotes % 2 == 1, escaped_at(data, a), depth))
        depth += if_inside if quotes % 2 else if_outside
        quotes += count
    marks = [m for (a, b), s in zip(splits, states, strict=True) for m in array_ends(data, a, b, s, key)]
    arrays = [(x[0], y[0]) for x, y in zip(marks, marks[1:], strict=False) if (x[1], y[1]) == (1, -1)]
    found = [m.decode() for (a, b), s in zip(splits, states, strict=True) for m in members(data, a, b, s, arrays)]
    return found, skeleton(data, arrays)


@pytest.mark.parametrize("block", [3, 64])
@pytest.mark.parametrize("indent", [None, 1])
def test_every_cut_gives_the_rows_of_one_reader(monkeypatch, block, indent):
    monkeypatch.setattr(json_ranges, "BLOCK_BYTES", block)
    raw = json.dumps(TRACE, ensure_ascii=False, indent=indent).encode()
    want = [text for index, _, text in iter_trace_text(io.BytesIO(raw)) if index >= 0]
    rng = random.Random(block)
    cuts = [[c] for c in range(len(raw) + 1)] + [rng.sample(range(len(raw)), 7) for _ in range(40)] + [list(range(len(raw)))]
    for cut_at in cuts:
        found, rest = read(raw, "traceEvents", cut_at)
        assert found == want
        assert json.loads(rest) == {**TRACE, "traceEvents": []}


def test_other_documents():
    for root in ([], [[1, [2]], "a, b", None, {"x": [{}]}], [[]], ["]"]):
        raw = json.dumps(root, indent=2).encode()
        for at in range(len(raw)):
            found, rest = read(raw, None, [at, at // 2])
            assert [json.loads(x) for x in found] == root and json.loads(rest) == []
    twice = b'{"traceEvents":[1,,2 , ], "x":{"traceEvents":[7]}, "traceEvents" : [3]}'
    assert read(twice, "traceEvents", [9, 20, 30])[0] == ["1", "2", "3"]
    assert read(b'{"a":[1]}', "traceEvents", [3])[0] == [] and read(b"", None, [])[0] == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranges")
    (root / "plain.json").write_text(json.dumps(TRACE, ensure_ascii=False, indent=1))
    (root / "list.json").write_text(json.dumps(TRACE["traceEvents"] * 30, ensure_ascii=False))
    (root / "cut.json").write_text(json.dumps(TRACE)[:150])
    (root / "odd.json").write_text(json.dumps({"traceEvents": [{"a": 1}, 5]}))
    (root / "none.json").write_text(json.dumps({"events": [{"a": 1}], "text": "x" * 100}))
    (root / "packed.json.gz").write_bytes(gzip.compress(json.dumps(TRACE).encode()))
    return root


def collected(frame):
    return sorted(tuple(r) for r in frame.filter("rawIndex > -2").collect())


def test_traces_in_ranges_equal_whole_ones(spark, folder):
    files = list_files(spark, str(folder))
    whole, parts = stream_files(files, 1 << 30), stream_files(files, 40)
    bad = {r["trace_id"] for r in whole.filter("rawIndex = -2").collect()}
    assert len(bad) == 3 and bad == {r["trace_id"] for r in parts.filter("rawIndex = -2").collect()}
    good = ~F.col("trace_id").isin(list(bad))
    assert collected(parts.filter(good)) == collected(whole.filter(good))
    assert whole.filter(good & (F.col("rawIndex") >= 0)).count() == 4 + 120 + 4


def test_ingest_in_ranges(spark, folder, tmp_path):
    events, metadata = split_metadata(ingest_traces(spark, str(folder), str(tmp_path), split_bytes=64))
    assert events.count() == 128 and metadata.count() == 3
    events, _ = split_metadata(ingest_traces(spark, str(folder), str(tmp_path), split_bytes=64))
    assert events.count() == 128


def test_start_times_and_deltas_keep_their_fractions(spark, tmp_path):
    doc = full_trace()
    events = doc["traceEvents"] if isinstance(doc, dict) else doc
    for e in events:
        if e["name"] == "ProfileChunk":
            e["ts"] += 0.9
            e["args"]["data"]["cpuProfile"]["samples"] = [2] * 10
            e["args"]["data"]["cpuProfile"]["timeDeltas"] = [0.6] * 10
    path = tmp_path / "fractions.json"
    path.write_text(json.dumps(doc))
    ds = open_dataset(spark, str(path))
    (leaf,) = ds.frame("devtools.dims.cpuNodes").filter("nodeId = '2'").collect()
    assert leaf["selfTimeMs"] == pytest.approx(0.006) and leaf["selfSampleCount"] == 10
    first, *_, last = ds.frame("devtools.facts.cpuSamples").orderBy("chunk", "pos").collect()
    assert first["tsUs"] == pytest.approx(2075.9 + 0.6) and last["tsUs"] == pytest.approx(2075.9 + 6)


def rows_of(ds, name):
    frame = ds.frame(name)
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in frame.drop("bytes").collect())


def test_documents_held_item_by_item(spark, tmp_path, monkeypatch):
    """Discovery over items gives the tables of whole documents."""
    item = {"id": 1, "tags": ["a", "b"], "data": "data:text/plain;base64,aGVsbG8=", "deep": {"rows": [{"n": 1}, {"n": 2}], "start": 5}}
    (tmp_path / "list.json").write_text(json.dumps([item, {"id": 2, "tags": []}, {**item, "tags": ["c"]}]))
    (tmp_path / "mixed.json").write_text(json.dumps([1, [2, 3], "x", {"y": [4]}]))
    (tmp_path / "object.json").write_text(json.dumps({"list": [{"z": 1}], "body": "x"}))
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"a": ]')
    paths = str(tmp_path / "*.json")
    plain = open_dataset(spark, paths, kind="raw-json")
    held = open_dataset(spark, paths, kind="raw-json", bronze=str(tmp_path / "bronze"))
    for name in ("raw.schema.paths", "raw.embeddedBlobs"):
        assert rows_of(held, name) == rows_of(plain, name) and rows_of(plain, name)
    long_rows = [sorted((r["name"], r["occurrence"], r["row_index"], str(r["row"])) for r in ds.raw_rows("raw.inferred").collect()) for ds in (held, plain)]
    assert long_rows[0] == long_rows[1] and len(long_rows[0]) > 10
    for ds in (held, plain):
        assert [r["path"].endswith("bad.json") for r in ds.errors().collect()] == [True]
        assert ds.report("raw.summary")["totals"].count() == 3


def test_chunk_lists_held_item_by_item(spark, tmp_path):
    chunk = {
        "filename": "a.js", "label": "a", "parsedSize": 3, "gzipSize": 2, "brotliSize": 1, "mapSize": 0, "isEntry": True, "imports": [],
        "source": [{"filename": "src/x.js", "label": "x", "parsedSize": 3, "gzipSize": 2, "brotliSize": 1, "kind": "stat"}],
    }
    (tmp_path / "stats.json").write_text(json.dumps([chunk, {**chunk, "filename": "b.js"}]))
    path = str(tmp_path / "stats.json")
    plain, held = open_dataset(spark, path, kind="vite-bundle"), open_dataset(spark, path, kind="vite-bundle", bronze=str(tmp_path / "bronze"))
    for name in ("bundle.views.treemap", "bundle.dims.chunks", "bundle.views.duplicateModules"):
        assert rows_of(held, name) == rows_of(plain, name) and rows_of(plain, name)


def test_a_large_array_is_read_in_bounded_memory(spark, tmp_path):
    """64 MB of items over ranges of 1 MB: no task sees more than its own."""
    path = tmp_path / "large.json"
    line = json.dumps({"id": 7, "text": "x" * 1000}) + ","
    with open(path, "w") as out:
        out.write("[")
        for _ in range(64):
            out.write(line * 1000)
        out.write('{"id": 8, "text": ""}]')
    files = list_files(spark, str(path)).select("trace_id", "uri", "length")
    rows, rest = json_ranges.read_members(files, None, 1 << 20)
    per_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    assert per_task[1] == 64_001 and per_task[2] > 30 and per_task[0] < 6000
    ends = rows.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(ends) == (0, 64_000, 64_001) and rest.first()["skeleton"] == "[]"
