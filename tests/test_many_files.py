"""Datasets of several files: repeated ingest, equal names, bad files, large first items, many tables."""

import json

import pytest
from pyspark.sql import functions as F
from traces import b64, data, ev, full_trace

from quarrylens.dataset import EVENT_TABLES, ROW_IDS, open_dataset, trace_dataset
from quarrylens.plans import dims, facts, reports
from quarrylens.plans.table_plan import TableQuery
from quarrylens.sources.classify import classify
from quarrylens.sources.trace_events import trace_events, trace_metadata


@pytest.fixture(scope="module")
def two(tmp_path_factory):
    root = tmp_path_factory.mktemp("two")
    other = full_trace()
    other["traceEvents"][3]["args"]["snapshot"] = b64("other-jpeg")
    other["traceEvents"].append(ev("RunTask", "X", 900_000, dur=0.7))
    (root / "a.json").write_text(json.dumps(full_trace()))
    (root / "b.json").write_text(json.dumps(other))
    (root / "cut.json").write_text('{"traceEvents": [{"name": "x", "ph": "X", "pid": 1, "tid": 1, "ts": 1}, {"na')
    return root


def test_opening_again_repeats_nothing(spark, two, tmp_path):
    bronze = str(tmp_path / "bronze")
    paths = [str(two / n) for n in ("a.json", "b.json", "cut.json")]
    first = open_dataset(spark, paths[:1], kind="devtools", bronze=bronze)
    assert first.frame("devtools.facts.events").count() == 28
    every = open_dataset(spark, paths, kind="devtools", bronze=bronze)
    assert every.frame("devtools.facts.events").count() == 57
    (bad,) = every.errors().collect()
    assert bad["path"].endswith("cut.json") and "TraceFormatError" in bad["reason"]
    again = open_dataset(spark, paths[:1], kind="devtools", bronze=bronze)
    assert again.frame("devtools.facts.events").count() == 28
    (manifest,) = again.manifest.collect()
    assert manifest["kind"] == "devtools" and manifest["itemCount"] == 28 and manifest["source"].endswith("a.json")
    assert len(manifest["trace_id"]) == 32 and manifest["trace_id"].startswith(manifest["id"])
    assert manifest["fileSizeBytes"] == (two / "a.json").stat().st_size and manifest["loadedAt"] is not None
    assert again.raw_document().count() == 1
    (two / "a.json").write_text(json.dumps(full_trace()["traceEvents"][:5]))
    try:
        changed = open_dataset(spark, paths[:1], kind="devtools", bronze=bronze)
        assert changed.frame("devtools.facts.events").count() == 5
    finally:
        (two / "a.json").write_text(json.dumps(full_trace()))


def test_two_traces_keep_their_files_and_reports(spark, two, tmp_path):
    paths = [str(two / n) for n in ("a.json", "b.json", "cut.json")]
    ds = open_dataset(spark, paths, kind="devtools")
    assert [r["path"].split("/")[-1] for r in ds.errors().collect()] == ["cut.json"]
    result = ds.export_collection("devtools.screenshots", str(tmp_path / "out"))
    written = sorted(p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg"))
    assert result.file_count == 2 and written == [b"fake-jpeg", b"other-jpeg"]
    traces = {r["source"].split("/")[-1]: r["trace_id"] for r in ds.manifest.collect()}
    shot = "artifact:devtools:screenshot:0"
    with pytest.raises(ValueError):
        ds.materialize_artifact(shot, str(tmp_path / "one"))
    one = ds.materialize_artifact(shot, str(tmp_path / "one"), trace_id=traces["b.json"])
    assert open(one, "rb").read() == b"other-jpeg"
    for trace in traces.values():
        (shown,) = ds.report("devtools.request", requestId="req-1", trace_id=trace)["request"].collect()
        assert shown["trace_id"] == trace
    assert ds.report("devtools.hotspots")["codeHotspots"].select("trace_id").distinct().count() == 2
    short = ds.frame("devtools.dims.tasks").filter("durationMs < 0.001").collect()
    assert [(r["trace_id"], round(r["durationMs"], 6)) for r in short] == [(traces["b.json"], 0.0007)]


def test_provenance_names_rows_and_events_that_exist(spark, two):
    """Also where an event looks like a source and gave no row: a shift without data, a report without content."""
    trace = full_trace()
    trace["traceEvents"] += [ev("LayoutShift", "I", 9_000), ev("PipelineReporter", "b", 9_001), ev("UserTiming::Measure", "X", 9_002, dur=1)]
    document = spark.createDataFrame([("t", json.dumps(trace))], "trace_id string, text string")
    document = document.withColumn("doc", F.parse_json("text"))
    ds = trace_dataset(spark, trace_events(document), trace_metadata(document))
    events = {r["eventId"] for r in ds.frame("devtools.facts.events").select("eventId").collect()}
    for name, column in {**ROW_IDS, **EVENT_TABLES, "devtools.dims.threads": "threadKey"}.items():
        rows = {r["id"] for r in ds.frame(name).select(F.col(column).cast("string").alias("id")).collect()}
        found = ds.provenance(name).collect()
        assert {r["rowId"] for r in found} == rows, name
        assert {r["eventId"] for r in found} <= events, name


def test_equal_paths_in_one_trace(spark, tmp_path):
    trace = full_trace()
    body = "data:application/json;base64," + b64('{"ok":false}')
    trace["traceEvents"].append(ev("ResourceReceivedData", "I", 1050, args=data(requestId="req-1", body=body)))
    (tmp_path / "t.json").write_text(json.dumps(trace))
    ds = open_dataset(spark, str(tmp_path / "t.json"), kind="devtools")
    result = ds.export_collection("devtools.network-bodies", str(tmp_path / "out"))
    files = [json.loads(p.read_text()) for p in (tmp_path / "out/network-bodies").iterdir()]
    assert result.file_count == 2 and sorted(f["ok"] for f in files) == [False, True]


def test_large_first_item(spark, tmp_path):
    chunk = {"filename": "a.js", "label": "a", "parsedSize": 1, "gzipSize": 1, "brotliSize": 1, "mapSize": 0, "isAsset": False, "isEntry": True, "imports": [], "source": []}
    chunk["source"] = [{"label": "x" * 100, "filename": "y" * 100, "parsedSize": 1}] * 40_000
    (tmp_path / "big.json").write_text(json.dumps([chunk]))
    (tmp_path / "small.json").write_text(json.dumps([{**chunk, "source": []}]))
    assert (tmp_path / "big.json").stat().st_size > 9 << 20
    kinds = {r["path"].split("/")[-1]: r["kind"] for r in classify(spark, str(tmp_path)).collect()}
    assert kinds["big.json"] == kinds["small.json"] == "vite-bundle"


def test_any_number_of_arrays(spark, tmp_path):
    orders = [{"id": i, "lines": [{"sku": i}]} for i in range(2_100)]
    (tmp_path / "orders.json").write_text(json.dumps({"orders": orders}))
    ds = open_dataset(spark, str(tmp_path / "orders.json"), kind="raw-json")
    assert ds.table("raw.inferred.orders").count() == 2_100
    assert [r["sku"] for r in ds.table("raw.inferred.orders.lines.2100").rows().collect()] == [2_099]
    assert ds.tables().filter(F.col("name").startswith("raw.inferred.")).count() == 2_101
    assert ds.raw_rows("raw.inferred.orders.lines").count() == 1
    with pytest.raises(KeyError):
        ds.table("raw.inferred.none")


def test_odd_headers(spark):
    headers = [{"name": "a", "value": "b"}, "text", 3, None, {"name": "c"}, {"name": "n", "value": 5}]
    trace = [ev("ResourceReceiveResponse", "I", 1, args=data(requestId="r", headers=headers))]
    document = spark.createDataFrame([("t", json.dumps(trace))], "trace_id string, text string")
    events = trace_events(document.withColumn("doc", F.parse_json("text")))
    (row,) = dims.requests(facts.event_facts(events)).collect()
    assert [tuple(h) for h in row["responseHeaders"]] == [("a", "b"), ("c", ""), ("n", "5")]


def test_count_follows_the_collation(spark):
    table = TableQuery(spark.createDataFrame([("a",), ("B",), ("c",)], "s string"), collation="UNICODE").where("s", "<", "b")
    assert table.count() == table.rows().count() == 1


def test_top_lists_are_per_trace(spark):
    rows = [(t, f"h{i}", float(i), i) for t in ("x", "y") for i in range(60)]
    code = spark.createDataFrame(rows, "trace_id string, hotspotId string, totalDurationMs double, count bigint")
    cpu = spark.createDataFrame([], "trace_id string, selfTimeMs double, sampleCount bigint, functionName string, nodeId string")
    stacks = spark.createDataFrame([], "trace_id string, totalTimeMs double, sampleCount bigint, stackId string")
    top = reports.hotspots_report(code, cpu, stacks)["codeHotspots"]
    assert {r["trace_id"]: r["count"] for r in top.groupBy("trace_id").count().collect()} == {"x": 50, "y": 50}
