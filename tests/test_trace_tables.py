import json

import pytest
from pyspark.sql import functions as F
from traces import full_trace, profile_trace

from quarrylens.dataset import open_dataset


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trace") / "full.json"
    path.write_text(json.dumps(full_trace()))
    return open_dataset(spark, str(path))


@pytest.fixture(scope="module")
def profile(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trace") / "profile.json"
    path.write_text(json.dumps(profile_trace()))
    return open_dataset(spark, str(path))


def rows(dataset, name, *order):
    df = dataset.table(name).df
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def test_facts(trace):
    facts = rows(trace, "devtools.facts.events", "rawIndex")
    assert len(facts) == 28
    send = facts[5]
    assert (send["requestId"], send["frameId"], send["url"]) == ("req-1", "frame-1", "http://site.test/d.json")
    assert facts[4]["scriptId"] == "10"
    assert facts[8]["layerId"] == "7" and facts[10]["workerId"] == "99"
    assert facts[3]["frameSeqId"] == "7"
    assert facts[19]["sampleTraceId"] == "123"
    assert facts[12]["endUs"] == 4510


def test_threads_processes_workers(trace):
    threads = rows(trace, "devtools.dims.threads", F.desc("eventCount"))
    assert threads[0]["threadKey"] == "1:1" and threads[0]["threadName"] == "CrRendererMain"
    assert threads[0]["processName"] == "Renderer"
    process = rows(trace, "devtools.dims.processes", "pid")[0]
    assert (process["eventCount"], process["threadCount"]) == (28, 3)
    workers = rows(trace, "devtools.dims.workers", "workerId")
    assert [w["workerId"] for w in workers] == ["99", "thread:1:2"]
    assert workers[0]["urls"] == ["http://site.test/w.js"]


def test_request_lifecycle(trace):
    request = rows(trace, "devtools.dims.requests", "requestId")[0]
    assert request["method"] == "GET" and request["statusCode"] == 200
    assert request["durationMs"] == pytest.approx(0.07)
    assert request["fromCache"] is False
    assert request["responseHeaders"] == [{"name": "content-type", "value": "application/json"}]
    assert json.loads(str(request["timing"])) == {"receiveHeadersEnd": 5.2}
    waterfall = rows(trace, "devtools.views.networkWaterfall", "requestId")[0]
    assert waterfall["startOffsetMs"] == pytest.approx(0.02)
    assert waterfall["requestWaterfallId"] == "request-waterfall:0"


def test_interaction(trace):
    found = rows(trace, "devtools.dims.interactions", "interactionId")
    assert len(found) == 1
    assert found[0]["interactionId"] == "4758" and found[0]["type"] == "click"
    assert found[0]["eventTypes"] == ["pointerup", "click"]
    assert found[0]["endTsUs"] == pytest.approx(2000 + 232042)
    window = rows(trace, "devtools.views.interactionWindows", "interactionId")[0]
    # The explicit soft navigation at 1995 ends before the interaction starts.
    assert (window["renderCount"], window["droppedFrameCount"]) == (2, 1)
    assert (window["layoutShiftCount"], window["softNavigationCount"]) == (1, 1)
    assert (window["requestCount"], window["screenshotCount"]) == (0, 0)


def test_tasks(trace):
    task = rows(trace, "devtools.dims.tasks", "taskId")[0]
    assert task["taskId"] == "task:11" and task["durationMs"] == 10.0
    # Inside 1500..11500: all later events but the long dispatch.
    assert task["childEventCount"] == 15
    assert (task["functionCalls"], task["paints"], task["renderMeasures"]) == (1, 1, 2)
    nav = {n["softNavigationId"]: n for n in rows(trace, "devtools.dims.softNavigations", "startTsUs")}
    assert nav["12"]["taskId"] == "task:11" and nav["12"]["domModifications"] == 4
    assert nav["12"]["eventCount"] == 2
    assert nav["soft-nav:14"]["durationMs"] == 0


def test_frames_and_visual_changes(trace):
    frame = rows(trace, "devtools.views.framePipeline", "rawIndex")[0]
    assert frame["frameSequence"] == "7" and frame["state"] == "STATE_DROPPED"
    assert frame["stageTimingsMs"] == {"submit_to_present_ms": 8.5}
    assert frame["screenshotArtifactId"] == "artifact:devtools:screenshot:0"
    assert frame["hasMainAnimation"] is False and frame["affectsSmoothness"] is True
    changes = rows(trace, "devtools.views.visualChanges", "tsUs", "sourceOrder", "rawIndex")
    assert [c["kind"] for c in changes] == ["screenshot", "layout-shift", "Paint", "AnimationFrame::Presentation"]
    shot = rows(trace, "devtools.dims.screenshots", "index")[0]
    assert shot["sizeBytes"] == 9 and shot["filename"] == "screenshot-0000.jpg"
    shift = rows(trace, "devtools.dims.layoutShifts", "tsUs")[0]
    assert shift["impactedNodeIds"] == ["1"] and shift["hadRecentInput"] is True
    cluster = rows(trace, "devtools.views.layoutShiftClusters", "startTsUs")[0]
    assert cluster["totalScore"] == pytest.approx(0.12) and cluster["shiftCount"] == 1


def test_renders_and_code(trace):
    renders = rows(trace, "devtools.views.renderMeasures", "rawIndex")
    assert [r["componentName"] for r in renders] == ["ChatBlock", "VirtualItem"]
    assert renders[0]["propKeys"] == ["context"] and renders[0]["track"] == "Components"
    assert rows(trace, "devtools.views.interactionRenders", "componentName")[0]["renderCount"] == 1
    hot = rows(trace, "devtools.views.codeHotspots", "hotspotId")
    assert len(hot) == 1 and hot[0]["functionName"] == "renderApp"
    assert hot[0]["totalDurationMs"] == 3.0 and hot[0]["sourceMapId"] == "sourcemap:0"
    script = rows(trace, "devtools.dims.scripts", "scriptId")[0]
    assert script["sourceMapId"] == "sourcemap:0" and script["hasSourceText"]
    assert script["sourceTextBytes"] == len("f('héllo 🌍')".encode("utf-16-be")) // 2
    source = rows(trace, "code.dims.sources", "sourceId")[0]
    assert source["artifactId"] == "artifact:code:source:0:0" and source["sourcePath"] == "src/app.ts"


def test_cpu_profile_on_full_trace(trace):
    samples = rows(trace, "devtools.facts.cpuSamples", "tsUs")
    assert [s["tsUs"] for s in samples] == [2175, 2275, 2375]
    assert samples[0]["stackLabel"] == "(root) > renderApp"
    assert samples[0]["sampleId"] == "cpu-sample:0"
    assert samples[0]["sourceMapId"] == "sourcemap:0"
    hot = rows(trace, "devtools.views.interactionCpuHotspots", "nodeId")
    assert hot[0]["functionName"] == "renderApp" and hot[0]["sampleCount"] == 3
    assert rows(trace, "devtools.views.taskCpuHotspots", "nodeId")[0]["sampleCount"] == 3


def test_redeclared_nodes_count_once(profile):
    nodes = {n["nodeId"]: n for n in rows(profile, "devtools.dims.cpuNodes", "nodeId")}
    assert nodes["3"]["selfSampleCount"] == 5 and nodes["2"]["selfSampleCount"] == 3
    assert nodes["1"]["totalSampleCount"] == 8
    assert nodes["1"]["totalTimeMs"] == pytest.approx(2.1)
    trees = rows(profile, "devtools.views.cpuCallTrees", "stackId")
    assert [t["stackLabel"] for t in trees] == ["(root) > outer", "(root) > outer > inner"]
    buckets = rows(profile, "devtools.views.cpuTimeline", "startTsUs")
    assert buckets[0]["sampleCount"] == 8
    assert buckets[0]["topFunctions"][0] == {"functionName": "inner", "count": 5}
