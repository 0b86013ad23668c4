"""Small trace documents built by hand for the tests."""

import base64
import json

APP = "http://site.test/app.js"
MAIN = {"pid": 1, "tid": 1}


def b64(text):
    return base64.b64encode(text.encode()).decode()


def ev(name, ph, ts, cat="devtools.timeline", args=None, **more):
    return {"cat": cat, "name": name, "ph": ph, **MAIN, "ts": ts, "args": args or {}, **more}


def data(**fields):
    return {"data": fields}


def begin(component, trace_id, ts, prop):
    detail = {
        "devtools": {"track": "Components", "tooltipText": component, "properties": [[prop, "x"]]}
    }
    return ev(
        component, "b", ts, "blink.user_timing", {"traceId": trace_id, "detail": json.dumps(detail)}
    )


def full_trace():
    """28 events that touch every table."""
    timing = dict(
        interactionId=4758,
        duration=232.042,
        processingStart=1,
        processingEnd=2,
        commitFinishTime=3,
        timeStamp=4,
    )
    body = "data:application/json;base64," + b64('{"ok":true}')
    root = {"id": 1, "callFrame": {"functionName": "(root)", "scriptId": "0", "codeType": "other"}}
    leaf = {
        "id": 2,
        "parent": 1,
        "callFrame": {
            "functionName": "renderApp",
            "scriptId": "10",
            "url": APP,
            "lineNumber": 12,
            "columnNumber": 3,
            "codeType": "JS",
        },
    }
    profile = {"nodes": [root, leaf], "samples": [2, 2, 2], "timeDeltas": [100, 100, 100]}
    call = data(functionName="renderApp", url=APP, scriptId=10, lineNumber=12, columnNumber=3)
    dropped = {
        "state": "STATE_DROPPED",
        "frame_sequence": 7,
        "affects_smoothness": True,
        "has_high_latency": True,
        "submit_to_present_ms": 8.5,
    }
    meta = {"cat": "__metadata", "ph": "M", "pid": 1, "ts": 0}
    soft = "SoftNavigationHeuristics::CreateNewContext"
    soft_mod = "SoftNavigationContext::AddedModifiedNodeInAnimationFrame"
    events = [
        {**meta, "name": "process_name", "tid": 0, "args": {"name": "Renderer"}},
        {**meta, "name": "thread_name", "tid": 1, "args": {"name": "CrRendererMain"}},
        {**meta, "name": "thread_name", "tid": 2, "args": {"name": "DedicatedWorker thread"}},
        ev("Screenshot", "I", 1000, args={"snapshot": b64("fake-jpeg"), "frame_sequence": 7}),
        ev("ScriptCatchup", "X", 1010, dur=5, args=data(scriptId=10, url=APP, sourceText="f('héllo 🌍')")),
        ev("ResourceSendRequest", "I", 1020, args=data(requestId="req-1", url="http://site.test/d.json", requestMethod="GET", frame="frame-1")),
        ev("ResourceReceiveResponse", "I", 1030, args=data(requestId="req-1", statusCode=200, mimeType="application/json", protocol="h2", fromCache=False, headers=[{"name": "content-type", "value": "application/json"}], timing={"receiveHeadersEnd": 5.2})),
        ev("ResourceReceivedData", "I", 1045, args=data(requestId="req-1", body=body)),
        ev("LayerTreeHostImpl::UpdateLayers", "I", 1080, "cc", data(layerId=7)),
        ev("ResourceFinish", "I", 1090, args=data(requestId="req-1")),
        {**ev("WorkerTask", "I", 1400, args=data(workerId=99, url="http://site.test/w.js")), "tid": 2},
        ev("RunTask", "X", 1500, dur=10000),
        ev("FunctionCall", "X", 1510, dur=3000, args=call),
        ev("ProfileChunk", "P", 2075, args=data(cpuProfile=profile)),
        ev("SoftNavigation", "b", 1995, "loading"),
        ev(soft, "n", 1996, "loading", {"context": {"softNavContextId": 12, "domModifications": 0}}),
        ev("EventTiming", "b", 2000, args=data(type="pointerup", **timing)),
        ev("EventTiming", "b", 2000, args=data(type="click", **timing)),
        ev("EventDispatch", "X", 2010, dur=201805, args=data(type="click")),
        begin("ChatBlock", 123, 2050, "context"),
        ev("UserTiming::Measure", "X", 2060, dur=2000, args={"sampleTraceId": 123}),
        begin("VirtualItem", 124, 2070, "children"),
        ev("UserTiming::Measure", "X", 2080, dur=3000, args={"sampleTraceId": 124}),
        ev("LayoutShift", "I", 2090, "loading", data(score=0.12, cumulative_score=0.12, had_recent_input=True, impacted_nodes=[{"node_id": 1}])),
        ev(soft_mod, "n", 2095, "loading", {"context": {"softNavContextId": 12, "domModifications": 4}}),
        ev("PipelineReporter", "b", 2100, "benchmark", {"frame_reporter": dropped}),
        ev("Paint", "X", 2110, dur=500),
        ev("AnimationFrame::Presentation", "n", 2120, args={"id": "frame-1"}),
    ]
    content = 'export const value = "héllo 🌍";'
    source_map = {"version": 3, "file": "app.js", "names": [], "sources": ["src/app.ts"], "sourcesContent": [content], "mappings": ""}
    metadata = {"source": "unit", "sourceMaps": [{"url": APP, "sourceMapUrl": APP + ".map", "sourceMap": source_map}]}
    return {"metadata": metadata, "traceEvents": events}


def profile_trace():
    """Two chunks that declare the same three nodes, deltas beside the profile."""
    nodes = [
        {"id": 1, "callFrame": {"functionName": "(root)"}},
        {"id": 2, "parent": 1, "callFrame": {"functionName": "outer", "url": "a.js"}},
        {"id": 3, "parent": 2, "callFrame": {"functionName": "inner", "url": "a.js"}},
    ]

    def chunk(ts, samples, deltas):
        return ev("ProfileChunk", "P", ts, args=data(cpuProfile={"nodes": nodes, "samples": samples}, timeDeltas=deltas))

    return {
        "traceEvents": [
            chunk(2000, [2, 3, 3, 2, 3], [500, 200, 300, 150, 250]),
            chunk(3400, [3, 2, 3], [100, 400, 200]),
        ]
    }
