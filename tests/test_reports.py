import json

import pytest
from traces import full_trace

from quarrylens.dataset import open_dataset


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("report")
    (root / "full.json").write_text(json.dumps(full_trace()))
    return open_dataset(spark, str(root / "full.json"), kind="devtools", bronze=str(root / "bronze"))


def test_summary_counts(trace):
    row = trace.report("devtools.summary")["summary"].first().asDict()
    assert row["error"] is None
    assert row["totalEvents"] == row["facts"] == 28
    assert (row["interactions"], row["screenshots"], row["networkBodies"]) == (1, 1, 1)
    assert (row["softNavigations"], row["layoutShiftClusters"], row["cpuSamples"]) == (2, 1, 3)
    assert (row["sourceMaps"], row["sources"], row["workers"]) == (1, 1, 2)
    assert row["threads"] == 3 and row["processes"] == 1
    assert row["durationMs"] == pytest.approx((2010 + 201805 - 1000) / 1000)


def test_summary_survives_a_failing_input(trace):
    from quarrylens.plans import reports

    def tables(name):
        if name == "devtools.dims.requests":
            raise RuntimeError("broken input")
        return trace.frame(name)

    counted = {"networkRequests": "devtools.dims.requests", "layers": "devtools.dims.layers"}
    row = reports.trace_summary(trace.raw_rows("devtools.raw.events"), tables, counted).first()
    assert row["networkRequests"] == 0 and row["layers"] == 1
    assert "broken input" in row["error"]


def test_interaction_report(trace):
    report = trace.report("devtools.interaction")
    assert report["interaction"].first()["interactionId"] == "4758"
    assert [r["componentName"] for r in report["topComponents"].collect()] == ["ChatBlock", "VirtualItem"]
    assert report["droppedFrames"].first()["droppedFrames"] == 1
    assert report["layoutShifts"].count() == 1 and report["softNavigations"].count() == 1
    assert report["cpuHotspots"].first()["functionName"] == "renderApp"
    assert report["requests"].count() == 0 and report["eventDispatches"].count() == 0
    unknown = trace.report("devtools.interaction", id="nope")
    assert unknown["interaction"].count() == 0 and unknown["renders"].count() == 0
    assert unknown["codeHotspots"].count() == 0


def test_other_reports(trace):
    frame = trace.report("devtools.frame", frameSequence="7")
    assert frame["screenshot"].first()["artifactId"] == "artifact:devtools:screenshot:0"
    assert [r["kind"] for r in frame["visualChanges"].collect()][0] == "screenshot"
    assert trace.report("devtools.frame", id="8")["frame"].count() == 0
    request = trace.report("devtools.request", url="http://site.test/d.json")
    assert request["request"].first()["requestId"] == "req-1"
    nav = trace.report("devtools.soft-navigation", id="12")
    assert nav["layoutShifts"].count() == 1 and nav["screenshots"].count() == 0
    assert trace.report("devtools.soft-navigation")["softNavigation"].first()["softNavigationId"] == "soft-nav:14"
    script = trace.report("devtools.script", scriptId="10")
    assert script["sourceMap"].count() == 1 and script["sources"].count() == 1
    assert script["codeHotspots"].count() == 1 and script["cpuHotspots"].count() == 1
    hot = trace.report("devtools.hotspots")
    assert hot["cpuCallTrees"].first()["stackLabel"] == "(root) > renderApp"
    with pytest.raises(KeyError):
        trace.report("devtools.none")


def test_capabilities(trace):
    caps = trace.capabilities().first().asDict()
    assert all(v for k, v in caps.items() if k != "trace_id")
    assert len(caps) == 13
