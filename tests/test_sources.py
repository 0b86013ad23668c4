import gzip
import io
import json
import struct

import numpy as np
import pytest
from traces import full_trace, profile_trace

from quarrylens.dataset import open_dataset
from quarrylens.sources.classify import classify
from quarrylens.sources.module_graph import GraphFormatError, header_of, section_edges
from quarrylens.sources.trace_stream import TraceFormatError, iter_trace


def chunk(name, leaves, **more):
    size = sum(s for _, s in leaves)
    return {
        "filename": name,
        "label": name,
        "parsedSize": size,
        "mapSize": 0,
        "gzipSize": size // 2,
        "brotliSize": size // 3,
        "isEntry": False,
        "imports": [],
        "source": [
            {
                "label": "root",
                "parsedSize": size,
                "groups": [{"label": p.split("/")[-1], "filename": p, "parsedSize": s} for p, s in leaves],
            }
        ],
        **more,
    }


CHUNKS = [
    chunk("a.js", [("src/a.ts", 10), ("node_modules/@s/p/x.js", 30)], isEntry=True, imports=["b.js"]),
    chunk("b.js", [("src/a.ts", 10), ("node_modules/q/y.js", 5)]),
    chunk("c.css", [("src/c.css", 1)], mapSize=3),
]

RAW = {
    "rows": [{"id": 1, "name": "alpha", "ts": 100}, {"id": 2, "name": "beta", "ts": 200}],
    "nested": {"items": [{"id": "n1", "label": "x", "ts": 300}, {"id": "n2", "label": "y", "ts": 400}]},
    "screenshot": "data:image/png;base64,cmF3LWltYWdl",
    "attachment": {
        "encoding": "base64",
        "mimeType": "application/json",
        "filename": "payload.json",
        "body": None,
    },
    "thumbnailBytes": [137, 80, 78, 71, 1, 2, 3, 4, 5, 6, 7, 8],
}


def raw_document():
    import base64

    doc = json.loads(json.dumps(RAW))
    packed = gzip.compress(json.dumps({"nested": True}).encode())
    doc["attachment"]["body"] = base64.b64encode(packed).decode()
    return doc


def section(edges):
    ends = np.cumsum([len(e) for e in edges]) if edges else []
    words = [len(edges), *ends, *[t for e in edges for t in e]]
    return struct.pack(f">{len(words)}I", *words)


def graph_file(header, sections):
    body = b""
    for name, edges in sections.items():
        data = section(edges)
        header = {**header, name: {"offset": len(body), "length": len(data)}}
        body += data
    text = json.dumps(header).encode()
    return struct.pack(">I", len(text)) + text + body


def analyze_file(scale=1):
    header = {
        "sources": [
            {"parent_source_index": None, "path": "[project]/"},
            {"parent_source_index": 0, "path": "[project]/node_modules/q/"},
            {"parent_source_index": 1, "path": "i.js"},
            {"parent_source_index": 0, "path": "app.ts"},
        ],
        "chunk_parts": [
            {"source_index": 2, "output_file_index": 0, "size": 100 * scale, "compressed_size": 40},
            {"source_index": 3, "output_file_index": 0, "size": 10, "compressed_size": 4},
            {"source_index": 3, "output_file_index": 1, "size": 1, "compressed_size": 1},
            {"source_index": 3, "output_file_index": 9, "size": 1000, "compressed_size": 1},
        ],
        "output_files": [{"filename": "[output]/x/server/a.js"}, {"filename": "[output]/b.css"}],
        "source_roots": [0],
    }
    return graph_file(
        header,
        {
            "output_file_chunk_parts": [[0, 1], [2]],
            "source_chunk_parts": [[], [], [0], [1, 2]],
            "source_children": [[1, 3], [2], [], []],
        },
    )


def modules_file():
    header = {
        "modules": [
            {"ident": "0", "path": "[project]/app.ts"},
            {"ident": "1", "path": "[project]/node_modules/q/i.js"},
        ]
    }
    return graph_file(
        header,
        {
            "module_dependents": [[], [0]],
            "async_module_dependents": [[], []],
            "module_dependencies": [[1, 7], []],
            "async_module_dependencies": [[], [0]],
        },
    )


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "trace.json").write_text(json.dumps(full_trace(), indent=1))
    with gzip.open(root / "bare.json.gz", "wt") as out:
        json.dump(profile_trace()["traceEvents"], out)
    (root / "stats.json").write_text(json.dumps(CHUNKS))
    (root / "raw.json").write_text(json.dumps(raw_document()))
    graph = root / "graph"
    (graph / "about").mkdir(parents=True)
    (graph / "analyze.data").write_bytes(analyze_file())
    (graph / "about" / "analyze.data").write_bytes(analyze_file(2))
    (graph / "modules.data").write_bytes(modules_file())
    (graph / "routes.json").write_text(json.dumps(["/", "/about", "/gone", 7]))
    return root


def collected(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def test_classification(spark, files):
    kinds = {r["path"].split("/")[-1]: r["kind"] for r in classify(spark, str(files)).collect()}
    assert kinds["trace.json"] == kinds["bare.json.gz"] == "devtools"
    assert kinds["stats.json"] == "vite-bundle" and kinds["raw.json"] == "raw-json"
    assert kinds["graph"] == "nextjs-bundle"


def test_streamed_ingest_equals_document_read(spark, files, tmp_path):
    path = [str(files / "trace.json"), str(files / "bare.json.gz")]
    streamed = open_dataset(spark, path, kind="devtools", bronze=str(tmp_path / "bronze"))
    whole = open_dataset(spark, path, kind="devtools")
    name = "devtools.facts.events"
    left, right = streamed.frame(name).drop("args"), whole.frame(name).drop("args")
    assert left.count() == 30
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    maps = collected(streamed.frame("code.dims.sourceMaps"), "mapIndex")
    assert maps[0]["url"].endswith("app.js")


class Slow(io.BytesIO):
    """Hands out a few bytes at a time."""

    def read(self, size=-1):
        return super().read(7)


def test_event_stream_in_small_pieces():
    doc = full_trace()
    text = json.dumps(doc, ensure_ascii=False, indent=2).encode()
    rows = list(iter_trace(Slow(text)))
    assert [e for i, e in rows if i >= 0] == doc["traceEvents"]
    assert rows[-1] == (-1, doc["metadata"])


@pytest.mark.parametrize("text", ['{"a": 1}', '{"traceEvents": [{"a": 1}', '{"traceEvents": [1]}', "[{]"])
def test_event_stream_errors(text):
    with pytest.raises(TraceFormatError):
        list(iter_trace(io.BytesIO(text.encode())))


def test_edge_section_errors():
    _, body = header_of(graph_file({}, {"x": [[1], [2, 3], []]}))
    node, pos, target = section_edges(body, {"offset": 0, "length": len(body)})
    assert (list(node), list(pos), list(target)) == ([0, 1, 1], [0, 0, 1], [1, 2, 3])
    with pytest.raises(GraphFormatError):
        section_edges(body, {"offset": 0, "length": len(body) + 4})
    with pytest.raises(GraphFormatError):
        header_of(b"\x00\x00\x00\xff{}")


def test_chunk_list(spark, files):
    ds = open_dataset(spark, str(files / "stats.json"))
    assert ds.kind == "vite-bundle"
    chunks = collected(ds.frame("bundle.dims.chunks"), "chunkIndex")
    assert [c["moduleCount"] for c in chunks] == [2, 2, 1]
    assert [c["isAsset"] for c in chunks] == [False, False, True]
    packages = collected(ds.table("bundle.dims.packages").rows(), "packageName")
    assert [(p["packageName"], p["chunks"]) for p in packages] == [("@s/p", "a.js"), ("q", "b.js")]
    same = collected(ds.frame("bundle.views.duplicateModules"), "path")
    assert same == [
        {"trace_id": chunks[0]["trace_id"], "path": "src/a.ts", "chunkCount": 2, "chunks": "a.js, b.js", "totalParsedSize": 20}
    ]
    tree = collected(ds.frame("bundle.views.treemap"), "chunkIndex", "pos")
    assert [t["label"] for t in tree[:3]] == ["root", "a.ts", "x.js"]
    totals = ds.report("bundle.summary")["totals"].first()
    assert (totals["chunks"], totals["entryChunks"], totals["parsedSize"]) == (3, 1, 56)


def test_module_graph(spark, files):
    ds = open_dataset(spark, str(files / "graph"), kind="nextjs-bundle")
    sources = collected(ds.frame("nextbundle.dims.sources"), "sourceIndex")
    assert [s["path"] for s in sources] == [
        "[project]/",
        "[project]/node_modules/q/",
        "[project]/node_modules/q/i.js",
        "[project]/app.ts",
    ]
    assert [s["totalSize"] for s in sources] == [1111, 100, 100, 1011]
    assert [s["isDirectory"] for s in sources] == [True, True, False, False]
    parts = collected(ds.frame("nextbundle.dims.chunkParts"), "chunkPartIndex")
    assert parts[3]["outputFilename"] == "output:9"
    tree = collected(ds.frame("nextbundle.views.sourceTree"), "sourceIndex")
    assert tree[1]["outputFiles"] == "b.css, x/server/a.js" and tree[1]["environments"] == "client, server"
    edges = collected(ds.frame("nextbundle.views.moduleDependencies"), "kind")
    assert [(e["kind"], e["toModule"]) for e in edges] == [("async", "[project]/app.ts"), ("sync", "[project]/node_modules/q/i.js")]
    routes = collected(ds.frame("nextbundle.views.routeSizes"), "route")
    assert [(r["route"], r["totalSize"]) for r in routes] == [("/", 1111), ("/about", 1211)]
    flags = collected(ds.frame("nextbundle.dims.routes"), "pos")
    assert [r["hasAnalyzeData"] for r in flags] == [True, True, False]
    report = ds.report("nextbundle.route", route="/about")
    assert report["sources"].count() == 4 and report["analysis"].first()["totalSize"] == 1211
    stats = ds.report("nextbundle.summary")["moduleDependencyStats"].first()
    assert stats["mostDependedOnModule"] == "[project]/node_modules/q/i.js"
    caps = ds.capabilities().first()
    assert caps["hasModuleGraph"] and caps["routeCount"] == 3


def test_raw_document(spark, files, tmp_path):
    ds = open_dataset(spark, str(files / "raw.json"))
    assert ds.kind == "raw-json"
    rows = ds.table("raw.inferred.rows").where("id", ">=", 2).select(["name"]).rows().collect()
    assert [r["name"] for r in rows] == ["beta"]
    assert ds.table("raw.inferred.nested.items").count() == 2
    assert [r["value"] for r in ds.schema_samples("$.rows[].name").collect()] == ['"alpha"', '"beta"']
    summary = ds.report("raw.summary")
    total = summary["totals"].first()
    assert (total["topLevelType"], total["embeddedBlobCount"]) == ("object", 3)
    fields = {r["path"] for r in summary["timeFields"].collect()}
    assert {"$.rows[].ts", "$.nested.items[].ts"} <= fields
    blobs = collected(ds.frame("raw.embeddedBlobs"), "embeddedBlobId")
    assert [(b["path"], b["mediaType"], b["encoding"], b["confidence"]) for b in blobs] == [
        ("$.screenshot", "image/png", "data-url+base64", "high"),
        ("$.attachment.body", "application/json", "base64+gzip", "high"),
        ("$.thumbnailBytes", "image/png", "bytes", "medium"),
    ]
    assert blobs[1]["filename"] == "payload.json"
    assert json.loads(bytes(blobs[1]["bytes"])) == {"nested": True}
    result = ds.export_collection("raw.embedded-blobs", str(tmp_path / "out"))
    assert result.file_count == 3
    assert (tmp_path / "out/embedded/embedded-0000.bin").read_bytes() == b"raw-image"
    assert json.loads((tmp_path / "out/embedded/payload.json").read_text()) == {"nested": True}
    assert ds.export_collection("raw.document", str(tmp_path / "doc")).file_count == 1
    assert json.loads((tmp_path / "doc/raw.json").read_text())["rows"][1]["name"] == "beta"


def test_trace_files_and_artifacts(spark, files, tmp_path):
    ds = open_dataset(spark, str(files / "trace.json"))
    listed = {r["id"]: r for r in ds.list_artifacts().collect()}
    assert sorted(listed) == [
        "artifact:code:source:0:0",
        "artifact:code:sourcemap:0",
        "artifact:devtools:request-body:7:0",
        "artifact:devtools:screenshot:0",
        "artifact:devtools:script:10",
    ]
    source_map = full_trace()["metadata"]["sourceMaps"][0]
    whole = json.dumps(source_map, ensure_ascii=False, separators=(",", ":"))
    assert listed["artifact:code:sourcemap:0"]["sizeBytes"] == len(whole.encode())
    body = ds.artifact("artifact:devtools:request-body:7:0").first()
    assert body["text"] == '{"ok":true}' and body["mediaType"] == "application/json"
    assert ds.artifact("artifact:devtools:nothing").count() == 0
    for name, path in {
        "devtools.screenshots": "screenshots/screenshot-0000.jpg",
        "devtools.scripts": "scripts/10-app.js",
        "devtools.network-bodies": "network-bodies/req-1-req-1-00.json",
        "code.source-maps": "source-maps/sourcemap:0.json",
        "code.sources": "sources/src/app.ts",
    }.items():
        out = tmp_path / name
        assert ds.export_collection(name, str(out)).file_count == 1
        assert (out / path).exists()
    one = ds.materialize_artifact("artifact:devtools:screenshot:0", str(tmp_path / "one"))
    assert one.endswith("screenshot-0000.jpg") and open(one, "rb").read() == b"fake-jpeg"
    with pytest.raises(KeyError):
        ds.materialize_artifact("artifact:none", str(tmp_path / "none"))


def test_catalog(spark, files):
    ds = open_dataset(spark, str(files / "trace.json"), kind="devtools")
    assert len(ds.specs) == 38 and len(ds.report_specs) == 7 and len(ds.collection_specs) == 5
    assert ds.namespaces() == ["code", "devtools"]
    columns = {r["name"]: r for r in ds.columns("devtools.facts.events").collect()}
    assert columns["tsUs"]["unit"] == "µs" and columns["categories"]["type"] == "array<string>"
    with pytest.raises(KeyError):
        ds.table("devtools.none")
    with pytest.raises(KeyError):
        ds.raw_rows("none")
    assert ds.raw_rows("devtools.raw.events").count() == 28
