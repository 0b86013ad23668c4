"""Module graphs read in ranges, several folders, and files written in two steps."""

import io
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from test_sources import analyze_file, modules_file

from quarrylens.dataset import open_dataset
from quarrylens.sources import module_graph
from quarrylens.sources.classify import classify
from quarrylens.sources.documents import clean_path
from quarrylens.sources.export import STAGING, write_files
from quarrylens.sources.json_ranges import Bytes
from quarrylens.sources.module_graph import decode_contents, decode_graph_files, section_edges, section_range


def random_section(rng):
    nodes = rng.randrange(0, 40)
    ends, at = [], 0
    for _ in range(nodes):
        at += rng.choice([0, 0, 1, 2, 9])
        ends.append(at if rng.random() < 0.95 else max(0, at - 3))
    targets = [rng.randrange(1 << 32) for _ in range(max(0, at - rng.choice([0, 0, 2])))]
    words = [nodes, *ends, *targets]
    return struct.pack(f">{len(words)}I", *words), nodes


def test_ranges_of_a_section_equal_the_whole(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        monkeypatch.setattr(module_graph, "EDGE_BATCH", rng.choice([1, 3, 1000]))
        raw, nodes = random_section(rng)
        data = Bytes(io.BytesIO(b"xx" + raw), len(raw) + 2)
        step = rng.randrange(1, 12)
        found = [
            tuple(map(int, e))
            for low in range(0, nodes, step)
            for part in section_range(data, 2, len(raw) // 4, low, min(low + step, nodes))
            for e in zip(*part, strict=True)
        ]
        whole = section_edges(memoryview(raw), {"offset": 0, "length": len(raw)})
        assert found == [tuple(map(int, e)) for e in zip(*whole, strict=True)]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("graphs")
    for name, scale in (("one", 1), ("two", 3)):
        folder = root / name
        (folder / "about").mkdir(parents=True)
        (folder / "analyze.data").write_bytes(analyze_file(scale))
        (folder / "about" / "analyze.data").write_bytes(analyze_file(2))
        (folder / "modules.data").write_bytes(modules_file())
        (folder / "routes.json").write_text(json.dumps(["/", "/about"]))
    return root


def test_ranged_files_equal_whole_ones(spark, folders):
    whole = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.data").option("recursiveFileLookup", "true").load(str(folders))
    ).select(clean_path(F.col("path")).alias("path"), "content")
    rows = [sorted(map(str, d.collect())) for d in (decode_contents(whole), decode_graph_files(spark, str(folders), 1))]
    assert rows[0] == rows[1] and len(rows[0]) > 30


def test_several_folders_in_one_dataset(spark, folders):
    ds = open_dataset(spark, [str(folders / "one"), str(folders / "two")], kind="nextjs-bundle")
    totals = {r["trace_id"].rsplit("/", 1)[1]: r["totalSize"] for r in ds.frame("nextbundle.dims.sources").filter("sourceIndex = 0").collect()}
    assert totals == {"one": 1111, "two": 1311}
    single = open_dataset(spark, str(folders / "two"), kind="nextjs-bundle")
    for name in ("nextbundle.dims.sources", "nextbundle.views.packageSizes", "nextbundle.views.moduleDependencies", "nextbundle.dims.modules"):
        both = sorted(map(str, ds.frame(name).filter(F.col("trace_id").endswith("/two")).collect()))
        assert both == sorted(map(str, single.frame(name).collect())) and both
    package = ds.frame("nextbundle.views.packageSizes").filter("packageName = 'q'").collect()
    assert sorted((r["totalSize"], r["moduleCount"]) for r in package) == [(100, 1), (300, 1)]
    assert ds.frame("nextbundle.dims.routes").count() == 4
    report = single.report("nextbundle.route", route="/about")
    assert report["analysis"].first()["totalSize"] == 1211 and report["sources"].count() == 4


def test_broken_graph_heads_are_no_graphs(spark, tmp_path):
    for name, raw in (("empty", b""), ("short", b"\x00"), ("long", b"\x7f\xff\xff\xff{}"), ("text", b"\x00\x00\x00\x02\xff\xfe")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "analyze.data").write_bytes(raw)
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "analyze.data").write_bytes(analyze_file())
    found = classify(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["good"]


def listing(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"a/{i}.txt", "text", bytes([i]) * 1000) for i in range(40)]
    good = spark.createDataFrame(rows, "relativePath string, kind string, body binary").repartition(4)
    broken = good.unionByName(spark.createDataFrame([("a/bad.json", "json", b"{")], good.schema))
    with pytest.raises(Exception, match="JSON"):
        write_files(broken, out)
    assert listing(out) == []
    write_files(good, out)
    assert listing(out) == sorted(r[0] for r in rows)
    assert all(open(os.path.join(out, r[0]), "rb").read() == r[2] for r in rows)
    write_files(good.limit(3), out)
    assert len(listing(out)) == 40 and not os.path.exists(os.path.join(out, STAGING))
