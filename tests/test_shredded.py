"""Tables over ingested events read argument columns, with the rows that whole arguments give."""

import glob
import json

import pyarrow.parquet as pq
import pytest
from traces import full_trace, profile_trace

from quarrylens.dataset import open_dataset
from quarrylens.plans.shredded import ARGUMENTS, LOOKED_UP, PREFIX

NARROW = ("devtools.dims.frames", "devtools.dims.workers", "devtools.dims.layers", "devtools.dims.requests", "devtools.dims.scripts")


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shredded")
    (root / "full.json").write_text(json.dumps(full_trace()))
    (root / "profile.json").write_text(json.dumps(profile_trace()))
    paths = str(root / "*.json")
    bronze = str(root / "bronze")
    return open_dataset(spark, paths), open_dataset(spark, paths, kind="devtools", bronze=bronze), bronze


def rows(ds, name):
    frame = ds.frame(name)
    return sorted(str(r) for r in frame.select(*[c for c in sorted(frame.columns) if c not in ("args", "timing")]).collect())


@pytest.mark.parametrize("name", [*NARROW, "devtools.facts.events", "devtools.views.networkWaterfall"])
def test_same_rows(both, name):
    whole, shredded, _ = both
    assert rows(shredded, name) == rows(whole, name) and rows(whole, name)
    assert not [c for c in shredded.frame(name).columns if c.startswith(PREFIX)]


@pytest.mark.parametrize("name", ["devtools.dims.frames", "devtools.dims.layers", "devtools.dims.scripts"])
def test_plans_read_no_arguments(both, name):
    _, shredded, _ = both
    plan = shredded.frame(name)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("]", 1)[0] for x in plan.split("FileScan parquet [")[1:]]
    assert any(PREFIX in x for x in scans) and not any("args#" in x for x in scans)


def test_identifiers_have_statistics_and_bloom_filters(both):
    _, _, bronze = both
    found = set()
    for path in glob.glob(f"{bronze}/events/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        names = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)]
        assert {PREFIX + n for n in ARGUMENTS} <= {n.split(".")[0] for n in names}
        found |= {n for i, n in enumerate(names) if meta.row_group(0).column(i).is_stats_set}
    assert {PREFIX + n for n in LOOKED_UP} <= found
