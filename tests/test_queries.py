"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from quarrylens.queries import registry  # noqa: E402
from tools_check import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

# One query per operator family; tools_check.py runs all of them.
CHOSEN = [
    "b03_where_not_equal",
    "b22_plan_merge",
    "c09_object_lifecycles",
    "c11_posting_blocks",
    "d05_workers",
    "d07_requests",
    "d10_screenshots",
    "d11_interactions",
    "d14_soft_navigations",
    "e03_interaction_renders",
    "e05_code_hotspots",
    "e07_cpu_samples",
    "e08_cpu_nodes",
    "e09_tree_closure",
    "e11_cpu_timeline",
    "e18_layout_shift_clusters",
    "g01_path_catalog",
    "g12_gunzip",
    "g13_embedded_blobs",
    "h04_packages",
    "i02_sources",
    "j01_trace_artifacts",
]


def test_every_query_has_sql():
    """Of this library's own operators; the corpus operators are checked in their own tests."""
    own = {name for name, fn in registry.QUERIES.items() if fn.__module__.startswith("quarrylens.queries.")}
    assert own and own <= set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    problem = compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0
