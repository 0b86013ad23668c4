"""Joins of two sides that grow with the input broadcast neither, whatever their estimated sizes."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from quarrylens.operators import large_join  # noqa: E402
from quarrylens.operators.range_join import range_join  # noqa: E402
from quarrylens.plans import dims  # noqa: E402
from quarrylens.queries.dim_queries import media_trace  # noqa: E402
from tools_check import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Broadcast")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    ["d09_request_bodies", "e03_interaction_renders", "e14_interaction_cpu_hotspots", "a12_export_manifest", "j04_artifact_views"],
)
def test_query_broadcasts_no_growing_side(spark, monkeypatch, name):
    monkeypatch.setattr(large_join, "FEW_ROWS", 0)
    query = entry.queries()[name]
    assert broadcasts(query(spark, SMALL)) == 0
    assert compare(spark, connect(SMALL), SMALL, query, entry.oracle_sql()[name]) is None


def test_range_join_broadcasts_neither_side(spark):
    points = spark.range(3000).select(F.lit("t").alias("k"), (F.col("id") * 7).alias("ts"))

    def joined(count):
        windows = spark.range(count).select(F.lit("t").alias("k"), (F.col("id") * 4).alias("lo"), (F.col("id") * 4 + 9).alias("hi"))
        return range_join(points, windows, ["k"], "ts", "lo", "hi")

    few, many = joined(large_join.FEW_ROWS), joined(large_join.FEW_ROWS + 1)
    assert broadcasts(few) == 0 and broadcasts(many) == 0
    expected = sum(1 for t in range(0, 21000, 7) for i in range(max(0, (t - 9 + 3) // 4), t // 4 + 1) if i <= large_join.FEW_ROWS)
    assert many.count() == expected


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_screenshots_meet_their_numbers_by_shuffle(spark):
    plan = dims.screenshots(media_trace(spark, SMALL))._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "rawIndex" in line]
