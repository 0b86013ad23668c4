"""Range joins whose tasks hold a bounded number of pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import range_join
from quarrylens.plans import cpu


@pytest.mark.parametrize("many", ["points", "intervals", "none"])
def test_tasks_hold_few_pairs(spark, many):
    """Most rows stand in one cell, so a task by cell would hold nearly all pairs."""
    rng = random.Random(7)
    n_points, n_windows = {"points": (900, 40), "intervals": (40, 900), "none": (60, 60)}[many]

    def at(i):
        return rng.randrange(1000) if i % 10 and many != "none" else rng.randrange(10**8)

    points = [("ab"[i % 2] if i % 50 else None, i, at(i)) for i in range(n_points)]
    points += [("a", -1, None), ("c", -2, 5)]
    windows = [("ab"[i % 2], i, s := at(i), s + rng.choice([-1, 0, 400, 3000, 10**6])) for i in range(n_windows)]
    p = spark.createDataFrame(points, "k string, pid int, ts long")
    w = spark.createDataFrame(windows, "k string, wid int, s long, e long")
    pairs, tasks = range_join.spread_range_join(p, w, ["k"], "ts", "s", "e", task_pairs=300)
    held = pairs.withColumn("task", F.spark_partition_id()).select("pid", "wid", "task").collect()
    expected = sorted(
        (i, j) for k, i, ts in points for m, j, s, e in windows if k == m and ts is not None and s <= ts <= e
    )
    assert sorted((r["pid"], r["wid"]) for r in held) == expected
    per_task = defaultdict(int)
    for r in held:
        per_task[r["task"]] += 1
    if many != "none":
        assert len(expected) > 3000
        # Pieces meet in a task by chance.
        assert max(per_task.values()) < len(expected) / 4
    assert tasks >= len(expected) / 300


def test_window_hotspots_hold_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(range_join, "TASK_PAIRS", 200)
    rng = random.Random(3)
    samples = [
        ("t", str(rng.randrange(5)), f"f{rng.randrange(3)}", None, float(rng.randrange(200)), i / 4, f"s{i % 7}")
        for i in range(400)
    ]
    windows = [("t", j, s := rng.randrange(200), s + rng.randrange(100)) for j in range(60)]
    rows = spark.createDataFrame(
        samples,
        "trace_id string, nodeId string, functionName string, url string, tsUs double, timeDeltaUs double, scriptId string",
    )
    spans = spark.createDataFrame(windows, "trace_id string, id int, lo long, hi long")
    out = cpu.window_cpu_hotspots(rows, spans, "task", F.col("id").cast("string"), "lo", "hi")
    got = {(r["scopeId"], r["nodeId"], r["functionName"]): r for r in out.collect()}
    expected = defaultdict(list)
    for _, j, lo, hi in windows:
        for _, node, fn, _, ts, us, script in samples:
            if lo <= ts <= hi:
                expected[(str(j), node, fn)].append((ts, script, us))
    assert set(got) == set(expected)
    for key, found in expected.items():
        assert got[key]["sampleCount"] == len(found)
        assert got[key]["totalTimeMs"] == sum(x[2] for x in found) / 1000
        assert got[key]["scriptId"] == min(found)[1]
        assert got[key]["taskCpuHotspotId"] == f"task-cpu:{key[0]}:{key[1]}"
    # One trace in one cell still makes as many tasks as its pairs ask for.
    assert out.rdd.getNumPartitions() >= sum(map(len, expected.values())) / 200 / 2


def joined(spark, points, windows, groups=(), task_pairs=500):
    """The pairs, checked against a plain loop; points (k, pid, ts, node), windows (k, wid, s, e)."""
    p = spark.createDataFrame(points, "k string, pid int, ts long, node int")
    w = spark.createDataFrame(windows, "k string, wid int, s long, e long")
    known = range_join.point_stats(p, ["k"], "ts", groups)
    pairs, _ = range_join.spread_range_join(p, w, ["k"], "ts", "s", "e", task_pairs=task_pairs, known_points=known)
    held = pairs.select("pid", "wid", "node", *range_join.CELL).collect()
    expected = sorted((i, j) for k, i, ts, _ in points for m, j, s, e in windows if k == m and s <= ts <= e)
    assert sorted((r["pid"], r["wid"]) for r in held) == expected and expected
    return held


def levels(held):
    return {r["_cell"] % (range_join.MAX_LEVEL + 1) for r in held}


def test_points_are_put_on_few_levels(spark):
    """Intervals of six levels, most of them of one: a point has one row, not one for each level."""
    rng = random.Random(11)
    lengths = [0, 20_000, 10**6, 10**7] + [5 * 10**8] * 56 + [3 * 10**9]
    points = [("ab"[i % 2], i, rng.randrange(10**11), 0) for i in range(700)]
    starts = [ts for _, _, ts, _ in points]
    windows = [("ab"[j % 2], j, s := starts[j % 2 :: 2][j], s + n) for j, n in enumerate(lengths)]
    assert len(levels(joined(spark, points, windows))) == 1


def test_bursts_of_points_keep_their_levels(spark):
    """Evenly spread, the points would be so far apart that short intervals could stand on wide cells."""
    rng = random.Random(12)
    points = [("a", i, 10**9 + rng.randrange(10**6), 0) for i in range(600)] + [("a", -1, 10**13, 0)]
    windows = [("a", j, s := 10**9 + rng.randrange(10**6), s + 400) for j in range(300)] + [("a", 900, 0, 2 * 10**9)]
    assert 0 in levels(joined(spark, points, windows))


def test_pieces_repeat_few_sums(spark):
    """A cell with far too many pairs is cut so that sums of an interval and a node stay together."""
    rng = random.Random(13)
    points = [("a", i, rng.randrange(1000), i % 4) for i in range(1500)]
    windows = [("a", j, s := rng.randrange(300), s + 600) for j in range(200)]
    held = joined(spark, points, windows, ["node"], task_pairs=1000)
    pieces = {r["_piece"] for r in held}
    sums = {(r["wid"], r["node"], r["_cell"], r["_piece"]) for r in held}
    assert len(pieces) > 100 and len(sums) < 40 * 200 * 4
    per_piece = defaultdict(int)
    for r in held:
        per_piece[r["_piece"]] += 1
    assert max(per_piece.values()) < 10_000
