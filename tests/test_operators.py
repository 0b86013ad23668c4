"""Distributed operators against plain loops on random data."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.closure import CycleError, ancestor_closure, root_paths, subtree_sums
from quarrylens.operators.lineage import ensure_checkpoint_dir
from quarrylens.operators.ordinal import ordinal_by_order, ordinal_by_unique, top_per_group
from quarrylens.operators.range_join import interval_stats, overlap_join, range_join
from quarrylens.operators.sessions import capped_sessions


def intervals(rng, count, start_name, end_name, scale):
    rows = []
    for i in range(count):
        lo = rng.randrange(0, scale)
        length = rng.choice([0, 5, 900, 9_000, 70_000, 900_000])
        rows.append((rng.choice("ab"), i, lo, lo + length))
    return rows, f"k string, {start_name}_id int, {start_name} bigint, {end_name} bigint"


@pytest.mark.parametrize("broadcast", [True, False])
def test_range_join(spark, broadcast):
    rng = random.Random(1)
    points = [(rng.choice("ab"), i, rng.randrange(0, 2_000_000)) for i in range(400)]
    spans, schema = intervals(rng, 60, "s", "e", 2_000_000)
    p = spark.createDataFrame(points, "k string, p int, ts bigint")
    w = spark.createDataFrame(spans, schema)
    stats = interval_stats(w, "s", "e")
    assert stats.rows == 60 and len(stats.levels) > 2
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, before if broadcast else "-1")
    try:
        got = range_join(p, w, ["k"], "ts", "s", "e", stats=stats)
        pairs = sorted((r["p"], r["s_id"]) for r in got.collect())
    finally:
        spark.conf.set(key, before)
    want = sorted(
        (pid, sid) for pk, pid, ts in points for sk, sid, lo, hi in spans if pk == sk and lo <= ts <= hi
    )
    assert pairs == want


def test_overlap_join(spark):
    rng = random.Random(2)
    left, left_schema = intervals(rng, 70, "a", "b", 3_000_000)
    right, right_schema = intervals(rng, 70, "c", "d", 3_000_000)
    got = overlap_join(
        spark.createDataFrame(left, left_schema),
        spark.createDataFrame(right, right_schema),
        ["k"],
        ("a", "b"),
        ("c", "d"),
    )
    pairs = sorted((r["a_id"], r["c_id"]) for r in got.collect())
    want = sorted(
        (i, j) for k, i, a, b in left for m, j, c, d in right if k == m and a <= d and c <= b
    )
    assert pairs == want


@pytest.mark.parametrize("seed,step", [(3, 40), (4, 8), (5, 200)])
def test_capped_sessions(spark, seed, step):
    rng = random.Random(seed)
    gap, span = 100, 500
    rows, want = [], {}
    for key in ("a", "b", "c"):
        times = sorted(rng.choices(range(0, 300 * step // 10), k=300))
        current = None
        for ts in times:
            value = rng.randrange(10)
            rows.append((key, ts, value))
            if current is None or ts - current[1] > gap or ts - current[0] > span:
                current = [ts, ts, 0, 0]
                want.setdefault(key, []).append(current)
            current[1] = ts
            current[2] += value
            current[3] += 1
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = capped_sessions(df, ["k"], "t", gap, span, {"total": F.col("v"), "n": F.lit(1)})
    found = sorted((r["k"], r["start_ts"], r["last_ts"], r["total"], r["n"]) for r in got.collect())
    assert found == sorted((k, *s) for k, sessions in want.items() for s in sessions)


def test_closure_counts_ways(spark):
    # d is under b and c, both under a.
    nodes = spark.createDataFrame([("t", n) for n in "abcd"], "t string, n string")
    edges = spark.createDataFrame(
        [("t", "b", "a"), ("t", "c", "a"), ("t", "d", "b"), ("t", "d", "c"), ("t", "d", "c")],
        "t string, n string, up string",
    )
    once = ancestor_closure(nodes, edges, ["t"], "n", "n", "up")
    ways = {(r["descendant"], r["ancestor"]): r["paths"] for r in once.collect()}
    assert ways[("d", "a")] == 2 and ways[("d", "d")] == 1 and ways[("d", "c")] == 1
    twice = ancestor_closure(nodes, edges, ["t"], "n", "n", "up", repeated_edges=True)
    ways = {(r["descendant"], r["ancestor"]): r["paths"] for r in twice.collect()}
    assert ways[("d", "a")] == 3 and ways[("d", "c")] == 2


def test_closure_of_a_deep_chain(spark):
    depth = 70
    nodes = spark.createDataFrame([(i,) for i in range(depth)], "n int")
    edges = nodes.filter("n > 0").withColumn("up", F.col("n") - 1)
    closure = ancestor_closure(nodes, edges, [], "n", "n", "up")
    assert closure.count() == depth * (depth + 1) // 2


def test_subtree_sums(spark):
    """Against a plain recursion over random graphs, where nodes may have several parents."""
    rng = random.Random(4)
    edges = [(c, rng.randrange(c)) for c in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2]))]
    own = {n: rng.randrange(10) for n in range(60) if n % 3}
    values = spark.createDataFrame(list(own.items()), "n int, v bigint")
    frame = spark.createDataFrame(edges, "n int, up int")
    for repeated in (False, True):
        used = edges if repeated else sorted(set(edges))

        def below(n, used=used):
            return own.get(n, 0) + sum(below(c) for c, p in used if p == n)

        got = subtree_sums(values, frame, [], "n", "n", "up", ["v"], repeated_edges=repeated)
        found = {r["n"]: r["v"] for r in got.collect()}
        assert {n: found.get(n, 0) for n in range(60)} == {n: below(n) for n in range(60)}


def test_subtree_sums_of_a_deep_chain(spark):
    depth = 2_000
    nodes = spark.range(depth).select(F.col("id").alias("n"), F.lit(1).alias("v"))
    edges = nodes.filter("n > 0").select("n", (F.col("n") - 1).alias("up"))
    got = subtree_sums(nodes, edges, [], "n", "n", "up", ["v"])
    assert got.filter(F.col("v") != depth - F.col("n")).isEmpty() and got.count() == depth


def test_closure_rejects_a_cycle(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "n int")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "n int, up int")
    with pytest.raises(CycleError):
        ancestor_closure(nodes, edges, [], "n", "n", "up")


def walk(versions, node, at):
    path, seen, current = [], set(), node
    while current is not None and current not in seen:
        seen.add(current)
        label, up = "?", None
        for name, parent, text, lo, hi in versions:
            if name == current and lo <= at < hi:
                label, up = text, parent
        path.append((current, label))
        current = up
    return path[::-1]


def test_root_paths_of_redefined_nodes(spark):
    rng = random.Random(6)
    names, end = list("abcdefg"), 40
    versions = []
    for name in names:
        cuts = sorted(rng.sample(range(1, end), 3))
        for lo, hi in zip([0, *cuts], [*cuts, end], strict=True):
            # Any parent may be drawn, so some periods hold cycles.
            versions.append((name, rng.choice([*names, None]), f"{name}{lo}", lo, hi))
    df = spark.createDataFrame(versions, "n string, up string, l string, lo int, hi int")
    got = root_paths(df, [], "n", "up", "l", "lo", "hi").collect()
    for name in names:
        for at in range(end):
            match = [r for r in got if r["node"] == name and r["since"] <= at < r["until"]]
            assert len(match) == 1
            assert list(zip(match[0]["ids"], match[0]["labels"], strict=True)) == walk(versions, name, at)


def test_ordinals(spark):
    rng = random.Random(7)
    ids = rng.sample(range(5000), 600)
    rows = [("hot" if i % 3 else "b", x, rng.randrange(20)) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "k string, id bigint, v int")

    def expected(order):
        out = {}
        for key in ("hot", "b"):
            mine = sorted((r for r in rows if r[0] == key), key=order)
            out.update({(key, r[1]): n for n, r in enumerate(mine)})
        return out

    by_id = ordinal_by_unique(df, ["k"], "id", "n", cell_width=64)
    assert {(r["k"], r["id"]): r["n"] for r in by_id.collect()} == expected(lambda r: r[1])
    by_value = ordinal_by_order(df, ["k"], [F.col("v"), F.col("id")], "n")
    assert {(r["k"], r["id"]): r["n"] for r in by_value.collect()} == expected(lambda r: (r[2], r[1]))
    top = top_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 3)
    assert top.count() == 6


def test_range_join_leaves_the_strategy_to_spark(spark):
    p = spark.createDataFrame([("a", 1, 5)], "k string, p int, ts bigint")
    w = spark.createDataFrame([("a", 1, 0, 10)], "k string, s_id int, s bigint, e bigint")
    joined = range_join(p, w, ["k"], "ts", "s", "e")
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_checkpoint_folder_is_set(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
