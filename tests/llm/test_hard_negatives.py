"""Hard negatives against a plain ranking of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import hard_negatives as module
from quarrylens.llm.hard_negatives import hard_negatives, threshold_join

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    """Result rows; ``rows`` are (id, vector, label)."""
    fine = [
        (i, [math.floor(scale * float(np.float32(c))) for c in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fine = [r for r in fine if sum(c * c for c in r[1]) < 1 << 52]
    out = []
    for a_id, a, a_label in {(i, tuple(v), label) for i, v, label in fine if anchor(i)}:
        scored = [(sum(x * y for x, y in zip(a, v, strict=True)), i, label) for i, v, label in fine if i != a_id and len(v) == len(a)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, p_id, _ in [s for s in scored if s[2] == a_label][:positives]:
            inside = [s for s in scored if s[2] != a_label and low * p <= 100 * s[0] <= high * p]
            out += [(a_id, p_id, rank, n_id, p, n) for rank, (n, n_id, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def random_rows(seed, count, dims, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(0, 6, count)] * spread + rng.normal(size=(count, dims)) * rng.uniform(0.05, 0.5, dims)
    return [(i, row.astype(np.float32).tolist(), int(rng.integers(0, labels))) for i, row in enumerate(v)]


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(("count", "dims", "t"), [(300, 40, 0.9), (300, 40, 0.3), (200, 5, 0.5), (100, 64, -1.0), (50, 8, 0.0), (30, 0, 0.0)])
def test_threshold_join(count, dims, t):
    rng = np.random.default_rng(count + dims)
    x = np.floor(rng.normal(size=(count, dims)) * 100 * rng.uniform(0, 1, dims) ** 3)
    x[::7] = x[0]
    x[3:9] = 0
    q = x[:: max(1, count // 20)] + 1.0
    least = np.floor(t * (q * q).sum(axis=1))
    want = {(a, i, int(s)) for a in range(len(q)) for i, s in enumerate(x @ q[a]) if s >= least[a] and i % 5}
    got = [(a, int(i), int(s)) for a, rows, scores in threshold_join(q, x, least, lambda a, r: r % 5 != 0) for i, s in zip(rows, scores, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_the_index_leaves_out_and_prunes(monkeypatch):
    """An anchor's lists shrink as its partial scores grow, and nothing is lost."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 64)) * 200 * np.exp(-np.arange(64) / 6))
    for k in range(20):
        q = x[k : k + 1]
        least = 0.9 * (q * q).sum(axis=1)
        sizes = []
        real = module.np.flatnonzero
        monkeypatch.setattr(module.np, "flatnonzero", lambda a, sizes=sizes, real=real: sizes.append(np.size(a)) or real(a))
        ((_, found, _),) = threshold_join(q, x, least, lambda a, r: r >= 0)
        monkeypatch.undo()
        assert set(found.tolist()) == set(np.flatnonzero(x @ q[0] >= least[0]).tolist())
        # The first list is read whole; dimensions that weigh less are left out or read for few rows.
        assert sizes[1] < 4000 / 2 and sum(sizes[:8]) < 2 * 4000


def test_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 23)
    monkeypatch.setattr(module, "ANCHORS_AT_ONCE", 3)
    rows = random_rows(1, 260, 12)
    rows += [(1000 + i, rows[10][1], i % 3) for i in range(60)]  # ties: one vector many times
    rows += [(2000 + i, v, i % 2) for i, v, _ in random_rows(4, 40, 7)]  # another length
    rows += [(-1, None, 1), (-10, [None] * 12, 1), (-20, [float("nan")] * 12, 1), (-30, [float("inf")] * 12, 2), (-40, rows[0][1], None)]
    rows += [(None, rows[0][1], 0), (-50, [], 0), (-60, [], 1), (-70, [], 0), (-80, [3e38] * 12, 1), (-90, [0.0] * 12, 3), (-100, [-0.001] * 12, 3)]
    rows += [rows[20], (10, rows[11][1], 2)]  # a repeated anchor, and a second row of an anchor's id
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("Key", F.lit("x")).withColumn("v", F.lit(1))
    found = collected(hard_negatives(frame, "vec_id % 10 = 0"))
    assert found == plain(rows, lambda i: i % 10 == 0) and len(found) > 1000


def test_more_and_fewer(spark):
    rows = random_rows(7, 120, 20, labels=2, spread=0.1)
    frame = spark.createDataFrame(rows, SCHEMA)
    for options in ({"positives": 1, "negatives": 2}, {"positives": 500, "negatives": 3, "low": 1, "high": 99}, {"scale": 1}):
        found = collected(hard_negatives(frame, "vec_id % 20 = 0", **options))
        assert found == plain(rows, lambda i: i % 20 == 0, **options)
    assert collected(hard_negatives(frame.filter("label = 0"))) == []
    assert collected(hard_negatives(frame, "false")) == []
    assert collected(hard_negatives(frame.limit(0))) == []


def test_first():
    scores, ids = np.array([5, 9, 9, 1, 9, 5]), np.array([1, 8, 2, 3, 5, 0])
    for k in range(1, 8):
        assert module._first(scores, ids, k).tolist() == [2, 4, 1, 5, 0, 3][:k]
