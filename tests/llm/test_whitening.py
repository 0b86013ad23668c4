"""Whitening against numpy's eigenvectors, and exact sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import whitening
from quarrylens.llm.eigen import counts_below, largest_eigenvalues, leading_eigenpairs, tridiagonal
from quarrylens.llm.whitening import Centre, _chunks, _deviations, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 40):
        x = rng.normal(size=(3 * n, n)) * rng.uniform(0.1, 5, n)
        yield x.T @ x / len(x)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield q @ np.diag([5.0] * 4 + [4.0, 4.0 - 1e-10, 3.0] + [1e-12] * 23) @ q.T
    yield q @ np.diag([1e150] * 2 + [1e140] * 28) @ q.T
    yield np.eye(9)
    yield np.diag([3.0, 0, 3, 1, 0])
    yield np.ones((6, 6))


def test_eigenpairs():
    for a in matrices():
        values, vectors = leading_eigenpairs(a, 8)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        norm = np.abs(a).max()
        assert len(values) == min(8, len(a)) and np.abs(values - want).max() <= 1e-13 * norm * len(a)
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * norm * len(a)
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-12
    values, vectors = leading_eigenpairs(np.zeros((3, 3)), 2)
    assert values.tolist() == [0, 0] and (vectors @ vectors.T == np.eye(2)).all()


def test_sturm_counts():
    for a in matrices():
        d, e, _ = tridiagonal(a / np.abs(a).max())
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        own = np.sort(np.linalg.eigvalsh(t))
        points = np.array([own[0] - 1, own[-1] + 1, own.mean() + 0.0123])
        assert counts_below(d, e, points).tolist() == [(own < p).sum() for p in points]
        assert np.abs(largest_eigenvalues(d, e, len(d)) - own[::-1]).max() <= 1e-13 * len(d)


def plain(rows, count=8):
    """{vec_id: (n, deviation, whitened, explained)} of one length, by numpy."""
    x = {i: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for i, v in rows}
    n, s = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    centred = {i: np.array([(n * a - t) / n for a, t in zip(v, s, strict=True)]) for i, v in x.items()}
    all_rows = np.stack(list(centred.values()))
    cov = all_rows.T @ all_rows / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return {
        i: (n, sum((n * a - t) ** 2 for a, t in zip(x[i], s, strict=True)), centred[i] @ vectors / np.sqrt(values), values / np.trace(cov))
        for i in x
    }


def check(found, want):
    assert {r["vec_id"] for r in found} == set(want)
    count = len(next(iter(want.values()))[2])
    signs = np.ones(count)
    for k in range(count):
        r = max(found, key=lambda r: abs(r["whitened"][k]))
        signs[k] = np.sign(r["whitened"][k] * want[r["vec_id"]][2][k])
    for r in found:
        n, deviation, white, explained = want[r["vec_id"]]
        assert r["n"] == n and int(r["deviation"]) == deviation
        assert np.allclose(np.array(r["whitened"]), white * signs, rtol=0, atol=1e-9)
        assert np.allclose(r["explained"], explained, rtol=1e-10) and r["identity_error"] <= 1e-10


def random_rows(seed, count, dims):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    return [(i, (rng.normal(size=dims) @ mix * 0.1).astype(np.float32).tolist()) for i in range(count)]


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_AT_ONCE", 37)
    long, short = random_rows(1, 400, 16), random_rows(2, 90, 3)
    short = [(1000 + i, v) for i, v in short]
    rows = [(i, v, 1) for i, v in long + short]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.0] * 15, 1), (-4, [float("nan")] * 16, 1), (-5, [float("inf")] * 16, 1), (-6, [1e30] * 16, 1)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("N", F.lit("x")).withColumn("Whitened", F.lit(1))
    found = whiten(frame).collect()
    check([r for r in found if r["vec_id"] < 1000], plain(long))
    check([r for r in found if r["vec_id"] >= 1000], plain(short, 3))
    assert len(found) == len(long) + len(short) and "label" in found[0].asDict()
    # As many passes as the matrices need give the same rows.
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    again = {r["vec_id"]: r for r in whiten(frame).collect()}
    assert all(again[r["vec_id"]]["deviation"] == r["deviation"] for r in found)
    assert all(np.allclose(again[r["vec_id"]]["whitened"], r["whitened"], atol=1e-9) for r in found)


def test_without_variance(spark):
    rows = [(i, [0.5, 0.25 * (i % 2), 1.0], None) for i in range(10)]
    found = whiten(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()
    assert len(found) == 11
    for r in found:
        assert r["n"] == 11 and r["whitened"][0] is not None and r["whitened"][1:] == [None, None]
        assert r["explained"] == pytest.approx([1.0, 0.0, 0.0]) and r["identity_error"] < 1e-12
    (r,) = whiten(spark.createDataFrame([(None, [1.0, 2.0], None)], SCHEMA)).collect()
    assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, [None, None], [None, None], 0.0)
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_deviations_are_exact_beyond_longs():
    rng = random.Random(9)
    for n, most in ((50_000, 700), (10**9, 1 << 20), (3, 1 << 43)):
        base = np.array([rng.randrange(most) for _ in range(4)], dtype=np.int64)
        rest = [rng.randint(-(n // 2), n // 2) for _ in range(4)]
        x = np.array([[rng.randint(-most, most) for _ in range(4)] for _ in range(5)], dtype=np.int64)
        want = [sum((n * int(a) - (r + n * int(b))) ** 2 for a, b, r in zip(row, base, rest, strict=True)) for row in x]
        assert [int(v) for v in _deviations(x, Centre(n, base, rest))] == want


def test_chunks():
    assert list(_chunks([])) == [] and [len(c) for c in _chunks([4096, 64, 8000])] == [2, 1]
