"""Embedding near-dedup."""

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import units
from quarrylens.llm.pivots import COSINE, HEAD, SHARED, link_classes, near_vectors


def brute(rows, cosine=0.9):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for k, (a, x) in enumerate(fine):
        for b, y in fine[k + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    degree = dict.fromkeys((i for i, _ in rows), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return links, degree, helpers.components([i for i, _ in rows], links)


def vectors(rng, n, spread, groups):
    centres = rng.standard_normal((groups, 32))
    out = rng.standard_normal((n, 32))
    for i in range(0, n, 2):
        out[i] = centres[rng.integers(groups)] + rng.standard_normal(32) * spread
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


def odd(rows):
    n = len(rows)
    copies = [(n + i, rows[0][1]) for i in range(20)]
    strange = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1e-30, 2e-30], [x * 1e20 for x in rows[0][1]]]
    return rows + copies + [(n + 100 + i, v) for i, v in enumerate(strange)]


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(units.to_units, "__defaults__", (block_rows,))
    rows = odd(vectors(np.random.default_rng(1), 240, 0.12, 6))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("x"))
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    links, degree, component = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert len(got) == len(rows) and len(links) > 1_500
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links)
    assert all(r.n_links <= degree[i] for i, r in got.items())
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((600, 64))
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.905 * base + np.sqrt(1 - 0.905**2) * noise
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = near_vectors(frame).agg(F.sum("n_links")).first()[0]
    assert found / 2 >= 0.95 * 600


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert near_vectors(empty).count() == 0
    bare = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in near_vectors(bare).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("pivots", [4096, 32768])
def test_recall_with_many_pivots(spark, pivots):
    rng = np.random.default_rng(7)
    base, noise, drawn = (rng.standard_normal((n, 64)) for n in (600, 600, pivots))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.905 * base + np.sqrt(1 - 0.905**2) * noise
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    classes = spark.createDataFrame(rows, "node bigint, weight bigint, vector array<double>")
    links = link_classes(classes, drawn, COSINE, HEAD, SHARED).agg(F.sum("links")).first()[0] / 2
    assert 0.97 * 600 <= links <= 600
