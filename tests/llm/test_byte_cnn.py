"""Byte-level network."""

import os
import zlib

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import byte_cnn
from quarrylens.llm.byte_cnn import BLOCK, CHUNK, WIDTH, chunk_spans, fit, new_network, score_texts, scores

SMALL = "/root/testdata/sf0.01"


def plain_score(net, text):
    """One text at a time, filter by filter, chunk by chunk."""
    blocks = -(-(len(text) + WIDTH) // BLOCK)
    raw = np.frombuffer(text.ljust(blocks * BLOCK + WIDTH, b"\0"), dtype=np.uint8)
    logits = []
    for low, high in chunk_spans(len(text) + WIDTH):
        peaks = np.max([net.embed[raw[p : p + WIDTH]].ravel() @ net.filters for p in range(low, high, byte_cnn.STEP)], axis=0)
        pooled = np.maximum(peaks + net.bias, 0)
        logits.append((np.maximum(pooled @ net.hidden + net.hidden_bias, 0) @ net.out)[0] + net.out_bias[0])
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_batched_scores_equal_plain_ones(monkeypatch):
    net = new_network(5)
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"x" * (BLOCK - WIDTH), b"y" * (CHUNK + 1)] + [rng.bytes(int(n)) for n in rng.integers(1, 4000, 20)]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(scores(net, texts), want, atol=1e-5)
    monkeypatch.setattr(byte_cnn, "BYTES_AT_ONCE", 1024)
    assert np.allclose(scores(net, texts), want, atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    texts = [b"", b"short", rng.bytes(CHUNK + 300), rng.bytes(3000)]
    labels, weights = np.array([0, 1, 1, 0.0]), np.array([1, 1, 0.5, 2.0])
    net = new_network(9)
    for w in net.weights():
        w += 0.01 * rng.standard_normal(w.shape).astype(np.float32)

    def loss():
        p = scores(net, texts)
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean()

    for w, g in zip(net.weights(), byte_cnn._gradients(net, texts, labels, weights), strict=True):
        direction = g / (np.linalg.norm(g) + 1e-12)
        kept = w.copy()
        values = []
        for sign in (1, -1):
            w[...] = kept + sign * 2e-3 * direction
            values.append(loss())
        w[...] = kept
        assert abs((values[0] - values[1]) / 4e-3 - np.linalg.norm(g)) < 0.03 * np.linalg.norm(g) + 1e-3


def test_every_part_of_a_text_trains(spark):
    """Texts that differ only far behind their beginnings, in one of many chunks, are told apart."""
    rng = np.random.default_rng(3)
    filler = [bytes(rng.integers(97, 103, 5000).astype(np.uint8)).decode() for _ in range(60)]
    rows = [(i, t[:3111] + ("#%&#%&#%&" * 60 if i % 2 else "") + t[3111:]) for i, t in enumerate(filler)]
    frame = helpers.docs(spark, rows)
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    net = fit(frame, marks, parts=1, rounds=60)
    got = {r["doc_id"]: r["score"] for r in score_texts(frame, net).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


def test_chunks_cover_a_text():
    for n in [0, 1, BLOCK, CHUNK, CHUNK + 1, 5000, 12_345]:
        spans = chunk_spans(n)
        assert spans[0][0] == 0 and spans[-1][1] >= n
        assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = fit(docs, labels.filter(~held_out))
    found = score_texts(docs, net).join(labels, "doc_id").filter(held_out).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    marks, values = np.array([r.quality for r in found]), np.array([r.score for r in found])
    ranks = values.argsort().argsort()
    ones = marks == 1
    area = (ranks[ones].mean() - ranks[~ones].mean()) / len(ranks) + 0.5
    assert area > 0.9 and ((values >= 0.3) == ones).mean() > 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "text"), (3, "text"), (4, "long " * 100_000)]
    frame = helpers.docs(spark, rows).withColumn("SCORE", F.lit("x"))
    assert fit(frame, spark.createDataFrame([(3, 1), (None, 0)], "doc_id bigint, quality int")) is None
    assert {r["score"] for r in score_texts(frame, None).collect()} == {0.5}
    got = score_texts(frame, new_network()).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2]
    assert score_texts(frame.limit(0), new_network()).count() == 0
