"""SimHash near-dedup."""

import random

import helpers
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import units
from quarrylens.llm.graph import components
from quarrylens.llm.simhash import fingerprint, links, simhash_dedup, simhash_groups


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "a b c", "A b\x0bC d", "a\xa0b c d e", "É é \x1c x y z"]
    texts += [helpers.prose(rng, rng.randint(1, 90)) for _ in range(30)] + ["same same " * 9_000]
    for text in texts:
        assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def near_prints(rng, n):
    """Fingerprints around a few centres, with many pairs at exactly 3 to 6 bits."""
    centres = [rng.getrandbits(64) for _ in range(40)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_every_link_is_found(spark, monkeypatch, block_rows):
    monkeypatch.setattr(units.to_units, "__defaults__", (block_rows,))
    prints = near_prints(random.Random(6), 700)
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(prints)]
    frame = spark.createDataFrame(rows, "node bigint, fp bigint")
    got = links(frame)
    pairs = [(i, j) for i in range(700) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert pairs
    for r in got.collect():
        assert r.a != r.b
    found = {r.node: r.component for r in components(got).collect()}
    want = {n: c for n, c in helpers.components(range(700), pairs).items()}
    assert {n: found.get(n, n) for n in want} == want


def test_single_pairs_at_the_budget(spark):
    """Pairs of four differing bits anywhere, far from all others: no chain hides them."""
    rng = random.Random(9)
    rows, n = [], 400
    for i in range(n):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4 if i % 2 else 5):
            y ^= 1 << b
        rows += [(2 * i, x), (2 * i + 1, y)]
    frame = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "node bigint, fp bigint")
    found = {tuple(sorted((r.a, r.b))) for r in links(frame).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(n) if i % 2}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 900), (900, 901), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900, 1000: 900}


def test_groups_and_dedup(spark):
    rng = random.Random(11)
    base = [helpers.prose(rng, 300) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(50 + i, base[0]) for i in range(30)] + [(90, base[1] + " tail"), (91, ""), (92, None), (93, "  ")]
    frame = helpers.docs(spark, rows)
    got = {r.doc_id: r for r in simhash_groups(frame.withColumn("fp", F.lit(3)).withColumn("node", F.lit("x"))).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == helpers.components(prints, pairs)
    assert {i: int(np.int64(r.fp).astype(np.uint64)) for i, r in got.items()} == prints
    kept = simhash_dedup(frame.unionByName(frame).unionByName(helpers.docs(spark, [(None, "x"), (None, "x")])))
    other = helpers.prose(rng, 200)
    shared = simhash_dedup(frame.unionByName(helpers.docs(spark, [(0, other), (0, other)])))
    assert sorted(r.text for r in shared.filter("doc_id = 0").collect()) == sorted([base[0], other])
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(helpers.components(prints, pairs).values()))
    assert kept.filter("doc_id is null").count() == 2
    assert simhash_groups(frame.limit(0)).count() == 0
