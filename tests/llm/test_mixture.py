"""Mixing sources."""

import random
from fractions import Fraction

import helpers
import pytest
from pyspark.sql import functions as F

from quarrylens.llm.mixture import mix_sources, mixed_documents, sainte_lague


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Round by round: who would be above stops there, and the rest shares again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        now = {s: Fraction(most * sizes[s]) if s in full else rest * weight[s] / left for s in names}
        more = {s for s in names if s not in full and now[s] > most * sizes[s]}
        if not more:
            return now
        full |= more


def rows(seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        source = rng.choice(["b", "a", "É", "z", "a0", None, "hot", "hot", "hot", "hot"])
        out.append((i, " ".join("w" for _ in range(rng.randint(0, 90))), "en", source))
    return out + [(1000, None, "en", "tiny"), (1001, "five words are in here", "en", "tiny"), (1002, "", "en", "none")]


@pytest.mark.parametrize("shard_words", [1 << 16, 700])
def test_targets_and_taken_words(spark, shard_words):
    data = rows()
    found = [r.asDict() for r in mix_sources(helpers.docs(spark, data).withColumn("target", F.lit("x")), shard_words=shard_words).collect()]
    assert len(found) == len(data)
    sizes = {}
    for i, text, _, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    by = {r[0]: r for r in data}
    for r in found:
        source = by[r["doc_id"]][3]
        taken[source] += r["taken"]
        assert r["size"] == len((by[r["doc_id"]][1] or "").split())
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(float(want[source]))
        assert 0 <= r["taken"] <= 2 * r["size"]
    for source, words in taken.items():
        shards = -(-sizes[source] // shard_words) or 1
        assert abs(words - want[source]) <= 16 * (1 + shards)
    again = mix_sources(helpers.docs(spark, data[::-1]).repartition(7), shard_words=shard_words)
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in found}


def test_seats_by_highest_quotients(spark):
    votes = {0: 53, 1: 24, 2: 23, 3: 0, 4: 1, 5: 1000}
    for seats in (0, 1, 7, 10, 40, 101):
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            won = min((p for p in votes if want[p] < 60), key=lambda p: (-Fraction(votes[p], 2 * want[p] + 1), p))
            want[won] += 1
        frame = spark.createDataFrame([(p, float(v), 60) for p, v in votes.items()], "p bigint, votes double, most bigint")
        got = {r.p: r.quota for r in sainte_lague(frame, "votes", F.lit(seats), "p", "most").collect()}
        if max(want.values()) < 60:
            assert got == want
        assert all(q <= 60 for q in got.values())


def test_the_mix_holds_what_it_takes(spark):
    data = [(i, f"\n  {t}\nend ", lang, s) for i, t, lang, s in rows(5)]
    frame = helpers.docs(spark, data)
    plan = {r.doc_id: r.taken for r in mix_sources(frame, shard_words=900).collect()}
    mixed = mixed_documents(frame, shard_words=900)
    assert mixed.columns == frame.columns
    words, by = {}, {r[0]: r[1] for r in data}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.text in by[r.doc_id]
    assert words == {i: n for i, n in plan.items() if n}


def test_rows_without_an_id_and_texts_that_share_one(spark):
    data = [(i % 40 if i % 3 else None, f"{'own ' * (i % 7)}text {i}", "en", f"s{i % 2}") for i in range(400)]
    data += data[:50] + [(None, None, "en", None), (7, "same words", "en", None), (7, "same words", "de", None)]
    frame = helpers.docs(spark, data)
    planned = mix_sources(frame, shard_words=300).collect()
    assert len(planned) == len(data)
    want, got = {}, {}
    for r in planned:
        want[(r.doc_id, r.source)] = want.get((r.doc_id, r.source), 0) + r.taken
    for r in mixed_documents(frame, shard_words=300).collect():
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert got == {k: n for k, n in want.items() if n} and None in {k[0] for k in got}


def test_odd_tables(spark):
    empty = helpers.docs(spark, [(1, "x")]).limit(0)
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0
    blank = mix_sources(helpers.docs(spark, [(1, None), (2, " "), (None, "")])).collect()
    assert [r.taken for r in blank] == [0, 0, 0] and {r.target for r in blank} == {0.0}
    same = mix_sources(helpers.docs(spark, [(1, "a b c")] * 4 + [(None, "d e")])).collect()
    assert len(same) == 5 and sum(r.taken for r in same) in range(13, 30)
    one = mix_sources(helpers.docs(spark, [(1, "word " * 300_000)])).collect()
    assert one[0].taken == pytest.approx(450_000, abs=16)
