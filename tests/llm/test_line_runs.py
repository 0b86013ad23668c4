"""Line dedup over sorted runs."""

import random
import re

import helpers
import pytest
from pyspark.sql import functions as F

from quarrylens.llm.line_runs import LineRuns, dedup_lines


def plain(rows):
    """{(doc_id, text): (kept text, lines, dropped)} for documents of different ids."""
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    pool = [helpers.prose(rng, 9).replace("\n", " ") for _ in range(40)] + ["Short", "ten chars!", "é" * 10, "É" * 10, "\x1cnine char", "nine char"]
    def line():
        x = rng.choice(pool)
        return rng.choice([x, x.upper(), f" \t{x}\r", "", "own " + str(rng.random())])

    return ["\n".join(line() for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_against_holders(spark, batches):
    rows = [(3 * i, t) for i, t in enumerate(texts(1, 120))] + [(1000, None), (1001, ""), (1002, "a line of many\n" * 20_000), (1003, "A line of many")]
    frame = helpers.docs(spark, rows).withColumn("kept_TEXT", F.lit(1)).withColumn("holder", F.lit("x"))
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(frame, batches=batches).collect()}
    assert got == plain(rows)


def test_a_store_goes_on(spark):
    """Documents that come later lose what earlier calls hold; runs are merged on the way."""
    rows = [(i, t) for i, t in enumerate(texts(2, 90))]
    store = LineRuns(spark, 3, fan_out=2)
    got = {}
    for low in range(0, 90, 30):
        part = dedup_lines(helpers.docs(spark, rows[low : low + 30]), batches=2, runs=store)
        got.update({r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in part.collect()})
    assert got == plain(rows)
    assert len(store.levels) > 1 and all(len(x) < 2 for x in store.levels)
    holders = store.holders()
    assert holders.groupBy("h1", "h2").count().filter("count > 1").isEmpty()
    tables = store.runs()
    store.drop()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_repeated_ids_and_missing_ids(spark):
    line = "this line is shared"
    rows = [(1, line), (1, line + "\nother line of one"), (None, line), (None, "other line of one\nfree line of none"), (2, line)]
    got = sorted((r["doc_id"] or 99, r["kept_text"]) for r in dedup_lines(helpers.docs(spark, rows)).collect())
    assert got == [(1, line), (1, line + "\nother line of one"), (2, ""), (99, ""), (99, "free line of none")]
    assert dedup_lines(helpers.docs(spark, rows).limit(0)).count() == 0
