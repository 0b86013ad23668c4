"""Streams of files give the rows of the batch operators."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.sessions import capped_sessions
from quarrylens.plans.cpu import cpu_timeline
from quarrylens.streaming.sessions import capped_sessions_stream
from quarrylens.streaming.timeline import cpu_timeline_stream

SAMPLES = "trace_id string, chunk bigint, pos int, tsUs double, functionName string, timeDeltaUs double"
POINTS = "k string, ts bigint, v bigint"
MINUTE = 60_000_000


def run(spark, tmp_path, schema, batches, make, name):
    """All rows that a stream of one file per batch appends."""
    folder = tmp_path / name
    folder.mkdir()
    for number, rows in enumerate(batches):
        lines = [json.dumps(dict(zip([f.split()[0] for f in schema.split(", ")], r, strict=True))) for r in rows]
        (folder / f"{number:03d}.json").write_text("\n".join(lines))
        os.utime(folder / f"{number:03d}.json", (number + 1, number + 1))  # files are read oldest first
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = (
        make(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return spark.sql(f"SELECT * FROM {name}")


def key(rows):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rows)


def test_timeline(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{i % 2}", i, 0, 1e9 + i * 900 + rng.randrange(700) + 0.25, f"f{rng.randrange(7)}", rng.randrange(50) + 0.5) for i in range(120)]
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randrange(20_000))
    late = ("t0", 999, 0, 1e9 + 100.0, "late", 1.0)
    end = ("end", 1000, 0, 1e9 + 10 * MINUTE, "end", 0.0)
    batches = [shuffled[i : i + 40] for i in range(0, 120, 40)] + [[end], [end], [late], [(*end[:3], end[3] + MINUTE, *end[4:])]]
    found = run(spark, tmp_path, SAMPLES, batches, cpu_timeline_stream, "timeline")
    want = cpu_timeline(spark.createDataFrame(rows, SAMPLES))
    assert key(found.filter("trace_id <> 'end'").collect()) == key(want.collect())
    assert key(cpu_timeline_stream(spark.createDataFrame(rows, SAMPLES)).collect()) == key(want.collect())


@pytest.mark.parametrize("gap", [1_000, 40_000])
def test_capped_sessions(spark, tmp_path, gap):
    rng = random.Random(gap)
    rows = [(f"k{rng.randrange(3)}", 10**9 + rng.randrange(3_000_000), rng.randrange(9)) for _ in range(150)]
    rows += [("k0", rows[0][1], 5)] * 2
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(500_000))
    end = [("end", 10**9 + 10 * MINUTE, 0)]
    late = [("k1", 10**9 + 5, 100)]
    batches = [shuffled[i : i + 50] for i in range(0, len(shuffled), 50)] + [end, end, late, [("end", 10**9 + 20 * MINUTE, 0)]]
    found = run(spark, tmp_path, POINTS, batches, lambda s: capped_sessions_stream(s, ["k"], "ts", gap, 100_000, ["v"]), f"sessions{gap}")
    want = capped_sessions(spark.createDataFrame(rows, POINTS), ["k"], "ts", gap, 100_000, {"v": F.col("v")})
    assert key(found.filter("k <> 'end'").collect()) == key(want.withColumn("v", F.col("v").cast("double")).collect())
