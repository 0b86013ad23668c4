"""Rows of one row group, over files cut into more splits than there are cores."""

from __future__ import annotations

import base64

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarrylens.functions import blobs
from quarrylens.operators.json_walk import walk_json
from quarrylens.plans import rawjson
from quarrylens.sources.star_events import spread_table


def test_one_row_group_is_spread(spark, tmp_path):
    count = 4000
    rows = pa.table({"doc_id": range(count), "text": [f"{i} " * 50 for i in range(count)]})
    pq.write_table(rows, f"{tmp_path}/documents.parquet", use_dictionary=False)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        found = spread_table(spark, str(tmp_path), "documents")
        held = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(held) == count
    assert max(held) < count / 2


def test_lenient_base64(spark):
    whole = base64.b64encode(bytes(range(256)) * 3).decode()
    texts = [whole, whole.rstrip("="), "-_-_" * 8, "ab\r\ncd!e", "a", "", None, "QUJDRA", "QUJDREU"]
    expected = []
    for text in texts:
        if text is None:
            expected.append(None)
            continue
        clean = "".join(c for c in text.replace("-", "+").replace("_", "/") if c.isalnum() or c in "+/")
        clean = clean[:-1] if len(clean) % 4 == 1 else clean
        expected.append(base64.b64decode(clean + "=" * (-len(clean) % 4)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", blobs.from_base64(F.col("t")).alias("d")).orderBy("i").collect()
    assert [None if r["d"] is None else bytes(r["d"]) for r in got] == expected


def test_inferred_tables_without_leaves(spark):
    text = '{"words":[{"w":"a","n":1},{"w":"b"}],"mixed":[1,{"x":[2]},"s"],"late":[{"n":1},{"n":2,"z":[true]}],"empty":[]}'
    docs = spark.createDataFrame([("t", text), ("u", "[1,[2,3]]"), ("v", "7")], "trace_id string, text string")
    every = walk_json(docs, ["trace_id"], "text")
    held = rawjson.held_arrays(walk_json(docs, ["trace_id"], "text", leaves=False))

    def found(nodes):
        tables = rawjson.inferred_tables(nodes)
        rows = rawjson.inferred_rows(tables, nodes)
        columns = rawjson.inferred_columns(rows)
        return [sorted(map(str, d.collect())) for d in (tables, rows.withColumn("row", F.to_json("row")), columns)]

    assert found(held) == found(every)
    kinds = {(r["trace_id"], r["name"], r["column"]): r["type"] for r in rawjson.inferred_columns(rawjson.inferred_rows(rawjson.inferred_tables(held), held)).collect()}
    assert kinds["t", "raw.inferred.late", "z"] == "undefined"
    assert kinds["t", "raw.inferred.words", "w"] == "string"
    assert kinds["u", "raw.inferred.main", "index"] == "number"
