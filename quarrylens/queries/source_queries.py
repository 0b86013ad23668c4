"""Readers over files that are written from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.dataset import open_dataset
from quarrylens.operators.lineage import ensure_checkpoint_dir
from quarrylens.queries.registry import query, with_events
from quarrylens.sources.classify import classify
from quarrylens.sources.export import write_files
from quarrylens.sources.json_ranges import read_members
from quarrylens.sources.module_graph import decode_graph_files, edges
from quarrylens.sources.star_events import base_rows, read_table
from quarrylens.sources.trace_stream import list_files, stream_files, typed_rows

RANGE_BYTES = 1 << 16  # files of these tables are small: many ranges all the same
PER_FILE = 2000


def written_documents(spark: SparkSession, documents: DataFrame, ending: str) -> str:
    """Write (doc, text) as one file per row, in a new shared folder, and return the folder."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4().hex}"
    path = F.concat(F.lit("doc-"), F.col("doc").cast("string"), F.lit(ending))
    write_files(documents.select(path.alias("relativePath"), F.lit("text").alias("kind"), F.encode("text", "UTF-8").alias("body")), out)
    return out


def _doc_of(path: str):
    return F.regexp_extract(path, r"doc-(\d+)", 1).cast("bigint")


def _document_lists(spark, sf_dir):
    """Arrays of documents, a bounded number in each."""
    doc = F.floor(F.col("doc_id") / PER_FILE).alias("doc")
    item = F.struct(F.col("doc_id").alias("id"), "text")
    rows = read_table(spark, sf_dir, "documents").groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("doc", F.to_json("items").alias("text"))


@query(
    "a01_json_members",
    f"""SELECT doc_id // {PER_FILE} AS doc, row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id) - 1 AS position, doc_id AS id, sha256(text) AS digest
FROM documents""",
)
def json_members(spark, sf_dir):
    """Large arrays read in ranges, item by item."""
    folder = written_documents(spark, _document_lists(spark, sf_dir), ".json")
    files = list_files(spark, folder)
    rows, _ = read_members(files.select("trace_id", "uri", "length"), None, RANGE_BYTES)
    item = F.from_json("text", "id bigint, text string")
    return rows.join(files.select("trace_id", "path"), "trace_id").select(
        _doc_of("path").alias("doc"), "position", item["id"].alias("id"), F.sha2(item["text"], 256).alias("digest")
    )


def _traces(spark, sf_dir):
    """Trace documents of the events, a bounded number in each; times have fractions."""
    args = F.struct(F.struct("k", F.concat(F.lit('"]}\\'), "et").alias("label")).alias("data"))
    event = F.struct(
        F.col("rawIndex").alias("at"),
        F.col("et").alias("name"),
        F.lit("X").alias("ph"),
        "pid",
        "tid",
        (F.col("ts").cast("double") + 0.5).alias("ts"),
        F.col("span").alias("dur"),
        args.alias("args"),
    )
    doc = F.floor(F.col("rawIndex") / PER_FILE).alias("doc")
    rows = base_rows(spark, sf_dir).groupBy(doc).agg(F.sort_array(F.collect_list(event)).alias("traceEvents"))
    whole = F.struct(F.struct(F.col("doc").alias("number")).alias("metadata"), "traceEvents")
    return rows.select("doc", F.to_json(whole).alias("text"))


@query(
    "a02_trace_ranges",
    with_events(
        f""" SELECT idx // {PER_FILE} AS doc, row_number() OVER (PARTITION BY idx // {PER_FILE} ORDER BY idx) - 1 AS "rawIndex", et AS name, pid, tid,
  ts + CAST(0.5 AS DOUBLE) AS ts, CAST(span AS DOUBLE) AS dur, k, '"]}}\\' || et AS label, NULL AS metadata FROM e
UNION ALL SELECT DISTINCT idx // {PER_FILE}, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{{"number":' || idx // {PER_FILE} || '}}' FROM e"""
    ),
)
def trace_ranges(spark, sf_dir):
    """Plain traces read by several tasks each."""
    folder = written_documents(spark, _traces(spark, sf_dir), ".json")
    files = list_files(spark, folder)
    rows = typed_rows(stream_files(files, RANGE_BYTES))
    args = F.col("args")
    return rows.join(files.select("trace_id", "path"), "trace_id").select(
        _doc_of("path").alias("doc"),
        "rawIndex",
        "name",
        "pid",
        "tid",
        "ts",
        "dur",
        F.try_variant_get(args, "$.data.k", "bigint").alias("k"),
        F.try_variant_get(args, "$.data.label", "string").alias("label"),
        "metadata",
    )


@query(
    "a06_file_heads",
    with_events(
        f""", d AS (SELECT 'devtools' AS kind, idx // {PER_FILE} AS doc FROM e UNION SELECT 'raw-json', doc_id // {PER_FILE} FROM documents)
SELECT kind, doc FROM d"""
    ),
)
def file_heads(spark, sf_dir):
    """Kinds of files told by their heads."""
    folders = [written_documents(spark, make(spark, sf_dir), ".json") for make in (_traces, _document_lists)]
    return classify(spark, folders).select("kind", _doc_of("path").alias("doc"))


@query(
    "a08_graph_files",
    """SELECT p_partkey AS doc, q.section, q.node, q.pos, p_partkey + q.add AS target FROM part, (VALUES
  ('source_children', 0, 0, 0), ('source_children', 2, 0, 7), ('source_children', 2, 1, 9), ('module_dependents', 0, 0, 1)) AS q(section, node, pos, add)""",
)
def graph_files(spark, sf_dir):
    """A binary file for each part, its sections read by ranges of two nodes."""
    from quarrylens.queries.bundle_queries import graph_contents

    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4().hex}"
    files = graph_contents(spark, sf_dir)
    # A folder with an entry for each part would be listed by one task; one for each part would be a block of disk more.
    part = F.substr("path", F.lit(2))
    folder = F.floor(part.cast("bigint") / PER_FILE).cast("string")
    path = F.concat(folder, F.lit("/doc-"), part, F.lit(".data"))
    write_files(files.select(path.alias("relativePath"), F.lit("binary").alias("kind"), F.col("content").alias("body")), out)
    found = edges(decode_graph_files(spark, out, range_nodes=2))
    return found.select(_doc_of("path").alias("doc"), "section", "node", "pos", "target")


@query(
    "a11_raw_documents",
    f"""SELECT doc_id // {PER_FILE} AS doc, count(*) AS items, CAST(sum(doc_id) AS BIGINT) AS total, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents GROUP BY 1""",
)
def raw_documents(spark, sf_dir):
    """Whole documents of a dataset whose tables are held item by item."""
    folder = written_documents(spark, _document_lists(spark, sf_dir), ".json")
    ds = open_dataset(spark, folder, kind="raw-json", bronze=f"{folder}-bronze")
    items = F.from_json("text", "array<struct<id:bigint,text:string>>")
    found = ds.raw_document().select(_doc_of("path").alias("doc"), items.alias("items"))

    def total(of):
        return F.aggregate(F.transform("items", of), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0)))

    return found.select("doc", F.size("items").cast("bigint").alias("items"), total(lambda x: x["id"]).alias("total"), total(lambda x: F.length(x["text"])).alias("chars"))
