"""Files below folders, listed by the executors."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from test_sources import modules_file

from quarrylens.sources import listing
from quarrylens.sources.listing import list_tree
from quarrylens.sources.module_graph import decode_graph_files, edges


def uris(rows):
    return sorted(r["uri"] for r in rows.collect())


def spark_lists(spark, roots):
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.data").option("recursiveFileLookup", "true")
    return uris(read.load(roots).select(F.col("path").alias("uri")))


def test_lists_what_spark_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BATCH_ENTRIES", 2)
    names = ["a/b/c/x.data", "a/b/y.data", "a/z.data", "top.data", ".h/x.data", "_h/x.data", "a/.x.data", "a/_x.data", "k=1/x.data", "_k=1/x.data"]
    names += ["a/b c/ä x.data", "a/_metadata/x.data", "a/x.data._COPYING_", "a/x.txt", "e.data/inner.data", "a/p%41.data", "a/q+r.data"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    (tmp_path / "empty").mkdir()
    for roots in ([""], ["a", "k=1"], ["a/b/../b"], ["top.data", "a/b"], ["*"], ["empty"], ["a/z.data", "a/x.txt"]):
        given = [f"{tmp_path}/{x}" for x in roots]
        assert uris(list_tree(spark, given, ".data")) == spark_lists(spark, given), roots
    assert len(uris(list_tree(spark, [str(tmp_path)], ".data"))) == 11
    with pytest.raises(AnalysisException):
        list_tree(spark, [str(tmp_path / "none")], ".data")


def test_graph_files_are_not_listed_on_the_driver(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / str(i % 3) / str(i)).mkdir(parents=True)
        (tmp_path / str(i % 3) / str(i) / "modules.data").write_bytes(modules_file())

    def load(*args, **kwargs):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(DataFrameReader, "load", load)
    found = edges(decode_graph_files(spark, str(tmp_path), 2))
    assert found.select("path").distinct().count() == 30
