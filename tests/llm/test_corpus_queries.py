"""Registered corpus queries against SQL, and the pipeline against plain versions of its stages."""

import os

import duckdb
import helpers
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrylens.llm.common import TOKENIZERS, read_bytes
from quarrylens.llm.pieces import MODEL, PieceCoder
from quarrylens.llm.quality_rules import BANDS, accepts, base_counts, entropy, load_vocabulary
from quarrylens.llm.queries import OP10_SQL, ORACLES
from tools_check import compare, connect

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_each_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem = compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


def test_pipeline_equals_plain_stages(spark):
    from test_line_runs import plain as plain_lines
    from test_simhash import plain_fingerprint

    vocabularies = {name: load_vocabulary(name, read_bytes(f"{TOKENIZERS}/{name}")) for name in BANDS}
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]

    def good(doc):
        words, (n_words, points, _, _, repeated) = base_counts(doc["text"].encode())
        if n_words < 10 or 100 * repeated > 20 * n_words:
            return False
        for name, vocabulary in vocabularies.items():
            ids = vocabulary.encode(b" ".join(words).decode())
            if not accepts(BANDS[name][doc["lang"]], len(ids), points / len(ids), vocabulary.is_byte[ids].mean(), entropy(ids)):
                return False
        return True

    docs = [d for d in docs if good(d)]
    kept = plain_lines([(d["doc_id"], d["text"]) for d in docs])
    docs = [{**d, "text": kept[d["doc_id"]][0]} for d in docs]
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    group = helpers.components(prints, pairs)
    docs = [d for d in docs if group[d["doc_id"]] == d["doc_id"]]
    db = duckdb.connect()
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["source"]) for d in docs], "doc_id bigint, text string, source string").toPandas()
    db.register("documents", frame)
    taken = dict(db.execute(f"SELECT doc_id, taken FROM ({OP10_SQL})").fetchall())
    coder = PieceCoder(read_bytes(f"{TOKENIZERS}/{MODEL}"))
    text = {d["doc_id"]: d["text"] for d in docs}
    words = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        decoded = coder.decode(r.token_ids)
        assert decoded in text[r.doc_id] and r.n_tokens == len(r.token_ids)
        assert np.array_equal(coder.encode(decoded), r.token_ids)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(decoded.encode().split())
    assert words == {i: n for i, n in taken.items() if n}
