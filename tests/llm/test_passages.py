"""Substring dedup."""

import random
import re
import tracemalloc

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm.passages import (
    ANCHOR,
    UNITS,
    Words,
    _all_units,
    _filter_of,
    _passes,
    _windows,
    normalised,
    remove_passages,
    repeated_passages,
)


def brute(rows, unit, least):
    """Spans of repeats, with a dictionary of first occurrences over the sorted documents."""
    seen, out = {}, []
    for doc_id, text in sorted(rows):
        run = []

        def close(run=run, doc_id=doc_id):
            if run and sum(r[2] for r in run) >= least:
                out.append((doc_id, run[0][0], run[-1][1], sum(r[2] for r in run), len(run), run[0][3]))
            run.clear()

        for m in UNITS[unit].finditer(text or ""):
            words = tuple(normalised(m[0]))
            if not words:
                continue
            if words in seen:
                run.append((m.start(), m.end(), len(words), seen[words]))
            else:
                seen[words] = doc_id
                close()
        close()
    return sorted(out)


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_against_first_occurrences(spark, unit):
    rng = random.Random(5)
    shared = [helpers.prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(80):
        text = helpers.prose(rng, rng.randint(5, 120))
        if i % 4 == 0:
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join(words[:at]) + rng.choice([" ", "\n", "\n\n"]) + rng.choice(shared) + "\n\n" + " ".join(words[at:])
        rows.append((i, text))
    rows += [(90, rows[3][1]), (91, rows[3][1].upper()), (92, ""), (93, None), (94, "One. One. One."), (95, "é" * 10 + ". " + shared[0])]
    frame = helpers.docs(spark, rows).withColumn("rank", F.lit(1)).withColumn("_run", F.lit("x"))
    for least in (1, 25):
        found = repeated_passages(frame, unit=unit, min_words=least)
        got = sorted((r.doc_id, r.start, r.end, r.n_words, r.n_units, r.kept_doc_id) for r in found.collect())
        assert got == brute(rows, unit, least)


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(8)
    passage = helpers.prose(rng, 70, vocabulary=100_000).replace("\n", " ")
    short = "A line that many share."
    rows = [(i, helpers.prose(rng, 80, vocabulary=100_000) + " " + short) for i in range(40)]
    for i in range(0, 40, 5):
        rows[i] = (i, rows[i][1] + " " + passage + " " + helpers.prose(rng, 20, vocabulary=100_000))
    found = repeated_passages(helpers.docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in found) == [5, 10, 15, 20, 25, 30, 35]
    assert all(r.kept_doc_id == 0 and passage in dict(rows)[r.doc_id][r.start : r.end] for r in found)


def test_removal_keeps_offsets(spark):
    first = "One two three four five. Six seven eight."
    rows = [(1, first), (2, "Own words here. " + first + "\nEnd of it."), (3, None), (4, "")]
    frame = helpers.docs(spark, rows)
    got = {r.doc_id: r for r in remove_passages(frame, repeated_passages(frame, min_words=5)).collect()}
    assert got[2].kept_text == "Own words here. \nEnd of it." and got[1].kept_text == first
    (span,) = got[2].removed
    assert rows[1][1][span.start : span.end] == first and span.kept_doc_id == 1
    assert got[3].kept_text is None and got[4].kept_text == "" and got[3].removed == []


def test_repeated_rows_and_missing_ids(spark):
    text = "Word " * 30 + "end."
    frame = helpers.docs(spark, [(1, text), (1, text), (None, text), (2, text)])
    got = {(r.doc_id, r.kept_doc_id) for r in repeated_passages(frame).collect()}
    assert got == {(2, 1), (None, 1)}
    assert remove_passages(frame, repeated_passages(frame)).filter("size(removed) = 0").count() == 2
    assert repeated_passages(frame.limit(0)).count() == 0


def test_long_text_without_breaks(spark):
    text = "x" * 500_000
    got = repeated_passages(helpers.docs(spark, [(1, text), (2, text)]), min_words=1).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(2, 0, 500_000)]
    assert re.fullmatch(UNITS["line"], text)


def test_passages_at_any_word_against_windows(spark):
    rng = random.Random(11)
    shared = [helpers.prose(rng, n, vocabulary=100_000).split() for n in (50, 50, 57, 75, 130)]
    rows = []
    for i in range(60):
        words = helpers.prose(rng, 90, vocabulary=100_000).split()
        if i % 2:
            # A part that begins and ends inside sentences, with other line breaks, and at times one word changed.
            part = [x.upper() for x in shared[i % 5]]
            if i % 3 == 0 and len(part) > 120:
                part[60] = f"other{i}"
            at = rng.randrange(len(words))
            words = words[:at] + part + words[at:]
        rows.append((i, "".join(w.strip(".") + rng.choice([" "] * 9 + ["\n"]) for w in words)))
    rows += [(70, "É ﬁn " + rows[1][1]), (71, " ".join(["same"] * 170)), (72, " ".join(["same"] * 130))]
    seen, covered = {}, set()
    for doc_id, text in rows:
        words = list(re.finditer(r"\S+", text))
        for i in range(len(words) - 49):
            key = " ".join(" ".join(normalised(w[0])) for w in words[i : i + 50])
            first = seen.setdefault(key, (doc_id, i))
            if first[0] != doc_id or first[1] + 50 <= i:
                covered |= {(doc_id, w.start()) for w in words[i : i + 50]}
    found = repeated_passages(helpers.docs(spark, rows), min_words=10**6).collect()
    texts = dict(rows)
    got = {(r.doc_id, r.start + m.start()) for r in found for m in re.finditer(r"\S+", texts[r.doc_id][r.start : r.end])}
    whole = set()
    first_lines = {}
    for doc_id, text in rows:
        for m in UNITS["line"].finditer(text):
            if first_lines.setdefault(tuple(normalised(m[0])), (doc_id, m.start())) != (doc_id, m.start()):
                whole |= {(doc_id, m.start() + w.start()) for w in re.finditer(r"\S+", m[0])}
    assert len({d for d, _ in covered}) > 25
    assert covered <= got and got - covered <= whole
    assert {d for d, _ in got} >= {70, 71, 72}


def test_short_lines_paragraphs_and_documents(spark):
    rng = random.Random(12)
    first = "Some rights kept.\n" + helpers.prose(rng, 40, vocabulary=100_000)
    second = helpers.prose(rng, 40, vocabulary=100_000) + "\nsome  RIGHTS kept.\n\nWell wrapped,\nbut short."
    third = "Own one. Some rights kept. Own two.\n\nWell wrapped, but\nshort.\n\nOwn three."
    rows = [(1, first), (2, second), (3, third), (4, "Brief text."), (5, "Brief\n\ntext.")]
    found = repeated_passages(helpers.docs(spark, rows)).collect()
    texts = dict(rows)
    got = {(r.doc_id, texts[r.doc_id][r.start : r.end], r.n_words, r.kept_doc_id) for r in found}
    assert got == {(2, "some  RIGHTS kept.", 3, 1), (3, "Well wrapped, but\nshort.", 4, 2), (5, "Brief\n\ntext.", 2, 4)}


def test_memory_of_a_long_text():
    """Bytes for each character of a text of 4 million, all units and windows included."""
    rng = random.Random(3)
    part = helpers.prose(rng, 100_000, vocabulary=100_000)
    text = part * 6
    words = Words()
    tracemalloc.start()
    rows, _ = _all_units(words, text, 50)
    _windows(words, rows[rows[:, 0] == ANCHOR, 1], 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 3_500_000 and peak < 100 * len(text)


def test_filter_lets_all_its_keys_pass(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    bits = _filter_of(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key bigint").repartition(3))
    assert _passes(bits, keys[:10_000]).all() and _passes(bits, keys[10_000:]).sum() < 20
    assert not _passes(_filter_of(spark.createDataFrame([], "key bigint")), keys).any()
