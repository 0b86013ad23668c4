"""Definitions of profile nodes and the chunks that they hold for."""

import random

import pytest

from quarrylens.operators import large_join
from quarrylens.plans.cpu import FOREVER, FRAME_FIELDS, node_versions


def declared(spark, rows):
    """Rows (trace, chunk, pos, node, function)."""
    columns = ", ".join(f"{c} {'int' if c.endswith('Number') else 'string'}" for c in FRAME_FIELDS)
    full = [(t, c, pos, n, None, fn, None, None, 1, None, None) for t, c, pos, n, fn in rows]
    return spark.createDataFrame(full, f"trace_id string, chunk bigint, pos int, nodeId string, {columns}")


def plain(rows):
    last = {(t, n, c): fn for t, c, _, n, fn in sorted(rows)}
    out, held = [], {}
    for (t, n, c), fn in sorted(last.items()):
        if (t, n) not in held or held[t, n][1] != fn:
            if (t, n) in held:
                out.append((t, n, held[t, n][0], c, held[t, n][1]))
            held[t, n] = (c, fn)
    return sorted(out + [(t, n, c, FOREVER, fn) for (t, n), (c, fn) in held.items()])


@pytest.mark.parametrize("kinds,few", [(1, 4096), (2, 4096), (2, 0)])
def test_versions(spark, monkeypatch, kinds, few):
    monkeypatch.setattr(large_join, "FEW_ROWS", few)
    rng = random.Random(kinds)
    rows = [("ab"[i % 2], i // 3, i % 3, n := str(rng.randrange(30)), f"f{n}-{rng.randrange(kinds) * (int(n) % 2)}") for i in range(400)]
    found = node_versions(declared(spark, rows))
    assert sorted((r["trace_id"], r["nodeId"], r["since"], r["until"], r["functionName"]) for r in found.collect()) == plain(rows)
    assert ("Window" in found._jdf.queryExecution().toString()) == (kinds > 1)


def test_no_declarations(spark):
    assert node_versions(declared(spark, [])).collect() == []
