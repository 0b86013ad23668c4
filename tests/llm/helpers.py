"""Plain versions of the operators' parts, and frames with odd rows."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """Documents of (doc_id, text[, lang[, source]])."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def components(nodes, links):
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}
    for a, b in links:
        x, y = find(up, a), find(up, b)
        up[max(x, y)] = min(x, y)
    return {n: find(up, n) for n in nodes}


def prose(rng, words, vocabulary=400):
    """Random sentences on several lines."""
    out = []
    while words > 0:
        n = min(words, rng.randint(3, 14))
        out.append(" ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n)).capitalize() + ".")
        words -= n
    lines, at = [], 0
    while at < len(out):
        n = rng.randint(1, 4)
        lines.append(" ".join(out[at : at + n]))
        at += n
    return "\n".join(lines)
