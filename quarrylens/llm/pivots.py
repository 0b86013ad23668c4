"""Embedding near-dedup with a pivot-permutation index.

Reference vectors (pivots) are drawn from the table.  A vector is described by its nearest
pivots in order, the head of its permutation.  Each pivot's inverted list holds the vectors
whose head names it.  Two vectors that share enough pivots of their heads (any one, unless more
are asked for) are candidates, and a candidate is linked if its cosine, in double precision,
reaches the threshold.  A pair that
several lists hold counts only in that of its smallest shared pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.graph import components
from quarrylens.llm.units import Forest, to_units, whole_units
from quarrylens.operators.lineage import cut

COSINE = 0.9
HEAD = 8
# Two vectors of one list are compared anyway; asking for more shared pivots would drop found links.
SHARED = 1
LEAST_PIVOTS = 64
MOST_PIVOTS = 1 << 15
PAIRS_AT_ONCE = 1 << 18
COSINES_AT_ONCE = 1 << 22


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors of one length as rows of length one, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    # Scaled by the largest component first, so that no square overflows or vanishes.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: str):
    """A vector that has a direction: not null, no null, not-a-number or infinite part, not all zero."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def pivot_count(vectors: int) -> int:
    """About the square root of the table's size, within fixed bounds."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << round(np.log2(max(vectors, 1)) / 2)))


def link_classes(classes: DataFrame, pivots: np.ndarray, cosine: float, head: int, shared: int) -> DataFrame:
    """(node, links, root) from (node, weight, vector): weighted link counts and a spanning forest, in parts.

    A class meets others unit by unit; its rows are to be summed, its roots to be connected.
    """
    head = min(head, len(pivots))
    shared = min(shared, head)

    def nearest(vectors: np.ndarray) -> np.ndarray:
        far = -(vectors @ pivots.T)
        top = np.argpartition(far, head - 1, axis=1)[:, :head]
        order = np.argsort(np.take_along_axis(far, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1).astype(np.int32)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, step = unit_rows(batch.column(2)), max(1, COSINES_AT_ONCE // len(pivots))
            heads = np.concatenate([nearest(vectors[at : at + step]) for at in range(0, len(vectors), step)])
            rows = np.repeat(np.arange(len(heads)), head)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(heads.ravel()), head).cast(pa.list_(pa.int32()))
            columns = [pa.array(heads.ravel()), *[c.take(pa.array(rows)) for c in batch.columns], listed.take(pa.array(rows))]
            for at in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays(
                    [c.slice(at, 8192) for c in columns], names=["pivot", "node", "weight", "vector", "head"]
                )

    def hits(a: np.ndarray, b: np.ndarray, heads: np.ndarray, i0: int, j0: int, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of two runs of rows for which this list is the one to count them."""
        i, j = np.nonzero(a @ b.T >= cosine)
        i, j = i + i0, j + j0
        ahead = i < j
        i, j = i[ahead], j[ahead]
        found = []
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x, y = heads[i[at : at + PAIRS_AT_ONCE]], heads[j[at : at + PAIRS_AT_ONCE]]
            common = (x[:, :, None] == y[:, None, :]).any(axis=2)
            least = np.where(common, x, np.iinfo(np.int32).max).min(axis=1)
            found.append((common.sum(axis=1) >= shared) & (least == pivot))
        ok = np.concatenate(found) if found else np.zeros(0, dtype=bool)
        return i[ok], j[ok]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_units(batches, "pivot"):
            nodes, weights = table.column("node").to_numpy(), table.column("weight").to_numpy()
            rows = unit_rows(table.column("vector").combine_chunks())
            heads = table.column("head").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            side, pivot = table.column("side").to_numpy(), table.column("pivot").to_numpy()
            crossing = table.column("ua").to_numpy() != table.column("ub").to_numpy()
            links = np.zeros(len(nodes), dtype=np.int64)
            forest = Forest(len(nodes))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True):
                if crossing[low]:  # the unit's rows are sorted by node: bring the two blocks apart
                    order = low + np.argsort(side[low:high], kind="stable")
                    middle = low + int((side[low:high] == side[low:high].min()).sum())
                    own, others = order[: middle - low], order[middle - low :]
                else:
                    own = others = np.arange(low, high)
                if not len(own) or not len(others):
                    continue
                if crossing[low]:
                    both = np.concatenate([own, others])
                    i, j = hits(rows[own], rows[others], heads[both], 0, len(own), pivot[low])
                    i, j = both[i], both[j]
                else:
                    i, j = hits(rows[own], rows[own], heads[own], 0, 0, pivot[low])
                    i, j = own[i], own[j]
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                forest.join(i, j)
            roots = forest.roots()
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[roots[some]])], names=["node", "links", "root"]
            )

    kind = classes.schema["vector"].dataType.simpleString()
    lists = classes.select("node", "weight", "vector").mapInArrow(
        describe, f"pivot int, node bigint, weight bigint, vector {kind}, head array<int>"
    )
    return to_units(lists, "pivot", "node").mapInArrow(compare, "node bigint, links bigint, root bigint")


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    head: int = HEAD,
    shared: int = SHARED,
    pivots: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an id.

    Equal vectors are one class of known size; the index holds one entry for each class.  The
    pivots are the vectors with the smallest hashes of their ids, ``pivot_count`` of them: a
    bounded sample that the driver sends to the tasks.

    Nulls: a vector that is null, empty, all zero, or holds a null or a non-finite number links
    with nothing, and vectors of different lengths never link.  Rows without an id are left
    out.  A repeated row is another vector of the same id, linked with the first.  An empty
    table gives no rows.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").alias("vector"))
    rows = rows.filter("vec_id is not null")
    fine = rows.filter(usable("vector"))
    classes = cut(
        fine.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    ).withColumn("_length", F.size("vector"))
    parts = None
    for length, count in sorted(tuple(x) for x in classes.groupBy("_length").count().collect()):
        same = classes.filter(F.col("_length") == length).drop("_length")
        sample = same.orderBy(F.xxhash64("node"), "node").limit(pivots or pivot_count(count)).select("vector").toArrow()
        found = link_classes(same, unit_rows(sample.column(0).combine_chunks()), cosine, head, shared)
        parts = found if parts is None else parts.unionByName(found)
    out = classes.select("node", "weight", "vector")
    if parts is None:
        ids = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return ids.withColumn("kept", F.lit(True))
    parts = cut(parts)
    counts = parts.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("_links"))
    groups = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        out.join(counts, F.col("node") == F.col("_n"), "left")
        .drop("_n")
        .join(groups.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g"), "left")
        .select(
            F.col("vector").alias("_vector"),
            (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = fine.join(cut(named), F.col("vector") == F.col("_vector")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable("vector"), F.lit(False))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
