"""Groups cut into bounded units, and streams of whole units inside a task.

Rows of one key are to be compared pairwise.  A key of many rows is cut into blocks; every
pair of blocks is a unit of its own, so no task holds a whole hot group and no pair is lost.
A key of few rows is one unit.  Tasks read their units sorted, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import broadcast_if_small
from quarrylens.operators.lineage import cut

BLOCK_ROWS = 1024
GATHER_ROWS = 32_768


def to_units(rows: DataFrame, key: str, row_id: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``ua <= ub``, the unit's blocks, and ``side``, the row's own block.

    A key with n blocks repeats each of its rows n times; the keys with more than one are
    counted first and are few: a row of theirs stands for at least ``block_rows`` others.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.filter(F.col("_rows") > block_rows)
    hot = broadcast_if_small(cut(hot.select(key, F.ceil(F.col("_rows") / block_rows).cast("int").alias("_blocks"))))
    placed = rows.join(hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.withColumn("ua", F.least("side", "_other")).withColumn("ub", F.greatest("side", "_other"))
    placed = placed.drop("_blocks", "_other")
    return placed.repartition(key, "ua", "ub").sortWithinPartitions(key, "ua", "ub", row_id)


def unit_starts(table: pa.Table, key: str) -> np.ndarray:
    """Where the units of sorted rows begin."""
    columns = [table.column(c).to_numpy() for c in (key, "ua", "ub")]
    change = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        change[0] = True
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def whole_units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete units with the units' first rows; a table has about GATHER_ROWS rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= GATHER_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = unit_starts(table, key)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
            held = table.slice(last).to_batches()
            size = table.num_rows - last
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, unit_starts(table, key)


def near_pairs(starts: np.ndarray, side: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) to compare, at growing distance: vectors over all units at once.

    In a unit of two blocks only rows of different blocks are compared; the others meet in
    the units of their own block.
    """
    n = len(side)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    i = np.arange(n)
    d = 1
    while True:
        i = i[i + d < ends[i]]
        if not len(i):
            return
        j = i + d
        ok = ~crossing[i] | (side[i] != side[j])
        yield i[ok], j[ok]
        d += 1


class Forest:
    """Union-find over a task's rows; ``roots`` can be compared as a whole array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            upper = self.up[self.up]
            if (upper == self.up).all():
                return self.up
            self.up = upper

    def _find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join rows pairwise; pairs already joined cost one array comparison."""
        if not len(i):
            return
        roots = self.roots()
        apart = roots[i] != roots[j]
        for a, b in zip(roots[i[apart]].tolist(), roots[j[apart]].tolist(), strict=True):
            x, y = self._find(a), self._find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)


