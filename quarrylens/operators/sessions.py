"""Sessions split by a quiet gap and capped in length.

A new session starts after a gap longer than ``gap`` or once a row lies more than
``max_span`` after the start of its session.  The cap restarts at each session, so
it is not a window function.  Nothing here folds a whole key in one task:

* rows are first summed per distinct time;
* gaps are found between cells of width ``gap`` (no gap fits inside a cell), so the
  only window over a key runs on one row per occupied cell;
* inside a long stretch, each time points to the first time past its cap, and the
  session starts are found by doubling that pointer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

MAX_ROUNDS = 32


def _stretches(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, cell, seg, seg_end): the gap-free stretch each time cell belongs to."""
    cells = points.groupBy(*keys, "cell").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("cell")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("hi").over(order)
    starts = F.when(before.isNull() | (F.col("lo") - before > gap), F.col("lo"))
    marked = cells.withColumn("start", starts).withColumn("seg", F.max("start").over(upto))
    ends = marked.groupBy(*keys, "seg").agg(F.max("hi").alias("seg_end"))
    return marked.select(*keys, "cell", "seg").join(ends, [*keys, "seg"])


def _pointers(points: DataFrame, keys: list[str], gap: int, max_span: int) -> DataFrame:
    """(keys, seg, ts, nxt): first time more than ``max_span`` after ``ts``.

    A stretch has no gap above ``gap``, so that time is at most ``gap`` further on.
    Times are also handed to the previous cell when a frame there can reach them.
    """
    reach = max_span + gap
    width = 8 * (reach + 1)
    own = F.floor(F.col("ts") / width)
    earliest = F.floor((F.col("ts") - reach) / width)
    copies = points.select(*keys, "seg", "ts", own.alias("own"), F.explode(F.sequence(earliest, own)).alias("block"))
    # Frames count whole units; times with fractions are taken in thousandths.
    parts = 1 if points.schema["ts"].dataType.typeName() in ("long", "integer") else 1000
    place = F.round(F.col("ts") * parts).cast("bigint")
    frame = Window.partitionBy(*keys, "seg", "block").orderBy(place).rangeBetween(max_span * parts + 1, reach * parts)
    return (
        copies.withColumn("nxt", F.min("ts").over(frame))
        .filter((F.col("own") == F.col("block")) & F.col("nxt").isNotNull())
        .select(*keys, "seg", "ts", "nxt")
    )


def _capped_starts(points: DataFrame, keys: list[str], gap: int, max_span: int) -> DataFrame:
    """(keys, seg, start) for every session of the given long stretches."""
    starts = points.select(*keys, "seg", F.col("seg").alias("start")).distinct()
    jump = cut(_pointers(points, keys, gap, max_span))
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            return starts
        landed = starts.join(
            jump.withColumnRenamed("ts", "start"), [*keys, "seg", "start"]
        ).select(*keys, "seg", F.col("nxt").alias("start"))
        starts = cut(starts.unionByName(landed).distinct())
        second = jump.select(*keys, "seg", F.col("ts").alias("nxt"), F.col("nxt").alias("after"))
        jump = cut(
            jump.join(second, [*keys, "seg", "nxt"]).select(*keys, "seg", "ts", F.col("after").alias("nxt"))
        )
    raise ValueError("stretch longer than 2**%d sessions" % MAX_ROUNDS)


def capped_sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap: int,
    max_span: int,
    sums: dict[str, Column],
) -> DataFrame:
    """One row per session: keys, ``start_ts``, ``last_ts`` and each summed column."""
    keys = list(keys)
    points = (
        df.groupBy(*keys, F.col(ts).alias("ts"))
        .agg(*[F.sum(value).alias(name) for name, value in sums.items()])
        .withColumn("cell", F.floor(F.col("ts") / gap))
    )
    placed = cut(points.join(_stretches(points, keys, gap), [*keys, "cell"]).drop("cell"))
    is_long = F.col("seg_end") - F.col("seg") > max_span
    assigned = placed.filter(~is_long).withColumn("start", F.col("seg"))
    long_points = placed.filter(is_long)
    if not long_points.isEmpty():
        width = max_span + 1
        starts = (
            _capped_starts(long_points, keys, gap, max_span)
            .withColumn("block", F.floor(F.col("start") / width))
            .withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
        )
        # Starts of one stretch are more than max_span apart: exactly one matches.
        capped = (
            long_points.withColumn("block", F.floor(F.col("ts") / width))
            .join(starts, [*keys, "seg", "block"])
            .filter((F.col("start") <= F.col("ts")) & (F.col("ts") - F.col("start") <= max_span))
            .drop("block")
        )
        assigned = assigned.unionByName(capped.select(*assigned.columns))
    return assigned.groupBy(*keys, F.col("start").alias("start_ts")).agg(
        F.max("ts").alias("last_ts"), *[F.sum(name).alias(name) for name in sums]
    )
