"""Point-in-interval and overlap joins as equi joins on time cells.

Every interval is put on the grid level whose cells are about as wide as the
interval, so it covers at most ``FANOUT + 1`` cells whatever its length.  A point
has one cell on each level in use.  The join is then an equality on
(keys, level, cell) followed by the exact test, which hash and sort-merge joins
and adaptive skew splitting all handle; no pair meets twice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.large_join import FEW_ROWS, counted_join
from quarrylens.operators.lineage import cut

FANOUT = 16
BASE_WIDTH = 1024
MAX_LEVEL = 11
TASK_PAIRS = 1 << 19
# What a tested pair costs, next to a row that is shuffled.
PAIR_COST = 1 / 16
# Columns that ``spread_range_join`` keeps: its tasks are spread by the keys and these.
CELL = ("_cell", "_piece")


@dataclass(frozen=True)
class IntervalStats:
    """What one small aggregate over the interval side tells about it."""

    rows: int
    levels: tuple[int, ...]
    # (level, rows, summed lengths)
    spans: tuple[tuple[int, int, float], ...] = ()


@dataclass(frozen=True)
class PointStats:
    """How many points there are, from when to when, and about how many keys they have.

    ``groups``: about how many groups a key's points are summed in for each interval, 0 where they are not.
    """

    rows: int
    low: float | None
    high: float | None
    keys: int
    groups: float = 0.0


def _level(length: Column) -> Column:
    """Smallest level whose FANOUT cells are at least as long as ``length``."""
    out = None
    for level in range(MAX_LEVEL):
        test = length <= BASE_WIDTH * FANOUT ** (level + 1)
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(MAX_LEVEL)


def _cell(ts: Column, level: Column) -> Column:
    width = F.lit(BASE_WIDTH).cast("double") * F.pow(F.lit(float(FANOUT)), level)
    return F.floor(ts / width)


def interval_stats(intervals: DataFrame, start: str, end: str) -> IntervalStats:
    """Row count and grid levels in use (at most ``MAX_LEVEL + 1`` result rows)."""
    rows = (
        intervals.filter(F.col(end) >= F.col(start))
        .groupBy(_level(F.col(end) - F.col(start)).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(end) - F.col(start)).cast("double")).alias("length"))
        .collect()
    )
    spans = tuple(sorted((r["level"], r["n"], r["length"]) for r in rows))
    return IntervalStats(sum(x[1] for x in spans), tuple(x[0] for x in spans), spans)


def point_stats(points: DataFrame, keys: Sequence[str], ts: str, groups: Sequence[str] = ()) -> PointStats:
    """One small aggregate over the points, which are summed by ``groups`` after the join."""
    at = F.col(ts).cast("double")
    about = [F.approx_count_distinct(F.struct(*x)) for x in (keys, [*keys, *groups])]
    row = points.agg(F.count(F.lit(1)), F.min(at), F.max(at), *about).first()
    n_keys = max(1, row[3])
    return PointStats(row[0], row[1], row[2], n_keys, max(1.0, row[4] / n_keys) if groups else 0.0)


def placed_levels(stats: IntervalStats, points: PointStats) -> tuple[dict[int, int], float]:
    """The level on whose cells each level's intervals are put, and the rows and pairs to expect.

    Points have a row for each level in use, so a level of few intervals is given up: they go on wider
    cells, with more pairs to test, or on those of the level below, with at most ``(FANOUT + 1) * FANOUT``
    rows each.  Where points are summed, each cell of an interval has sums of its own, fewer in wide cells.
    Points are taken to be spread evenly over keys and time.
    """
    same = {level: level for level in stats.levels}
    if not points.rows or points.low is None or not math.isfinite(points.high - points.low):
        return same, math.inf
    density = points.rows / points.keys / max(points.high - points.low, 1.0)

    def on(span: tuple[int, int, float], level: int) -> tuple[float, float, float]:
        """Rows, sums and pairs of a level's intervals on the cells of a level."""
        _, n, length = span
        width = float(BASE_WIDTH) * FANOUT**level
        rows = n + length / width
        sums = -points.groups * rows * math.expm1(-density * length / rows / points.groups) if points.groups else 0.0
        return rows, sums, density * (length + n * width)

    def weigh(levels: tuple[int, ...]) -> tuple[float, dict[int, int], float]:
        cost = expected = float(points.rows * len(levels))
        placed = {}
        for span in stats.spans:
            least = span[0] - (span[0] < MAX_LEVEL)
            found = [
                (rows + sums + PAIR_COST * pairs, level, rows + pairs)
                for level in levels
                if level >= least
                for rows, sums, pairs in [on(span, level)]
            ]
            if not found:
                return math.inf, same, math.inf
            own, placed[span[0]], both = min(found)
            cost, expected = cost + own, expected + both
        return cost, placed, expected

    sets = [x for n in range(1, len(stats.levels) + 1) for x in combinations(stats.levels, n)]
    _, placed, expected = min((weigh(x) for x in sets), key=lambda x: x[0], default=(0.0, same, math.inf))
    return placed, expected


def measure(intervals: DataFrame, start: str, end: str) -> tuple[DataFrame, IntervalStats]:
    """The intervals written once, and their stats; what made them is not run again."""
    written = cut(intervals)
    return written, interval_stats(written, start, end)


def _on_cells(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    stats: IntervalStats,
    placed: Mapping[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Points with their cell of each level, and intervals with the cells that they cover."""
    level = _level(F.col(end) - F.col(start))
    placed = placed or {x: x for x in stats.levels}
    if any(x != y for x, y in placed.items()):
        level = F.coalesce(*[F.when(level == x, y) for x, y in placed.items()])
    cells = F.sequence(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level")))
    spread = (
        intervals.filter(F.col(end) >= F.col(start))
        .withColumn("_level", level)
        .withColumn("_cell", F.explode(cells))
    )
    levels = sorted(set(placed.values())) or [0]
    probes = points.filter(F.col(ts).isNotNull())
    if len(levels) == 1:
        probes = probes.withColumn("_level", F.lit(levels[0]))
    else:
        probes = probes.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    probes = probes.withColumn("_cell", _cell(F.col(ts), F.col("_level")))
    return probes, spread


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    *,
    stats: IntervalStats | None = None,
    left_open: bool = False,
) -> DataFrame:
    """Rows of ``points`` and ``intervals`` with equal keys and start <= ts <= end.

    Column names other than ``keys`` must differ.  ``left_open`` tests start < ts.
    Both sides are shuffled, as sizes are only guessed; intervals counted to be few are hashed, not sorted.
    """
    if stats is None:
        intervals, stats = measure(intervals, start, end)
    probes, spread = _on_cells(points, intervals, ts, start, end, stats)
    inside = (F.col(ts) > F.col(start)) if left_open else (F.col(ts) >= F.col(start))
    return (
        probes.join(spread.hint("shuffle_hash" if stats.rows <= FEW_ROWS else "merge"), [*keys, "_level", "_cell"])
        .filter(inside & (F.col(ts) <= F.col(end)))
        .drop("_level", "_cell")
    )


def spread_range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    *,
    task_pairs: int | None = None,
    known_points: PointStats | None = None,
) -> tuple[DataFrame, int]:
    """The same, over tasks of about ``task_pairs`` rows and pairs at most, and how many those are.

    A task of so many bytes may make any number of pairs, so rows and pairs are counted for each
    cell first, and ``points`` are read twice.  A cell with too many of them is cut into pieces: of
    its intervals, each with all points, and where that would repeat too many points, of both sides.
    The rows keep ``CELL``: a group that has the keys and these needs no exchange.  Few levels are
    used (see :func:`placed_levels`); where the cells so made hold far more pairs than expected, all are.
    """
    task_pairs = task_pairs or TASK_PAIRS
    intervals, stats = measure(intervals, start, end)
    known_points = known_points or point_stats(points, keys, ts)
    cell = [*keys, "_cell"]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    weight = F.col("_p") * F.col("_i") + F.col("_p") + F.col("_i")
    wanted = F.ceil(F.col("_weight") / task_pairs)
    n_intervals = F.greatest("_i", one)
    # A piece of points repeats its intervals, and the sums that each of them has.
    by_points = F.round(F.sqrt(wanted * F.col("_p") / (n_intervals * (1 + known_points.groups))))
    by_points = F.greatest(F.ceil(wanted / n_intervals), by_points, one)
    large = F.struct(*cell, by_points.cast("bigint").alias("_a"), F.ceil(wanted / by_points).cast("bigint").alias("_b"))

    def on_cells(placed: Mapping[int, int] | None) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
        probes, spread = _on_cells(points, intervals, ts, start, end, stats, placed)
        # One number for level and cell: no constant key, which Spark would leave out of the join and then shuffle again.
        place = F.col("_cell") * (MAX_LEVEL + 1) + F.col("_level")
        probes, spread = (side.withColumn("_cell", place).drop("_level") for side in (probes, spread))
        sides = probes.select(*cell, one.alias("_p"), none.alias("_i")).unionByName(
            spread.select(*cell, none.alias("_p"), one.alias("_i"))
        )
        # One row for all cells that need no cut, and one for each other cell.
        counted = cut(
            sides.groupBy(*cell)
            .agg(F.sum("_p").alias("_p"), F.sum("_i").alias("_i"))
            .withColumn("_weight", weight)
            .groupBy(F.when((wanted > 1) & (F.col("_p") > 0) & (F.col("_i") > 0), large).alias("_large"))
            .agg(F.sum("_weight").alias("_weight"))
        )
        total, cuts = counted.agg(F.sum("_weight"), F.count("_large")).first()
        return probes, spread, counted, total or 0, cuts

    placed, expected = placed_levels(stats, known_points)
    found = on_cells(placed)
    if len(set(placed.values())) < len(placed) and found[3] > FANOUT * expected + task_pairs:
        found = min(found, on_cells(None), key=lambda x: x[3])
    probes, spread, counted, total, cuts = found
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-total // task_pairs))
    if cuts:
        known = counted.filter(F.col("_large").isNotNull()).select("_large.*")

        def cut_side(rows: DataFrame, own: str, other: str) -> DataFrame:
            own_piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(own, one))
            copies = F.explode(F.sequence(none, F.coalesce(other, one) - 1))
            pieces = counted_join(rows, known, cell, cuts, "left").withColumn("_own", own_piece).withColumn("_copy", copies)
            of_points, of_intervals = ("_own", "_copy") if own == "_a" else ("_copy", "_own")
            piece = F.col(of_points) * F.coalesce("_b", one) + F.col(of_intervals)
            return pieces.withColumn("_piece", piece).select(*rows.columns, "_piece")

        probes, spread = cut_side(probes, "_a", "_b"), cut_side(spread, "_b", "_a")
    on = [*cell, "_piece"] if cuts else cell
    probes, spread = probes.repartition(tasks, *on), spread.repartition(tasks, *on)
    pairs = probes.join(spread.hint("shuffle_hash" if stats.rows <= FEW_ROWS else "merge"), on)
    pairs = pairs if cuts else pairs.withColumn("_piece", none)
    return pairs.filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))), tasks


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
) -> DataFrame:
    """Pairs of closed intervals that share a point.

    Either the left start lies in the right interval, or the right start lies
    strictly after the left start and inside the left interval; never both.
    """
    left_start, left_end = left_span
    right_start, right_end = right_span
    left_ok, left_stats = measure(
        left.filter(F.col(left_end) >= F.col(left_start)), left_start, left_end
    )
    right_ok, right_stats = measure(
        right.filter(F.col(right_end) >= F.col(right_start)), right_start, right_end
    )
    starts_inside = range_join(
        left_ok, right_ok, keys, left_start, right_start, right_end, stats=right_stats
    )
    covers_start = range_join(
        right_ok,
        left_ok,
        keys,
        right_start,
        left_start,
        left_end,
        stats=left_stats,
        left_open=True,
    )
    return starts_inside.unionByName(covers_start.select(*starts_inside.columns))
