"""Hard-negative mining by threshold joins over an inverted index with norm bounds.

Anchors and rows are dealt into blocks, and every pair of blocks is a unit of its own.  In a
unit the rows' dimensions go into inverted lists, strongest first.  A row's last dimensions
stay out of the lists where its norm over them, times that of any anchor, is below the
anchor's threshold: they cannot reach it alone.  Partial scores add up list by list, and a
pair goes when its partial score and the product of the remaining norms miss the threshold.
What is left gets its exact score.

Thresholds begin high and are lowered, round by round, only for anchors whose windows are not
full.  A window is full with its first k rows, so what lies below the threshold cannot
matter; the last threshold is the window's own lower end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
SCALE = 256
BLOCK_ROWS = 16_384
ANCHORS_AT_ONCE = 256
LIST_DIMS = 8  # dimensions that share a list
VERIFY_AT_ONCE = 1 << 16
MOST_NORM = float(1 << 52)  # below it every score is exact in double precision
NO_LIMIT = 1 << 53
POSITIVE_STEPS = (0.75, 0.35)  # thresholds before the last, as parts of the anchor's own squared norm
NEGATIVE_STEPS = (0.5,)  # as parts of the way from a window's lower end to its upper one


def usable(vector: str) -> Column:
    """Not null, and without nulls, not-a-numbers and infinities."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def _suffix_norms(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of rows over their dimensions from each edge on; the last is zero."""
    squares = np.add.reduceat(x * x, edges[:-1], axis=1) if x.shape[1] else np.zeros((len(x), 0))
    tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.column_stack([tails, np.zeros(len(x))]))


def threshold_join(q: np.ndarray, x: np.ndarray, least: np.ndarray, allowed) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores) of every allowed pair with a score of at least ``least[anchor]``.

    ``q`` and ``x`` hold integers as doubles; ``allowed(anchor, rows)`` tells which rows count.
    """
    if not len(q) or not len(x):
        return
    dims = x.shape[1]
    order = np.argsort(-(x * x).sum(axis=0), kind="stable")
    q, x = q[:, order], x[:, order]
    edges = [*range(0, dims, LIST_DIMS), dims] if dims else [0]
    lists = len(edges) - 1
    q_tails, x_tails = _suffix_norms(q, edges), _suffix_norms(x, edges)
    # The least row norm, from each edge on, that can reach some anchor's threshold.  Scores are
    # integers, so half of one is room for rounding.
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(least[:, None] <= 0, 0.0, np.where(q_tails > 0, (least[:, None] - 0.5) / q_tails, np.inf)).min(axis=0)
    covered = x_tails < reach
    listed = np.where(covered.any(axis=1), covered.argmax(axis=1), lists)  # lists that hold the row
    rows = np.argsort(-listed, kind="stable")
    rows = rows[: int((listed > 0).sum())] if lists else rows
    x, x_tails, listed = x[rows], x_tails[rows], listed[rows]
    scores = np.zeros((len(q), len(rows)))
    for g in range(lists):
        held = int((listed > g).sum())
        if not held:
            break
        span = slice(edges[g], edges[g + 1])
        scores[:, :held] += q[:, span] @ x[:held, span].T
        # Remaining norms: those from the next list on, for pairs that have one.
        alive = scores[:, :held] + q_tails[:, g + 1, None] * x_tails[None, :held, g + 1] >= least[:, None] - 0.5
        some = np.flatnonzero(alive.any(axis=0))
        if len(some) * 2 < held:
            # Rows that no anchor can use any more leave the lists.
            keep = np.concatenate([some, np.arange(held, len(rows))])
            rows, x, x_tails, listed, scores = rows[keep], x[keep], x_tails[keep], listed[keep], scores[:, keep]
    left = q_tails[:, listed] * x_tails[np.arange(len(rows)), listed] if lists else 0.0
    candidates = scores + left >= least[:, None] - 0.5
    exact = listed == lists
    for a in range(len(q)):
        found = np.flatnonzero(candidates[a])
        found = found[allowed(a, rows[found])]
        own = scores[a, found]
        open_ = np.flatnonzero(~exact[found])
        for at in range(0, len(open_), VERIFY_AT_ONCE):
            part = open_[at : at + VERIFY_AT_ONCE]
            own[part] = x[found[part]] @ q[a]
        ok = own >= least[a]
        yield a, rows[found[ok]], own[ok].astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores, then smaller ids."""
    some = np.arange(len(scores))
    if len(some) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _matrix(vectors: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    return vectors.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(len(rows), length)


def _lengths(vectors: pa.Array) -> np.ndarray:
    return vectors.value_lengths().to_numpy(zero_copy_only=False)


UNIT = "key bigint, window bigint, other bigint, score bigint"


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int, same: bool) -> DataFrame:
    """(key, window, other, score): the first k rows of every window of every anchor.

    ``anchors`` holds (key, id, label, v, norm, windows: [(window, low, high)]); rows with the
    anchor's label count, or with another one, never those with its id.
    """
    # A row that no anchor's threshold can be reached with is not dealt out at all.
    lowest = F.array_min(F.transform("windows", lambda w: w["low"]))
    reach = F.when(lowest <= 0, F.lit(0.0)).when(F.col("norm") > 0, (lowest - 0.5) / F.col("norm"))
    least_norm = anchors.agg(F.min(reach)).first()[0]
    rows = rows.filter(F.col("norm") >= (float("inf") if least_norm is None else least_norm))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    # Anchors are rows too: both sides get columns of their own.
    left = anchors.select("key", *[F.col(c).alias(f"q_{c}") for c in ("id", "label", "v")], "windows", F.pmod("key", F.lit(anchor_blocks)).alias("q_a"))
    left = left.withColumn("q_d", each(blocks))
    right = rows.select(*[F.col(c).alias(f"x_{c}") for c in ("id", "label", "v")], F.pmod("place", F.lit(blocks)).alias("x_d"))
    right = right.withColumn("x_a", each(anchor_blocks))

    def find(few: pa.Table, many: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "window": [], "other": [], "score": []}
        if few.num_rows and many.num_rows:
            q_all, x_all = few.column("q_v").combine_chunks(), many.column("x_v").combine_chunks()
            keys, q_ids, q_labels = (few.column(c).to_numpy() for c in ("key", "q_id", "q_label"))
            x_ids, x_labels = (many.column(c).to_numpy() for c in ("x_id", "x_label"))
            windows = few.column("windows").to_pylist()
            least = np.array([min(w["low"] for w in ws) for ws in windows], dtype=np.float64)
            q_lengths, x_lengths = _lengths(q_all), _lengths(x_all)
            for length in np.unique(q_lengths).tolist():
                x_rows = np.flatnonzero(x_lengths == length)
                x = _matrix(x_all, x_rows, length)
                # Anchors of like thresholds share an index.
                q_rows = np.flatnonzero(q_lengths == length)
                q_rows = q_rows[np.argsort(least[q_rows], kind="stable")]
                for at in range(0, len(q_rows), ANCHORS_AT_ONCE):
                    some = q_rows[at : at + ANCHORS_AT_ONCE]

                    def allowed(a, found, some=some, x_rows=x_rows):
                        at_row = x_rows[found]
                        return ((x_labels[at_row] == q_labels[some[a]]) == same) & (x_ids[at_row] != q_ids[some[a]])

                    for a, found, scores in threshold_join(_matrix(q_all, some, length), x, least[some], allowed):
                        ids = x_ids[x_rows[found]]
                        for w in windows[some[a]]:
                            inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
                            best = inside[_first(scores[inside], ids[inside], k)]
                            out["key"] += [int(keys[some[a]])] * len(best)
                            out["window"] += [w["window"]] * len(best)
                            out["other"] += ids[best].tolist()
                            out["score"] += scores[best].tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    parts = left.groupBy("q_a", "q_d").cogroup(right.groupBy("x_a", "x_d")).applyInArrow(find, UNIT)
    order = Window.partitionBy("key", "window").orderBy(F.col("score").desc(), "other")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _fill(
    rows: DataFrame, anchors: DataFrame, windows: DataFrame, rounds: int, blocks: int, anchor_blocks: int, k: int, same: bool
) -> DataFrame:
    """``_search`` with falling thresholds; ``windows`` holds (key, window, high, steps), the last step being the lower end."""
    open_, done = windows, None
    for number in range(1, rounds + 1):
        low = F.struct("window", F.element_at("steps", number).alias("low"), "high")
        asked = open_.groupBy("key").agg(F.collect_list(low).alias("windows"))
        found = cut(_search(rows, anchors.join(asked, "key"), blocks, anchor_blocks, k, same))
        if number < rounds:
            full = found.groupBy("key", "window").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).drop("_n")
            open_ = cut(open_.join(full, ["key", "window"], "left_anti"))
            found = found.join(full, ["key", "window"], "left_semi")
        done = found if done is None else done.unionByName(found)
        if number < rounds and open_.isEmpty():
            break
    return done


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | str = "vec_id % 100 = 0",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component c counts as the integer ``floor(scale * c)``; scores are inner products, higher
    first, ties by the smaller id.  An anchor's positives are its first rows of its own label;
    for each of them the negatives are the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, 0 < low < high.

    Nulls: rows without an id, a label or a vector, or whose vector holds a null, a
    not-a-number or an infinity, take no part, nor do those whose squared integer norm is 2^52
    or more, whose scores would not be exact.  Vectors of different lengths have no score.  Rows with
    the anchor's own id are neither its positives nor its negatives.  A repeated row counts
    once as an anchor, and each time as a positive or negative.  An anchor without
    positives, or a positive without rows in its window, gives no rows; an empty table gives
    none.  A label may be of any type that can be compared; it is compared as its text.
    """
    condition = F.expr(anchor) if isinstance(anchor, str) else anchor
    own = vectors.filter(usable(f"`{embedding}`")).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"),
        F.when(F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`").cast("string"))).alias("label"),
        F.transform(f"`{embedding}`", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("w"),
        F.coalesce(condition, F.lit(False)).alias("anchor"),
    )
    squared = F.aggregate("w", F.lit(0.0), lambda total, c: total + c * c)
    own = own.withColumn("squared", squared).filter((F.col("squared") < MOST_NORM) & F.col("id").isNotNull() & F.col("label").isNotNull())
    own = own.select(
        "id", "label", F.transform("w", lambda c: c.cast("int")).alias("v"), F.sqrt("squared").alias("norm"), "squared", "anchor"
    )
    # Places are written with the rows, so every later reading deals them out alike.
    rows = cut(own.withColumn("place", F.monotonically_increasing_id()))
    anchors = rows.filter("anchor").groupBy("id", "label", "v").agg(F.first("norm").alias("norm"), F.first("squared").alias("squared"))
    anchors = cut(anchors.withColumn("key", F.monotonically_increasing_id()))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(2 * cores, -(-rows.count() // BLOCK_ROWS))
    anchor_blocks = max(1, -(-anchors.count() // BLOCK_ROWS))

    def integer(x: Column) -> Column:
        return F.floor(x).cast("bigint")

    steps = [integer(F.col("squared") * part) for part in POSITIVE_STEPS] + [F.lit(-NO_LIMIT).cast("bigint")]
    wanted = anchors.select("key", F.lit(0).cast("bigint").alias("window"), F.lit(NO_LIMIT).cast("bigint").alias("high"), F.array(*steps).alias("steps"))
    chosen = _fill(rows, anchors, wanted, len(steps), blocks, anchor_blocks, positives, True)
    chosen = cut(chosen.select("key", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))

    # Equal scores have equal windows.  A negative score has none: its ends change places.
    scored = chosen.filter("positive_score >= 0").select("key", F.col("positive_score").alias("window")).distinct()
    ends = scored.withColumn("high", F.expr(f"{high} * window div 100")).withColumn("low", F.expr(f"({low} * window + 99) div 100")).filter("low <= high")
    steps = [integer(F.col("low") + (F.col("high") - F.col("low")) * part) for part in NEGATIVE_STEPS] + [F.col("low")]
    wanted = cut(ends.select("key", "window", "high", F.array(*steps).alias("steps")))
    found = _fill(rows, anchors, wanted, len(steps), blocks, anchor_blocks, negatives, False)
    found = found.select("key", F.col("window").alias("positive_score"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        chosen.join(found, ["key", "positive_score"])
        .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
