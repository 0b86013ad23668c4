"""Ancestor closure and root paths by repeated doubling of the jump length.

A tree of depth d takes about log2(d) rounds, each one an equi join on the node,
instead of d rounds.  Every round is written to the checkpoint folder, because it
reads the previous one twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

MAX_ROUNDS = 24


class CycleError(ValueError):
    """The edges contain a cycle, so sums over descendants are not defined."""


def ancestor_closure(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    node: str,
    child: str,
    parent: str,
    repeated_edges: bool = False,
) -> DataFrame:
    """(keys, descendant, ancestor, paths): every node with itself and its ancestors.

    ``paths`` counts the ways up, so a node under two parents is counted once per
    way, as a recursive sum over children would.  An edge listed twice is one way,
    or two with ``repeated_edges``.
    """
    keys = list(keys)
    reach = nodes.select(
        *keys,
        F.col(node).alias("descendant"),
        F.col(node).alias("ancestor"),
        F.lit(1).cast("bigint").alias("paths"),
    ).distinct()
    jump = (
        edges.filter(F.col(parent).isNotNull())
        .select(*keys, F.col(child).alias("_from"), F.col(parent).alias("_to"))
        .groupBy(*keys, "_from", "_to")
        .agg((F.count(F.lit(1)) if repeated_edges else F.lit(1).cast("bigint")).alias("_ways"))
    )
    jump = cut(jump)
    edge_count = jump.count()
    for round_no in range(MAX_ROUNDS):
        if jump.isEmpty():
            return reach
        if 2**round_no > edge_count:
            break
        step = reach.join(
            jump.withColumnRenamed("_from", "ancestor"), [*keys, "ancestor"]
        ).select(*keys, "descendant", F.col("_to").alias("ancestor"), (F.col("paths") * F.col("_ways")).alias("paths"))
        reach = cut(
            reach.unionByName(step).groupBy(*keys, "descendant", "ancestor").agg(F.sum("paths").alias("paths"))
        )
        second = jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_ways").alias("_more"))
        jump = cut(
            jump.join(second, [*keys, "_to"])
            .groupBy(*keys, "_from", F.col("_next").alias("_to"))
            .agg(F.sum(F.col("_ways") * F.col("_more")).alias("_ways"))
        )
    if jump.isEmpty():
        return reach
    raise CycleError("edges form a cycle")


def subtree_sums(
    values: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    node: str,
    child: str,
    parent: str,
    columns: Sequence[str],
    repeated_edges: bool = False,
) -> DataFrame:
    """(keys, node, columns): ``columns`` summed over each node and everything below it.

    Only nodes with values and their ancestors have a row.  A round adds to each node what the
    nodes exactly 2**k below it have gathered so far, so a tree of n nodes and depth d writes
    about n rows in each of log2(d) rounds, never the pairs of nodes and ancestors.  Several
    ways up count as in :func:`ancestor_closure`.
    """
    keys = list(keys)
    jump = cut(
        edges.filter(F.col(parent).isNotNull())
        .select(*keys, F.col(child).alias("_from"), F.col(parent).alias("_to"))
        .groupBy(*keys, "_from", "_to")
        .agg((F.count(F.lit(1)) if repeated_edges else F.lit(1).cast("bigint")).alias("_ways"))
    )
    edge_count = jump.count()
    total = values.select(*keys, node, *columns)
    for round_no in range(MAX_ROUNDS):
        if jump.isEmpty():
            return total
        if 2**round_no > edge_count:
            break
        lifted = total.join(jump.withColumnRenamed("_from", node), [*keys, node]).select(
            *keys, F.col("_to").alias(node), *[(F.col(c) * F.col("_ways")).alias(c) for c in columns]
        )
        total = cut(total.unionByName(lifted).groupBy(*keys, node).agg(*[F.sum(c).alias(c) for c in columns]))
        second = jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_ways").alias("_more"))
        jump = cut(
            jump.join(second, [*keys, "_to"])
            .groupBy(*keys, "_from", F.col("_next").alias("_to"))
            .agg(F.sum(F.col("_ways") * F.col("_more")).alias("_ways"))
        )
    if jump.isEmpty():
        return total
    raise CycleError("edges form a cycle")


def root_paths(
    versions: DataFrame, keys: Sequence[str], node: str, parent: str, label: str, since: str, until: str
) -> DataFrame:
    """Root-to-node paths of trees whose nodes may be redefined over time.

    ``versions`` holds for each node its parent and label in the half-open period
    [since, until); the periods of one node do not overlap.  The result has one row
    per node and period in which its whole path is constant: ``ids`` and ``labels``
    from the root down to the node.  A path stops where it would repeat a node.
    """
    keys = list(keys)
    piece = versions.select(
        *keys,
        F.col(node).alias("node"),
        F.col(since).alias("since"),
        F.col(until).alias("until"),
        F.col(parent).alias("up"),
        F.array(F.col(node)).alias("ids"),
        F.array(F.col(label)).alias("labels"),
    )
    piece = cut(
        piece.withColumn(
            "up", F.when(~F.array_contains(F.col("ids"), F.col("up")), F.col("up"))
        )
    )
    for _ in range(MAX_ROUNDS):
        opened = piece.filter(F.col("up").isNotNull())
        if opened.isEmpty():
            return piece.drop("up")
        above = piece.select(
            *keys,
            F.col("node").alias("up"),
            F.col("since").alias("a_since"),
            F.col("until").alias("a_until"),
            F.col("up").alias("a_up"),
            F.col("ids").alias("a_ids"),
            F.col("labels").alias("a_labels"),
        )
        joined = opened.join(above, [*keys, "up"]).filter(
            (F.col("a_since") < F.col("until")) & (F.col("since") < F.col("a_until"))
        )
        # Keep the part of the upper path below the last node already on this path.
        seen = F.transform(F.col("a_ids"), lambda x: F.array_contains(F.col("ids"), x))
        cut_at = F.size(seen) - F.coalesce(
            F.nullif(F.array_position(F.reverse(seen), True), F.lit(0)) - 1, F.size(seen)
        )
        closed = (cut_at > 0) | F.array_contains(F.col("ids"), F.col("a_up"))
        measured = joined.select(
            *keys,
            "node",
            F.greatest("since", "a_since").alias("since"),
            F.least("until", "a_until").alias("until"),
            F.when(~F.coalesce(closed, F.lit(False)), F.col("a_up")).alias("up"),
            (cut_at + 1).cast("int").alias("_first"),
            (F.size("a_ids") - cut_at).cast("int").alias("_kept"),
            F.col("ids").alias("low_ids"),
            F.col("labels").alias("low_labels"),
            "a_ids",
            "a_labels",
        )
        first, kept = F.col("_first"), F.col("_kept")
        extended = measured.select(
            *keys,
            "node",
            "since",
            "until",
            "up",
            F.concat(F.slice("a_ids", first, kept), "low_ids").alias("ids"),
            F.concat(F.slice("a_labels", first, kept), "low_labels").alias("labels"),
        )
        piece = cut(piece.filter(F.col("up").isNull()).unionByName(extended))
    raise CycleError("paths deeper than 2**%d" % MAX_ROUNDS)
