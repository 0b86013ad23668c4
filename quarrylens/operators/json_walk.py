"""Every value of nested JSON documents as rows, without Python and without a shuffle.

One ``inline`` step per nesting level turns each container into itself plus its
children; rows already expanded pass through.  The number of levels is measured
first, so no value is left out.  Documents stream through row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p

NODE_FIELDS = ("path", "pos", "v", "level")


def bracket_depth(text: Column) -> Column:
    """Deepest nesting of brackets in JSON text, outside string literals."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, zero, step)["top"]


def max_depth(documents: DataFrame, text: str) -> int:
    found = documents.select(F.max(bracket_depth(F.col(text)))).first()[0]
    return int(found or 0)


def walk_json(
    documents: DataFrame,
    keys: Sequence[str],
    text: str,
    *,
    depth: int | None = None,
    leaves: bool = True,
) -> DataFrame:
    """(keys, path, pos, v): one row per value of the JSON text.

    ``path`` writes arrays as ``[]``.  ``pos`` lists the positions from the root, members
    in key order, so sorting by it gives visit order.  Without ``leaves``, values that are
    neither objects nor arrays are dropped once met, but for those of the deepest level.
    """
    depth = max_depth(documents, text) if depth is None else depth
    root = documents.select(
        *keys,
        F.lit("$").alias("path"),
        F.array().cast("array<int>").alias("pos"),
        F.parse_json(F.col(text)).alias("v"),
        F.lit(0).alias("level"),
    )
    for level in range(depth):
        # Containers are opened once, as columns of their own.
        here = F.col("level") == level
        opened = root.withColumn("_members", F.when(here, p.v_object(F.col("v"), "$"))).withColumn(
            "_items", F.when(here & F.col("_members").isNull(), p.v_array(F.col("v"), "$"))
        )
        root = opened.select(*keys, F.inline(_expand(level, leaves)))
    return root.drop("level")


def _node(path, pos, v, level) -> Column:
    values = (path, pos, v, level)
    return F.struct(*[x.alias(n) for x, n in zip(values, NODE_FIELDS, strict=True)])


def _expand(level: int, leaves: bool) -> Column:
    path, pos, v = (F.col(c) for c in ("path", "pos", "v"))
    own = F.array(_node(path, pos, v, F.col("level")))
    members, items = F.col("_members"), F.col("_items")
    below = F.lit(level + 1)

    def member(e: Column, i: Column) -> Column:
        return _node(F.concat(path, F.lit("."), e["key"]), F.concat(pos, F.array(i)), e["value"], below)

    def item(x: Column, i: Column) -> Column:
        return _node(F.concat(path, F.lit("[]")), F.concat(pos, F.array(i)), x, below)

    return (
        F.when(members.isNotNull(), F.concat(own, F.transform(F.map_entries(members), member)))
        .when(items.isNotNull(), F.concat(own, F.transform(items, item)))
        .otherwise(own if leaves else F.when(F.col("level") != level, own))
    )
