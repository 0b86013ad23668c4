"""A small binary decision tree, grown by Gini impurity on a labelled table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Tree = tuple  # (feature, limit, below, above) or a share of the positive label


def grow(rows: np.ndarray, labels: np.ndarray, depth: int, least: int = 1) -> Tree | float:
    """The tree of ``rows`` (one column per feature) for labels 0 and 1.

    A split sends rows with feature <= limit below.  Limits lie midway between neighbouring
    values; of equally good splits the first feature and lowest limit is taken.
    """
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return share
    best = None
    for feature in range(rows.shape[1]):
        order = np.argsort(rows[:, feature], kind="stable")
        values, ones = rows[order, feature], np.cumsum(labels[order])
        n = len(values)
        cut = np.flatnonzero(values[1:] > values[:-1]) + 1
        cut = cut[(cut >= least) & (n - cut >= least)]
        if not len(cut):
            continue
        low, high = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (n - cut)
        impurity = (cut * low * (1 - low) + (n - cut) * high * (1 - high)) / n
        at = int(np.argmin(impurity))
        if best is None or impurity[at] < best[0] - 1e-12:
            best = (impurity[at], feature, float(values[cut[at] - 1] + values[cut[at]]) / 2)
    if best is None or best[0] >= share * (1 - share) - 1e-12:
        return share
    _, feature, limit = best
    below = rows[:, feature] <= limit
    return (feature, limit, grow(rows[below], labels[below], depth - 1, least), grow(rows[~below], labels[~below], depth - 1, least))


def decide(tree: Tree | float, row: Sequence[float]) -> float:
    """The share of the positive label in the leaf that ``row`` falls into."""
    while isinstance(tree, tuple):
        feature, limit, below, above = tree
        tree = below if row[feature] <= limit else above
    return tree
