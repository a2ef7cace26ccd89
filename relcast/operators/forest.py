"""Attribution of a forest's scores, leaf by leaf.

While the features of a background row are replaced by the entity's one after the other, a leaf is reached from the step
at which the last condition that only the entity meets is met, until the first condition that only the background row
meets is lost.  So a tree is walked once per row, over the few leaves that the row reaches at any step, instead of once per
synthetic row; a leaf's value counts for the feature that enters when it is reached and against the one that enters when it is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel


def trees(model) -> list | None:
    """The trees of a random forest as nested tuples: (feature, threshold, left, right), and the leaf's share of the score of each
    class (or of the prediction); None for any other model, or with splits by category."""
    if not isinstance(model, (RandomForestClassificationModel, RandomForestRegressionModel)):
        return None
    classes = isinstance(model, RandomForestClassificationModel)
    n = model.getNumTrees

    def node(j):
        if j.getClass().getSimpleName() == "LeafNode":
            if not classes:
                return np.array([j.prediction() / n])
            stats = np.array(list(j.impurityStats().stats()))
            return stats / stats.sum() / n
        split = j.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("a split by category")
        return split.featureIndex(), split.threshold(), node(j.leftChild()), node(j.rightChild())

    try:
        return [node(t._call_java("rootNode")) for t in model.trees]
    except ValueError:
        return None


def contributions(forest: list, x: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(features, classes): the sum over ``rows`` of each feature's contribution, where row r takes the features of ``x`` in the
    order ``order[r]``."""
    n, k = rows.shape
    place = np.empty_like(order)  # of a feature in the row's order
    np.put_along_axis(place, order, np.broadcast_to(np.arange(k, dtype=order.dtype), order.shape), 1)
    columns, places = [np.ascontiguousarray(c) for c in rows.T], [np.ascontiguousarray(c) for c in place.T]
    first = forest[0]
    while isinstance(first, tuple):
        first = first[2]
    out = np.zeros((k, len(first)))

    def walk(node, at, since, until):
        """Rows ``at`` are here after ``since`` (a place; -1: from the beginning) up to ``until`` (k: to the end)."""
        if not len(at):
            return
        if not isinstance(node, tuple):
            come, go = since >= 0, until < k
            count = np.bincount(order[at[come], since[come]], minlength=k) - np.bincount(order[at[go], until[go]], minlength=k)
            out[:] += np.outer(count, node)
            return
        feature, threshold, left, right = node
        here = columns[feature][at] <= threshold
        p = places[feature][at]
        with_x, other, row_too = (left, right, here) if x[feature] <= threshold else (right, left, ~here)
        later = np.where(row_too, since, np.maximum(since, p))
        keep = later < until
        walk(with_x, at[keep], later[keep], until[keep])
        left_at = np.minimum(until, p)
        keep = ~row_too & (since < left_at)
        walk(other, at[keep], since[keep], left_at[keep])

    for tree in forest:
        walk(tree, np.arange(n), np.full(n, -1, order.dtype), np.full(n, k, order.dtype))
    return out
