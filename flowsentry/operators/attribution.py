"""Exact Shapley attribution of boosted trees, for every row of a table.

A tree is a sum over its leaves, and the game of one leaf is a product over the
features on its path: 1 or 0 if the row follows the path, else the share of
training rows that does (the path-dependent expectation of Lundberg et al. 2018).
A leaf has at most `maxDepth` features, so its Shapley values are closed sums. The
tree table is small and fixed by the model; Spark partitions the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.boosting import BoostedTrees


def _leaves(node, path: dict, share: float, weight: float) -> Iterator[tuple[float, dict]]:
    """(value, {feature: [low, high, share]}) of every leaf below a JVM tree node."""
    if node.numDescendants() == 0:
        yield weight * node.prediction(), path
        return
    split = node.split()
    f, t = split.featureIndex(), split.threshold()
    total = node.impurityStats().count()
    for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, kept = path.get(f, (float("-inf"), float("inf"), 1.0))
        bounds = (low, min(high, t)) if is_left else (max(low, t), high)
        part = child.impurityStats().count() / total if total else 0.0
        yield from _leaves(child, {**path, f: (*bounds, kept * part)}, share * part, weight)


def tree_leaves(booster) -> list[tuple[float, dict]]:
    """All leaves of a fitted gradient-boosted model, own or MLlib's; the count is bounded by its size."""
    if isinstance(booster, BoostedTrees):
        return booster.leaves()
    found = []
    for tree, weight in zip(booster.trees, booster.treeWeights):
        found.extend(_leaves(tree._java_obj.rootNode(), {}, 1.0, weight))
    return found


def leaf_shapley(leaves: list[tuple[float, dict]], x: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of the summed leaf games."""
    phi = np.zeros_like(x, dtype=float)
    for value, path in leaves:
        features = list(path)
        d = len(features)
        if d == 0:
            continue
        follows = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in features]).astype(float)
        share = np.array([path[f][2] for f in features])
        for i, f in enumerate(features):
            # polynomial over the other features: coefficient s = sum over coalitions of size s
            poly = [np.ones(len(x))]
            for j in range(d):
                if j == i:
                    continue
                grown = [np.zeros(len(x)) for _ in range(len(poly) + 1)]
                for s, c in enumerate(poly):
                    grown[s] = grown[s] + c * share[j]
                    grown[s + 1] = grown[s + 1] + c * follows[j]
                poly = grown
            weighted = sum(c / (d * comb(d - 1, s)) for s, c in enumerate(poly))
            phi[:, f] += value * (follows[i] - share[i]) * weighted
    return phi


def expected_margin(leaves: list[tuple[float, dict]]) -> float:
    return float(sum(value * np.prod([p[2] for p in path.values()]) for value, path in leaves))


def tree_contributions(df: DataFrame, columns: list[str], booster) -> DataFrame:
    """Add `contributions`: feature, value and Shapley value of the margin, per row."""
    leaves = tree_leaves(booster)

    @F.pandas_udf("array<double>")
    def shapley(x: pd.Series) -> pd.Series:
        return pd.Series(list(leaf_shapley(leaves, np.stack(x.to_numpy()))))

    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    zipped = F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("contribution"))
    return (
        df.withColumn("_x", values)
        .withColumn("_phi", shapley("_x"))
        .withColumn("contributions", F.transform(zipped, lambda s: F.struct(s[F.lit("feature")].alias("feature"), s["value"].alias("value"), s["contribution"].alias("contribution"))))
        .drop("_x", "_phi")
    )
