"""Gradient boosted trees of depth two over small whole numbers.

The table is counted per distinct cell of features and label by Spark. As every
feature has few values, the cells are few however large the table, and hold all that
a fit needs: the trees are grown on the counted cells, and scores are expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

Split = tuple[int, int]  # feature, last value of the lower side


@dataclass(frozen=True)
class Boost:
    """Parameters of the fit."""

    trees: int = 40
    rate: float = 0.5
    ridge: float = 1.0  # added to the second derivatives of a leaf


@dataclass(frozen=True)
class Tree:
    """The root's split, those of its two sides, and the four leaves."""

    root: Split
    sides: tuple[Split | None, Split | None]
    leaves: tuple[float, float, float, float]

    def value(self, f: Column) -> Column:
        low, high = (F.when(f[s[0]] <= s[1], F.lit(a)).otherwise(F.lit(b)) if s else F.lit(a)
                     for s, a, b in zip(self.sides, self.leaves[::2], self.leaves[1::2]))
        return F.when(f[self.root[0]] <= self.root[1], low).otherwise(high)

    def values(self, f: np.ndarray) -> np.ndarray:
        """The same for the rows of a matrix."""
        low, high = (np.where(f[:, s[0]] <= s[1], a, b) if s else np.full(len(f), a)
                     for s, a, b in zip(self.sides, self.leaves[::2], self.leaves[1::2]))
        return np.where(f[:, self.root[0]] <= self.root[1], low, high)


def score(f: Column, base: float, trees: list[Tree]) -> Column:
    """Log odds of a feature array."""
    total = F.lit(base)
    for tree in trees:
        total = total + tree.value(f)
    return total


def scores(f: np.ndarray, base: float, trees: list[Tree]) -> np.ndarray:
    total = np.full(len(f), base)
    for tree in trees:
        total = total + tree.values(f)
    return total


def best_split(f: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> Split | None:
    """The split with the largest gain, the first one among equals, or None."""
    best, found = 1e-9, None
    for k in range(f.shape[1]):
        low_g, low_h = np.cumsum(np.bincount(f[:, k], g)), np.cumsum(np.bincount(f[:, k], h))
        for value in np.unique(f[:, k])[:-1]:
            a, b = low_g[value], low_h[value]
            gain = a * a / (b + ridge) + (low_g[-1] - a) ** 2 / (low_h[-1] - b + ridge) - low_g[-1] ** 2 / (low_h[-1] + ridge)
            if gain > best + 1e-9:
                best, found = gain, (k, int(value))
    return found


def fit(f: np.ndarray, label: np.ndarray, weight: np.ndarray, boost: Boost = Boost()) -> tuple[float, list[Tree]]:
    """Base log odds and trees for distinct cells (rows of ``f``, whole numbers from
    0 on, in a fixed order) with their labels and numbers of rows."""
    true, total = float((weight * label).sum()), float(weight.sum())
    base, trees = math.log((true + 1) / (total - true + 1)), []
    odds = np.full(len(f), base)
    for _ in range(boost.trees if len(f) else 0):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (label - p), weight * p * (1 - p)
        root = best_split(f, g, h, boost.ridge)
        if root is None:
            break
        below, sides, leaves = f[:, root[0]] <= root[1], [], []
        for own in (below, ~below):
            split = best_split(f[own], g[own], h[own], boost.ridge)
            sides.append(split)
            low = f[:, split[0]] <= split[1] if split else own
            leaves += [round(boost.rate * float(g[x].sum() / (h[x].sum() + boost.ridge)), 9) for x in (own & low, own & ~low)]
        trees.append(Tree(root, tuple(sides), tuple(leaves)))
        odds = odds + trees[-1].values(f)
    return base, trees
