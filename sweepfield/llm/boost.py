"""Small regression trees for boosting, on a bounded sample in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 at a leaf, whose value is ``value``."""

    feature: list[int] = field(default_factory=list)
    bound: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, v in (("feature", -1), ("bound", 0.0), ("left", -1), ("right", -1), ("value", value)):
            getattr(self, name).append(v)
        return len(self.value) - 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grow(x: np.ndarray, grad: np.ndarray, weight: np.ndarray, depth: int, bins: int = 32, least: int = 5, ridge: float = 1.0) -> Tree:
    """A tree that fits ``grad / weight``; cuts are quantiles of the node's own rows."""
    tree = Tree()

    def build(rows: np.ndarray, deep: int) -> int:
        g, h = grad[rows].sum(), weight[rows].sum()
        node = tree.add(float(g / (h + ridge)))
        if deep == depth or len(rows) < 2 * least:
            return node
        best = (1e-6, -1, 0.0)
        for k in range(x.shape[1]):
            v = x[rows, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            cuts = cuts[cuts < v.max()]
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, v, side="left")
            lg, lh, ln = (np.cumsum(np.bincount(at, w, len(cuts) + 1))[:-1] for w in (grad[rows], weight[rows], np.ones(len(rows))))
            gain = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
            gain[(ln < least) | (len(rows) - ln < least)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), k, float(cuts[gain.argmax()]))
        if best[1] < 0:
            return node
        low = x[rows, best[1]] <= best[2]
        tree.feature[node], tree.bound[node] = best[1], best[2]
        tree.left[node], tree.right[node] = build(rows[low], deep + 1), build(rows[~low], deep + 1)
        return node

    build(np.arange(len(x)), 0)
    return tree


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The value of the leaf each row falls to."""
    at = np.zeros(len(x), int)
    feature, bound, left, right = (np.array(v) for v in (tree.feature, tree.bound, tree.left, tree.right))
    while len(x) and (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= bound[node], left[node], right[node])
    return np.array(tree.value)[at]
