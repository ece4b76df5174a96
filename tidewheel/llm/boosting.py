"""Gradient-boosted regression trees on a small feature matrix, for a binary label.

Newton boosting of the logistic loss over binned features. A model is a list of
trees in arrays, small enough to travel with a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), "int64")
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes_left = x[rows, self.feature[node]] <= self.cut[node]
            at[rows] = np.where(goes_left, self.left[node], self.right[node])
        return self.value[at]


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((tree(x) for tree in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of the label 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, least: float) -> Tree:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, 0, 0, -rate * g / (h + 1.0)])
        best = (1e-6, -1, 0.0)
        if level < depth:
            for f, points in enumerate(cuts):
                if not len(points):
                    continue
                place = np.searchsorted(points, x[rows, f], "left")
                gl = np.cumsum(np.bincount(place, grad[rows], len(points) + 1))[:-1]
                hl = np.cumsum(np.bincount(place, hess[rows], len(points) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                gain[(hl < least) | (h - hl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(points[k]))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = split(rows[low], level + 1)
            nodes[me][3] = split(rows[~low], level + 1)
        return me

    split(np.arange(len(x)), 0)
    columns = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c, kind) for c, kind in zip(columns, ("int64", "float64", "int64", "int64", "float64"), strict=True)))


def fit(x: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 0.5) -> Boosted:
    """Boosted trees; labels 0 and 1."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[:-1], method="lower")) for f in range(x.shape[1])]
    rate_of = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(x), np.log(rate_of / (1 - rate_of)))
    base, grown = float(margin[0]), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grown.append(_grow(x, p - label, p * (1 - p), cuts, depth, rate, least))
        margin = margin + grown[-1](x)
    return Boosted(base, tuple(grown))


def calibrated(model: Boosted, x: np.ndarray, label: np.ndarray) -> Boosted:
    """The model with its margin rescaled to probabilities (Platt) on rows that it was not grown on."""
    m, slope, shift = model.margin(x), 1.0, 0.0
    target = (label * label.sum() + 1) / (label.sum() + 2) * (label == 1) + (label == 0) / ((label == 0).sum() + 2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        g, w = p - target, p * (1 - p) + 1e-9
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(g * m).sum() + 1e-3 * (slope - 1), g.sum()]))
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-6:
            break
    return Boosted(model.base, model.trees, float(slope), float(shift))
