"""Small gradient-boosted trees in numpy, fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows go left when value <= threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0.0, -1, -1, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, at = np.array(self.left), np.array(self.right), np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(goes, left[node], right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(x)]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, upper side, threshold) that lead to each node but the root."""
        out, todo = [], [(0, ())]
        while todo:
            node, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                todo += [(self.left[node], (*path, (f, False, t))), (self.right[node], (*path, (f, True, t)))]
        return out


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    """For each feature the thresholds that a split may use: middles between its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(codes, cuts, gradient, hessian, rows, depth: int, least: int, rate: float) -> Tree:
    """One tree over the given rows, whose features are numbers of the intervals between cuts.

    Nodes wait on a stack: a recursive inner function would keep every tree's arrays in a cycle.
    """
    tree = Tree()
    todo = [(tree.add(), rows, depth)]
    while todo:
        node, rows, left_depth = todo.pop()
        own_g, own_h = gradient[rows], hessian[rows]
        g, h = own_g.sum(), own_h.sum()
        tree.value[node] = -rate * g / (h + 1.0)
        best = (1e-6, -1, 0)
        if left_depth and len(rows) >= 2 * least:
            for f, points in enumerate(cuts):
                if not len(points):
                    continue
                own = codes[rows, f]
                size = np.cumsum(np.bincount(own, minlength=len(points) + 1))[:-1]
                gl = np.cumsum(np.bincount(own, own_g, len(points) + 1))[:-1]
                hl = np.cumsum(np.bincount(own, own_h, len(points) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(size < least) | (len(rows) - size < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            goes = codes[rows, best[1]] <= best[2]
            tree.feature[node], tree.threshold[node] = best[1], float(cuts[best[1]][best[2]])
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            todo += [(tree.left[node], rows[goes], left_depth - 1), (tree.right[node], rows[~goes], left_depth - 1)]
    return tree


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int = 3, rate: float = 0.2, least: int = 10, share: float = 1.0, seed: int = 5) -> Boosted:
    """Logistic boosting; each round sees a ``share`` of the rows."""
    draw = np.random.default_rng(seed)
    cuts = cut_points(x)
    # column by column, a byte each: BINS is below 256
    codes = np.stack([np.searchsorted(c, column, side="left").astype(np.uint8) for c, column in zip(cuts, x.T)]).T
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    logits = np.full(len(x), model.base)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-logits))
        rows = np.flatnonzero(draw.random(len(x)) < share) if share < 1 else np.arange(len(x))
        if len(rows) < 2 * least:
            break
        tree = grow(codes, cuts, chance - y, chance * (1 - chance), rows, depth, least, rate)
        model.trees.append(tree)
        logits = logits + tree.predict(x)
    return model
