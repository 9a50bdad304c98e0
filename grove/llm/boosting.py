"""Gradient-boosted trees for a binary label, and isotonic calibration, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A tree by arrays: a node's feature (-1: leaf), threshold, left child (right is next) and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.intp)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = self.left[node] + (x[inner, f[inner]] > self.threshold[node])


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    """A tree on gradients and Hessians, split on histograms of binned features."""
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    level = [(0, np.arange(len(x)))]
    for turn in range(depth + 1):
        following = []
        for node, rows in level:
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = float(-gs / (hs + ridge))
            if turn == depth:
                continue
            best = (1e-9, -1, 0)
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                if n < 2:
                    continue
                gl = np.cumsum(np.bincount(bins[rows, f], g[rows], n))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], h[rows], n))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                _, f, k = best
                go = bins[rows, f] > k
                feature[node], threshold[node], left[node] = f, float(edges[f][k]), len(feature)
                for side in (rows[~go], rows[go]):
                    following.append((len(feature), side))
                    for array, x0 in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                        array.append(x0)
        level = following
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(value))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return self.base + self.rate * sum((t(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 0.5, ridge: float = 1.0, n_bins: int = 48) -> Boosted:
    """Newton boosting of the logistic loss; ``y`` holds both labels."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    edges = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, bins, edges, p - y, np.maximum(p * (1 - p), 1e-6), depth, least, ridge)
        model.trees.append(tree)
        score += rate * tree(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function of ``score`` nearest to ``y`` (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    values, first = np.unique(score[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    counts = np.diff(np.append(first, len(y)))
    for v, s, n in zip(values, sums, counts, strict=True):
        blocks.append([s, n, v * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    return at, np.array([b[0] / b[1] for b in blocks])
