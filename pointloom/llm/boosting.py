"""Gradient-boosted trees for a softmax over classes: quantile bins, second-order gains, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """trees[r][c] is (feature, threshold, value): inner nodes in heap order, then the leaves' values."""

    classes: int
    trees: list
    start: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds up to a constant, [rows, classes]."""
        out = np.repeat(self.start[None], len(x), 0)
        rows = np.arange(len(x))
        for trees in self.trees:
            for c, (feature, threshold, value) in enumerate(trees):
                at = np.zeros(len(x), np.int64)
                for _ in range((len(feature) + 1).bit_length() - 1):
                    at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
                out[:, c] += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Fits to rows x of classes y. Deterministic; ties between splits go to the first feature and bin."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], 1)  # bin b: x <= cuts[b]
    start = np.log((np.bincount(y, minlength=classes) + 1) / (n + classes))
    score, trees = np.repeat(start[None], n, 0), []
    for _ in range(rounds):
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        made = []
        for c in range(classes):
            g, h = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            inner = (1 << depth) - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                cell = (((at - first)[:, None] * f + np.arange(f)) * bins + binned).ravel()
                gs, hs = (np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                for j in range(f):
                    gain[:, j, len(cuts[j]) :] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    if gain[k].ravel()[best[k]] > 1e-9:
                        feature[first + k], b = divmod(int(best[k]), bins)
                        threshold[first + k] = cuts[feature[first + k]][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
            leaf = at - inner
            value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            score[:, c] += value[leaf]
            made.append((feature, threshold, value))
        trees.append(made)
    return Boosted(classes, trees, start)
