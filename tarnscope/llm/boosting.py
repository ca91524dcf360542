"""Gradient-boosted trees for two classes on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees: feature and bin of every inner node, value of every leaf."""

    edges: list[np.ndarray]
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Second-order boosting of the log-loss; splits maximise the gain over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(edges, float(np.log(share / (1 - share))))
    b = trees.binned(x)
    score = np.full(len(x), trees.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, BINS)
        at = np.zeros(len(x), int)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            gains = np.full((n, x.shape[1], BINS), -1.0)
            for j in range(x.shape[1]):
                key = (at - first) * BINS + b[:, j]
                gl, hl = (np.bincount(key, w, n * BINS).reshape(n, BINS).cumsum(axis=1) for w in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gains[:, j] = np.where((hl > 1) & (ht - hl > 1), gain, -1)
            best = gains.reshape(n, -1).argmax(axis=1)
            good = gains.reshape(n, -1).max(axis=1) > 1e-6
            feature[first : first + n] = np.where(good, best // BINS, 0)
            cut[first : first + n] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        score += values[leaf]
        trees.features.append(feature)
        trees.cuts.append(cut)
        trees.leaves.append(values)
    return trees
