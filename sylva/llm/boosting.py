"""Gradient-boosted regression trees on binned features with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A full binary tree by levels: feature and cut of inner nodes, values of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (at < len(self.feature)).any():
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - len(self.feature)]


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 8.0) -> Boosted:
    """Second-order boosting; every split maximises the gain over histogram bins, and leaves shrink by `ridge`."""
    p = np.average(y, weights=weight).clip(1e-4, 1 - 1e-4)
    model, z = Boosted(float(np.log(p / (1 - p)))), np.zeros(len(y))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner = (1 << depth) - 1
    for _ in range(trees):
        q = 1 / (1 + np.exp(-np.clip(model.base + z, -30, 30)))
        g, h = weight * (q - y), weight * q * (1 - q) + 1e-9
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best, score = (0, np.inf, bins), 1e-6
            if len(own) > 3:
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    k = int(gain.argmax())
                    if gain[k] > score:
                        best, score = (j, e[k], k), gain[k]
            feature[node], cut[node] = best[0], best[1]
            at[own] = 2 * node + 1 + (binned[own, best[0]] > best[2])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        model.trees.append(Tree(feature, cut, value))
        z += value[leaf]
    return model


#: Weight of the uncalibrated score beside the steps, so that documents on one step keep their order.
ORDER = 0.02


@dataclass
class Isotonic:
    """A non-decreasing step function; between two steps' values the nearer step holds, so gaps are not filled in."""

    edges: np.ndarray
    y: np.ndarray
    order: float = ORDER

    def __call__(self, z: np.ndarray) -> np.ndarray:
        steps = self.y[np.searchsorted(self.edges, z, side="right")]
        return (1 - self.order) * steps + self.order / (1 + np.exp(-np.clip(z, -30, 30)))


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators; blocks shrink slightly towards one half so that scores stay inside (0, 1)."""
    order = np.lexsort((y, z))
    blocks: list[list[float]] = []  # weight, weighted y, least z, largest z
    for i in order:
        blocks.append([weight[i], weight[i] * y[i], z[i], z[i]])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    w, wy, low, high = np.array(blocks).T
    return Isotonic((high[:-1] + low[1:]) / 2, (wy + 0.5 * weight.min()) / (w + weight.min()))
