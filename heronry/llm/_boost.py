"""Gradient-boosted regression trees for two classes, on binned features; small enough to train on the driver.

All trees have one depth and lie in arrays, so a level of a tree is one histogram when it's grown and one lookup when it's used.
"""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> dict:
    """Trees of the logistic loss, second order; ties go to the first feature and cut, so the result is the same each time."""
    n, d = x.shape
    cuts = np.full((d, bins), np.inf)
    for j in range(d):
        c = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0)
        cuts[j, : len(c)] = c
    code = np.stack([np.searchsorted(cuts[j, :-1], x[:, j], side="left") for j in range(d)], axis=1) if n else np.zeros((0, d), np.int64)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner = 2**depth - 1
    feat, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    score, rows = np.full(n, base), np.arange(n)
    place = code + np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            wide = 2**level
            at = (node[:, None] * (d * bins) + place).ravel()
            gs = np.bincount(at, np.repeat(g, d), wide * d * bins).reshape(wide, d, bins)
            hs = np.bincount(at, np.repeat(h, d), wide * d * bins).reshape(wide, d, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < least) | (ha - hl < least) | ~np.isfinite(cuts)[None]] = -1
            best = gain.reshape(wide, -1).argmax(axis=1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            j, b = best // bins, np.where(good, best % bins, bins)  # where nothing is gained, all go left
            feat[t, wide - 1 : 2 * wide - 1] = j
            cut[t, wide - 1 : 2 * wide - 1] = np.where(good, cuts[j, np.minimum(b, bins - 1)], np.inf)
            node = 2 * node + (code[rows, j[node]] > b[node])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf[t] = -rate * gs / (hs + l2)
        score += leaf[t][node]
    return {"base": base, "feat": feat, "cut": cut, "leaf": leaf, "depth": depth}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1."""
    n, d = x.shape
    s, flat, rows = np.full(n, model["base"]), np.ascontiguousarray(x).ravel(), np.arange(n) * d
    for feat, cut, leaf in zip(model["feat"], model["cut"], model["leaf"]):
        node = np.zeros(n, np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (flat[rows + feat[node]] > cut[node])
        s += leaf[node - len(feat)]
    return 1 / (1 + np.exp(-s))
