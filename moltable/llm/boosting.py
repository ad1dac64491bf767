"""Gradient-boosted trees for two classes, small enough to travel with a task."""

from __future__ import annotations

import dataclasses

import numpy as np

TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.2, 32, 8, 1.0


@dataclasses.dataclass(frozen=True)
class Trees:
    """Complete trees of equal depth: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def _best_cut(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of these rows."""
    best = (1e-9, 0, BINS)
    total_g, total_h = slope.sum(), curve.sum()
    base = total_g**2 / (total_h + RIDGE)
    for f in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, f], slope, BINS))
        h = np.cumsum(np.bincount(binned[:, f], curve, BINS))
        n = np.cumsum(np.bincount(binned[:, f], minlength=BINS))
        gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - base
        gain[(n < LEAF) | (len(binned) - n < LEAF)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    return best


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit to labels 0 and 1 by Newton steps on the log-loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(x), bias)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, values, leafs = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 2 * LEAF:
                _, f, b = _best_cut(binned[rows], slope[rows], curve[rows])
                if b < len(cuts[f]):
                    feature[node], cut[node] = f, cuts[f][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for place in range(leaves):
            rows = at == place + inner
            leaf[place] = RATE * slope[rows].sum() / (curve[rows].sum() + RIDGE)
        margin += leaf[at - inner]
        features.append(feature)
        values.append(cut)
        leafs.append(leaf)
    return Trees(np.stack(features), np.stack(values), np.stack(leafs), bias)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the chance 1 / (1 + exp(-(a margin + b))), fitted by Newton steps on examples the trees have not seen."""
    a, b = 1.0, 0.0
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))  # kept off 0 and 1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, w = p - goal, p * (1 - p) + 1e-6
        hessian = np.array([[(w * margin**2).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(d * margin).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def threshold_for(chance: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest chance from which on all higher cuts keep ``precision`` too; above 1 if none does."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fails = np.flatnonzero(right < precision)
    upto = len(y) if not len(fails) else fails[0]
    return float(chance[order[upto - 1]]) if upto else 1.1
