"""Gradient-boosted trees for a yes/no label, kept as flat node arrays.

Training works on histograms of a bounded sample. A feature may be constrained: along it the score never falls (+1) or
never rises (-1). Scoring walks all rows of a batch down one tree level by level with array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    shrink: float = 2.0
    least_weight: float = 2.0
    bins: int = 64


@dataclass(frozen=True)
class Trees:
    """Node i tests feature[i] < threshold[i] and goes to left[i] or right[i]; a leaf has feature -1 and a value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows, np.maximum(f, 0)] < self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def constant(probability: float) -> Trees:
    """No trees: the same probability for every row."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    none = np.zeros(0, np.int64)
    return Trees(float(np.log(p / (1 - p))), none, none, np.zeros(0), none, none, np.zeros(0))


class _Grower:
    def __init__(self, binned: np.ndarray, cuts: list[np.ndarray], signs: np.ndarray, cfg: BoostConfig):
        self.binned, self.cuts, self.signs, self.cfg = binned, cuts, signs, cfg
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def best_split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        """(gain, feature, bin, left value, right value) of the best allowed split, or None."""
        cfg, best = self.cfg, None
        gs, hs = g[rows].sum(), h[rows].sum()
        weight = lambda a, b: np.clip(-a / (b + cfg.shrink), low, high)
        worth = lambda a, b, w: -(a * w + 0.5 * (b + cfg.shrink) * w * w)
        whole = worth(gs, hs, weight(gs, hs))
        for f in range(self.binned.shape[1]):
            if not len(self.cuts[f]):
                continue
            b = self.binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(self.cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(self.cuts[f]) + 1))[:-1]
            wl, wr = weight(gl, hl), weight(gs - gl, hs - hl)
            gain = worth(gl, hl, wl) + worth(gs - gl, hs - hl, wr) - whole
            gain[(hl < cfg.least_weight) | (hs - hl < cfg.least_weight) | (self.signs[f] * (wr - wl) < 0)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, float(wl[k]), float(wr[k]))
        return best

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        at = self.node()
        split = self.best_split(rows, g, h, low, high) if depth else None
        if split is None:
            self.value[at] = self.cfg.rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + self.cfg.shrink), low, high))
            return at
        _, f, k, wl, wr = split
        middle = (wl + wr) / 2
        # below a constrained split both sides stay on their side of the middle, so deeper splits can not undo the order
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(self.signs[f])]
        go = self.binned[rows, f] <= k
        self.feature[at], self.threshold[at] = f, float(self.cuts[f][k])
        self.left[at] = self.grow(rows[go], g, h, depth - 1, *bounds[0])
        self.right[at] = self.grow(rows[~go], g, h, depth - 1, *bounds[1])
        return at


def train(x: np.ndarray, y: np.ndarray, signs: list[int], cfg: BoostConfig = BoostConfig()) -> Trees:
    """Trees for P(y = 1). The result depends on the set of rows, not on their order, up to rounding."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 1.0)
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order].astype(float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, cfg.bins + 1)[1:-1])) for c in x.T]
    cuts = [c[(c > v.min()) & (c <= v.max())] for c, v in zip(cuts, x.T)]
    binned = np.column_stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    grower = _Grower(binned, cuts, np.array(signs), cfg)
    total, roots, rows = np.full(len(y), base), [], np.arange(len(y))
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grower.grow(rows, p - y, p * (1 - p), cfg.depth, -np.inf, np.inf))
        made = Trees(0.0, np.array(roots[-1:]), *map(np.array, (grower.feature, grower.threshold, grower.left, grower.right, grower.value)))
        score = made.probability(x)
        total += np.log(score / (1 - score))
    return Trees(base, np.array(roots), *map(np.array, (grower.feature, grower.threshold, grower.left, grower.right, grower.value)))
