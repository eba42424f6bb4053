"""Gradient-boosted trees on small numpy matrices, trained in seconds on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Binary classifier: logistic loss, histogram splits, complete trees of fixed depth; scores are calibrated on held-out rows."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    least: float = 4.0
    ridge: float = 1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            score += self.rate * self._grow(bins, cuts, y - q, q * (1 - q))
        return self

    def _grow(self, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        inner = (1 << self.depth) - 1
        which, at = np.zeros(inner, int), np.full(inner, np.inf)
        cut_bin = np.full(inner, 1 << 30)
        node = np.zeros(len(grad), int)
        for level in range(self.depth):
            for n in range((1 << level) - 1, (2 << level) - 1):
                rows = np.flatnonzero(node == n)
                best = (1e-6, 0, -1)
                if len(rows):
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + self.ridge)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = bins[rows, j]
                        gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                        gr, hr = g.sum() - gl, h.sum() - hl
                        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - whole
                        gain[(hl < 0.05) | (hr < 0.05)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[2] >= 0:
                    which[n], at[n], cut_bin[n] = best[1], cuts[best[1]][best[2]], best[2]
                node[rows] = 2 * n + 1 + (bins[rows, which[n]] > cut_bin[n])
        leaf = node - inner
        value = np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
        self.trees.append((which, at, value * self.rate))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, at, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > at[node])
            score += value[node - len(which)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 300) -> Boosted:
        """Fit slope and shift of the log odds on rows that weren't trained on."""
        s, a, b = self.raw(x), 1.0, 0.0
        for _ in range(steps):
            e = 1 / (1 + np.exp(-(a * s + b))) - y
            a, b = a - 0.05 * float((e * s).mean()), b - 0.2 * float(e.mean())
        self.slope, self.shift = max(a, 0.05), b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
