"""Small gradient-boosted trees (logistic loss, binned features) in numpy."""

from __future__ import annotations


class Boosted:
    """``fit`` on a bounded training matrix on the driver, ``margin`` anywhere."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: float = 8.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def _bin(self, x):
        import numpy as np

        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype("i8")

    def fit(self, x, y, weight=None):
        import numpy as np

        w = np.ones(len(y)) if weight is None else np.asarray(weight, "f8")
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, (n, d) = np.asfortranarray(self._bin(x)), x.shape
        self.base = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
        margin = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, "i8"), np.full(2**self.depth - 1, self.bins, "i8")
            at = np.zeros(n, "i8")
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                local = at - first
                best = np.full(k, 1e-6)
                tg, th = np.bincount(local, g, k), np.bincount(local, h, k)
                for j in range(d):
                    if not len(self.edges[j]):
                        continue
                    key = local * self.bins + b[:, j]
                    cg = np.bincount(key, g, k * self.bins).reshape(k, -1).cumsum(axis=1)[:, :-1]
                    ch = np.bincount(key, h, k * self.bins).reshape(k, -1).cumsum(axis=1)[:, :-1]
                    rg, rh = tg[:, None] - cg, th[:, None] - ch
                    gain = cg**2 / (ch + self.l2) + rg**2 / (rh + self.l2) - (tg**2 / (th + self.l2))[:, None]
                    gain[(ch < self.least / 4) | (rh < self.least / 4)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(k), top]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + k][better], cut[first : first + k][better] = j, top[better]
                at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            margin += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def margin(self, x):
        """Log odds of each row."""
        import numpy as np

        b, n = self._bin(x), len(x)
        out, rows = np.full(n, self.base), np.arange(n)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(n, "i8")
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out
