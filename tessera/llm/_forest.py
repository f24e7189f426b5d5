"""A small random forest of binary classification trees, in numpy."""

from __future__ import annotations

import numpy as np


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays ``feature, threshold, left, right, value``; feature -1 is a leaf."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    tries = max(1, int(round(m**0.5)) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, n, n)
        nodes: list[list[float]] = []

        def grow(ix, level, nodes=nodes):
            me = len(nodes)
            share = y[ix].mean()
            nodes.append([-1, 0.0, -1, -1, share])
            if level >= depth or len(ix) < 2 * least or share in (0.0, 1.0):
                return me
            best = (1e-9, None, None)
            total, ones = len(ix), y[ix].sum()
            impure = 2 * share * (1 - share)
            for f in rng.choice(m, tries, replace=False):
                v = x[ix, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.04, 0.96, 24)))
                low = v[:, None] <= cuts[None]
                a = low.sum(axis=0)
                a1 = (low * y[ix][:, None]).sum(axis=0)
                b, b1 = total - a, ones - a1
                ok = (a >= least) & (b >= least)
                if not ok.any():
                    continue
                pa, pb = a1 / np.maximum(a, 1), b1 / np.maximum(b, 1)
                gain = np.where(ok, impure - (a * 2 * pa * (1 - pa) + b * 2 * pb * (1 - pb)) / total, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, cuts[k])
            if best[1] is None:
                return me
            go = x[ix, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = int(best[1]), float(best[2])
            nodes[me][2] = grow(ix[go], level + 1)
            nodes[me][3] = grow(ix[~go], level + 1)
            return me

        grow(rows, 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return out


def predict_forest(forest, x: np.ndarray) -> np.ndarray:
    """Mean leaf value over the trees."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        total += value[at]
    return total / max(1, len(forest))
