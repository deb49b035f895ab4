"""Gradient-boosted trees over binned features, and isotonic calibration, for bounded samples."""

from __future__ import annotations

import numpy as np


def bins(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Cut points of each feature: the distinct values, or quantiles where there are more than `most`."""
    out = []
    for col in x.T:
        v = np.unique(col)
        out.append(((v[1:] + v[:-1]) / 2) if len(v) <= most else np.unique(np.quantile(col, np.arange(1, most) / most)))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, col, side="right") for c, col in zip(cuts, x.T)], 1) if len(cuts) else np.empty((len(x), 0), int)


def fit_trees(x: np.ndarray, y: np.ndarray, start: np.ndarray, weight: np.ndarray, trees=60, depth=3, rate=0.15, l2=2.0, least=1.0) -> tuple[list, list]:
    """(cuts, trees) for the logistic loss; `start` are the margins to begin with. A tree is a list of (feature, bin, left, right) and leaf values."""
    cuts = bins(x)
    b, f, out = binned(x, cuts), start.astype(float).copy(), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        nodes: list = [None]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, d = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if d < depth and len(rows) > 1:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < least * 0.1) | (hs - hl < least * 0.1)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                v = rate * gs / (hs + l2)
                nodes[at] = v
                f[rows] += v
                continue
            left = b[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[left], d + 1), (len(nodes) + 1, rows[~left], d + 1)]
            nodes += [None, None]
        out.append(nodes)
    return cuts, out


def margins(model: tuple[list, list], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    cuts, trees = model
    b, f = binned(x, cuts), start.astype(float).copy()
    for nodes in trees:
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            n = nodes[at]
            if isinstance(n, tuple):
                left = b[rows, n[0]] <= n[1]
                todo += [(n[2], rows[left]), (n[3], rows[~left])]
            else:
                f[rows] += n
    return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function of x nearest to y: pooled adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0], top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    return np.array([v for b in blocks for v in (b[0], b[1])]), np.array([b[2] / b[3] for b in blocks for _ in (0, 1)])


def calibrated(points: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.interp(x, *points)
