"""Learners in numpy, used inside grouped maps: boosted trees and a pairwise ranking gradient."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Least-squares boosting of shallow trees on quantile bins, with row and column sampling and early
    stopping on a validation part."""

    def __init__(self, rounds=200, depth=4, rate=0.05, rows=1.0, columns=1.0, bins=32, least=5, patience=None, seed=42):
        self.rounds, self.depth, self.rate, self.rows, self.columns = rounds, depth, rate, rows, columns
        self.bins, self.least, self.patience, self.seed = bins, least, patience, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, at: np.ndarray, columns: np.ndarray, depth: int):
        """The histograms of all columns of a node come from one count; of equal gains the first column and bin wins."""
        if depth and len(at) >= 2 * self.least:
            total, n, wide = g[at].sum(), len(at), self.bins + 1
            places = (b[np.ix_(at, columns)] + np.arange(len(columns)) * wide).ravel()
            s = np.bincount(places, np.repeat(g[at], len(columns)), wide * len(columns)).reshape(-1, wide).cumsum(axis=1)[:, :-1]
            k = np.bincount(places, minlength=wide * len(columns)).reshape(-1, wide).cumsum(axis=1)[:, :-1]
            ok = (k >= self.least) & (n - k >= self.least)
            gain = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, -np.inf)
            best = int(gain.argmax())
            if gain.flat[best] > 1e-12:
                c, t = int(columns[best // self.bins]), best % self.bins
                left = b[at, c] <= t
                return c, t, self._grow(b, g, at[left], columns, depth - 1), self._grow(b, g, at[~left], columns, depth - 1)
        return float(g[at].mean()) if len(at) else 0.0

    def _value(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        c, t, left, right = tree
        return np.where(b[:, c] <= t, self._value(left, b), self._value(right, b))

    def fit(self, x: np.ndarray, y: np.ndarray, valid=None, gradient=None, loss=None) -> BoostedTrees:
        """loss: of the values of the validation part; else their squared error."""
        rng = np.random.default_rng(self.seed)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.base = float(y.mean()) if gradient is None else 0.0
        self.trees, f = [], np.full(len(y), self.base)
        vb = self._binned(valid[0]) if valid is not None and len(valid[1]) else None
        vf, best, kept = None if vb is None else np.full(len(vb), self.base), np.inf, 0
        for _ in range(self.rounds):
            g = y - f if gradient is None else gradient(f)
            at = np.sort(rng.choice(len(y), max(1, int(len(y) * self.rows)), replace=False))
            columns = np.sort(rng.choice(x.shape[1], max(1, int(x.shape[1] * self.columns)), replace=False))
            tree = self._grow(b, g, at, columns, self.depth)
            self.trees.append(tree)
            f = f + self.rate * self._value(tree, b)
            if vb is not None:
                vf = vf + self.rate * self._value(tree, vb)
                error = loss(vf) if loss else float(((valid[1] - vf) ** 2).mean())
                if error < best:
                    best, kept = error, len(self.trees)
                elif self.patience and len(self.trees) - kept >= self.patience:
                    break
        if vb is not None and self.patience:
            self.trees = self.trees[:kept]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._value(t, b) for t in self.trees), np.zeros(len(x)))


class Pairwise:
    """Pairwise logistic loss inside each group: its gradient says how far each item should rise. Groups are laid
    side by side, as many at a time as CELLS pairs allow."""

    CELLS = 1_000_000

    def __init__(self, grade: np.ndarray, group: np.ndarray):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, int)
        size = np.diff(np.append(first, len(order)))
        self.parts, self.grade = [], np.append(grade, 0.0)
        wide = int(size.max()) if len(size) else 1
        for a in range(0, len(size), max(1, self.CELLS // wide**2)):
            f, n = first[a : a + max(1, self.CELLS // wide**2)], size[a : a + max(1, self.CELLS // wide**2)]
            at = f[:, None] + np.arange(wide)
            inside = np.arange(wide) < n[:, None]
            self.parts.append((np.where(inside, order[np.minimum(at, len(order) - 1)], len(order)), inside, np.maximum(n - 1, 1)))

    def _pairs(self, f: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, g = np.append(f, 0.0)[at], self.grade[at]
        better = (g[:, :, None] > g[:, None, :]) & inside[:, :, None] & inside[:, None, :]
        return better, np.clip(x[:, :, None] - x[:, None, :], -30, 30)

    def gradient(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(f) + 1)
        for at, inside, others in self.parts:
            better, gap = self._pairs(f, at, inside)
            p = np.where(better, 1 / (1 + np.exp(gap)), 0)
            out[at] = np.where(inside, (p.sum(axis=2) - p.sum(axis=1)) / others[:, None], 0)
        return out[:-1]

    def loss(self, f: np.ndarray) -> float:
        total, n = 0.0, 0
        for at, inside, _ in self.parts:
            better, gap = self._pairs(f, at, inside)
            total, n = total + float(np.log1p(np.exp(-gap))[better].sum()), n + int(better.sum())
        return total / max(n, 1)
