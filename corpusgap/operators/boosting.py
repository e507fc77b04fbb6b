"""Many small boosted-tree models at once, a group of rows each.

A sweep fits dozens of models on subsets of one small table, and one distributed fit after another
would spend its time on job starts. Here Spark deals out (model, rows) groups and each task fits
its models: squared error, second-order gains with an L2 penalty on leaf values, trees grown level
by level on binned columns. A group is one model's table and has to fit into a task; callers check
its rows against MAX_ROWS and use MLlib's distributed trees beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_ROWS = 200_000
BINS = 256
L2 = 1.0
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Splits of a tree in level order: column (-1 at leaves), last bin that goes left, first child
    (the right one follows), value."""

    column: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = self.column[node] >= 0
            if not inner.any():
                return self.value[node]
            at = node[inner]
            right = bins[rows[inner], self.column[at]] > self.bin[at]
            node[inner] = self.child[at] + right


def cuts(x: np.ndarray, most: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each column: its values, or quantiles of these if there are too many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most:
            values = np.unique(np.quantile(column, np.arange(1, most + 1) / most, method="inverted_cdf"))
        out.append(values)
    return out


def binned(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """The bin of each value; values above the last end are in the last bin."""
    bins = [np.minimum(np.searchsorted(e, c, "left"), len(e) - 1) for c, e in zip(x.T, ends)]
    return np.column_stack(bins) if bins else np.zeros((len(x), 0), np.int64)


def grow(bins: np.ndarray, gradient: np.ndarray, depth: int, step: float, width: int) -> Tree:
    """One tree against the gradient of the squared error."""
    n, p = bins.shape
    column, split, child, value = [-1], [0], [0], [0.0]
    node = np.zeros(n, np.int64)
    level = [0]
    for d in range(depth + 1):
        place = np.full(len(column), -1)
        place[level] = np.arange(len(level))
        own = place[node]
        live = np.flatnonzero(own >= 0)
        count = np.bincount(own[live], minlength=len(level)).astype(float)
        total = np.bincount(own[live], gradient[live], len(level))
        for i, at in enumerate(level):
            value[at] = -step * total[i] / (count[i] + L2)
        if d == depth or p == 0:
            break
        flat = ((own[live, None] * p + np.arange(p)) * width + bins[live]).ravel()
        size = len(level) * p * width
        left_n = np.cumsum(np.bincount(flat, minlength=size).reshape(len(level), p, width), axis=2)
        left_g = np.cumsum(np.bincount(flat, np.repeat(gradient[live], p), size).reshape(len(level), p, width), axis=2)
        right_n, right_g = count[:, None, None] - left_n, total[:, None, None] - left_g
        gain = left_g**2 / (left_n + L2) + right_g**2 / (right_n + L2) - (total**2 / (count + L2))[:, None, None]
        gain[(left_n < 1) | (right_n < 1)] = -np.inf
        best = gain.reshape(len(level), -1).argmax(axis=1)
        following = []
        for i, at in enumerate(level):
            if gain[i].flat[best[i]] > LEAST_GAIN:
                column[at], split[at] = divmod(int(best[i]), width)
                child[at] = len(column)
                following += [len(column), len(column) + 1]
                column += [-1, -1]
                split += [0, 0]
                child += [0, 0]
                value += [0.0, 0.0]
        if not following:
            break
        now = Tree(np.array(column), np.array(split), np.array(child), np.array(value))
        moved = live[now.column[node[live]] >= 0]
        at = node[moved]
        node[moved] = now.child[at] + (bins[moved, now.column[at]] > now.bin[at])
        level = following
    return Tree(np.array(column), np.array(split), np.array(child), np.array(value))


def fit_predict(x: np.ndarray, y: np.ndarray, unseen: np.ndarray, rounds: int, depth: int, step: float) -> np.ndarray:
    """Predictions of `unseen` rows after `rounds` trees on (x, y)."""
    ends = cuts(x)
    bins, other = binned(x, ends), binned(unseen, ends)
    width = max((len(e) for e in ends), default=1)
    base = float(np.mean(y)) if len(y) else 0.0
    known, guess = np.full(len(x), base), np.full(len(unseen), base)
    for _ in range(rounds if len(y) else 0):
        tree = grow(bins, known - y, depth, step, width)
        known += tree.predict(bins)
        guess += tree.predict(other)
    return guess
