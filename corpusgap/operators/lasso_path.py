"""The whole lasso path from column products, by homotopy.

The minimizer of |y - Xb|² / 2 + limit |b|₁ is piecewise linear in `limit`. From the largest
correlation downwards, the active coefficients move along the solution of G_AA d = signs, until a
column joins (its correlation reaches the limit) or leaves (its coefficient reaches zero). Only the
Gram matrix X'X, the products X'y and y'y are needed, so the rows are read once for any number of
penalties.

Columns that depend on active ones, duplicates among them, stay at the limit without joining: their
correlation follows that of the active ones, so the solution is optimal without them. Ties join one
after the other. Every solution can be certified by its duality gap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A column whose part outside the active ones is smaller than this share of it depends on them.
DEPENDENT = 1e-10
TIED = 1e-9
MAX_EVENTS_PER_COLUMN = 100


@dataclass
class Path:
    """Solutions at falling limits; between two of them the solution is a straight line."""

    limits: list[float]
    betas: list[np.ndarray]

    def at(self, limit: float) -> np.ndarray:
        """The minimizer at a limit from the path's last one on."""
        if limit >= self.limits[0]:
            return np.zeros_like(self.betas[0])
        falling = np.array(self.limits)
        i = int(np.searchsorted(-falling, -limit, "left"))
        if i == len(falling):
            if limit < falling[-1] * (1 - TIED):
                raise ValueError(f"the path ends at {falling[-1]}, above {limit}")
            return self.betas[-1]
        high, low = falling[i - 1], falling[i]
        share = (high - limit) / (high - low) if high > low else 1.0
        return (1 - share) * self.betas[i - 1] + share * self.betas[i]


def duality_gap(gram: np.ndarray, cross: np.ndarray, square: float, limit: float,
                beta: np.ndarray) -> float:
    """How far |y - Xb|² / 2 + limit |b|₁ may be above its minimum, as a share of |y|² / 2."""
    slope = cross - gram @ beta
    fitted = beta @ cross
    rest = max(square - 2 * fitted + beta @ gram @ beta, 0.0)
    top = np.max(np.abs(slope), initial=0.0)
    scale = min(1.0, limit / top) if top > 0 else 1.0
    primal = rest / 2 + limit * np.sum(np.abs(beta))
    dual = scale * (square - fitted) - scale**2 * rest / 2
    return max(float(primal - dual), 0.0) / (square / 2) if square > 0 else 0.0


class _Active:
    """The active columns with the Cholesky factor of their part of the Gram matrix."""

    def __init__(self, gram: np.ndarray):
        self.gram = gram
        self.columns: list[int] = []
        self.factor = np.zeros((0, 0))

    def join(self, j: int) -> bool:
        """Add column j; False if it depends on the active ones."""
        own = self.gram[j, j]
        row = np.linalg.solve(self.factor, self.gram[self.columns, j]) if self.columns else np.zeros(0)
        left = own - row @ row
        if left <= DEPENDENT * own:
            return False
        k = len(self.columns)
        factor = np.zeros((k + 1, k + 1))
        factor[:k, :k], factor[k, :k], factor[k, k] = self.factor, row, np.sqrt(left)
        self.factor = factor
        self.columns.append(j)
        return True

    def leave(self, j: int) -> None:
        """Take column j out and rotate the factor back to a triangle."""
        at = self.columns.index(j)
        self.columns.pop(at)
        rows = np.delete(self.factor, at, axis=0)
        triangle = np.linalg.qr(rows.T, mode="r").T
        self.factor = triangle * np.sign(np.diag(triangle))

    def solve(self, right: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, right))


def lasso_path(gram: np.ndarray, cross: np.ndarray, end: float) -> Path:
    """The solutions from the largest correlation down to the limit `end`."""
    p = len(cross)
    beta = np.zeros(p)
    usable = np.diag(gram) > 1e-12 * max(np.max(np.diag(gram), initial=0.0), 1e-300)
    limit = float(np.max(np.abs(cross[usable]), initial=0.0))
    path = Path([limit], [beta.copy()])
    active = _Active(gram)
    signs = np.zeros(p)
    dropped = -1  # the column that has just left cannot join at once
    for _ in range(MAX_EVENTS_PER_COLUMN * (p + 1)):
        if limit <= end:
            break
        slope = cross - gram @ beta
        columns = np.array(active.columns, int)
        direction = np.zeros(p)
        if len(columns):
            direction[columns] = active.solve(signs[columns])
        falls = gram @ direction  # how fast each correlation falls
        waiting = usable.copy()
        waiting[columns] = False
        # 1 columns at the limit that would rise above it join now
        side = np.where(slope >= 0, 1.0, -1.0)
        at_limit = waiting & (np.abs(slope) >= limit * (1 - TIED))
        rising = at_limit & (side * falls < 1 - TIED)
        if dropped >= 0:
            rising[dropped] = False
        entered = False
        for j in np.flatnonzero(rising):
            if active.join(int(j)):
                signs[j], dropped, entered = side[j], -1, True
                break
            usable[j] = False  # depends on the active columns, but for rounding
        if entered:
            continue
        # 2 else on to the next event
        waiting &= usable
        step, event, joins = limit - end, -1, False
        for towards in (1.0, -1.0):
            speed = 1 - towards * falls
            distance = limit - towards * slope
            # a column that is at the limit already can only meet it on the other side
            ahead = waiting & ~(at_limit & (side == towards)) & (speed > 1e-14)
            steps = np.where(ahead, distance / np.where(speed > 1e-14, speed, 1), np.inf)
            j = int(np.argmin(steps)) if p else -1
            if p and steps[j] < step:
                step, event, joins = max(float(steps[j]), 0.0), j, True
        for j in columns:
            if direction[j] * beta[j] < 0 and -beta[j] / direction[j] < step:
                step, event, joins = float(-beta[j] / direction[j]), int(j), False
        beta = beta + step * direction
        limit -= step
        dropped = -1
        if event >= 0 and not joins:
            beta[event] = 0.0
            active.leave(event)
            signs[event] = 0.0
            dropped = event
        path.limits.append(limit)
        path.betas.append(beta.copy())
    return path
