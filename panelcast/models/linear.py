"""Linear quantile regression by Newton steps on a smoothed check loss.

The kink of the loss is rounded over a width that shrinks from step to step.  A pass sums
loss, gradient and second derivatives at a few trial points per level; the next points come
from the best of them, by coordinate descent on the summed quadratic where coefficients are
penalized (L1).  Where a task holds all rows of a window, the fit ends at the exact minimum.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import LEVELS
from panelcast.models.passes import fit
from panelcast.models.vertex import least_loss

# Trial points along a Newton step, and how the width shrinks at them.
STEPS, SHRINK = (1.0, 0.3, 1.0), (0.5, 0.8, 0.2)
FIRST_WIDTH = 0.6  # of the residuals' standard deviation
KERNEL = 0.55  # scale of the logistic kernel per width
# Widths, relative to its own, at which a best point is tried again that a step has not
# left; when none of them leads on, the level is done.
AGAIN = (0.5, 2.0, 0.1, 0.02)


@dataclass
class Fitting:
    """State between passes: per level the best coefficients and the points to try."""

    best: np.ndarray | None = None  # levels by coefficients
    loss: np.ndarray | None = None
    width: np.ndarray | None = None  # where the best point was tried
    still: np.ndarray | None = None
    points: np.ndarray | None = None  # levels by trials by coefficients
    widths: np.ndarray | None = None  # levels by trials; 0 where there is nothing to try
    weights: np.ndarray | None = None
    scale: np.ndarray | None = None
    sigma: float = 1.0
    step: int = 0
    converged: bool = False


@dataclass(frozen=True)
class LinearQuantile:
    """``l1`` weighs the penalty against the mean loss, 1 as in common defaults.

    ``raw`` columns are penalized as they are, the others per standard deviation, which
    equals standardizing them first.  A level is done when its loss has not gained ``tol``
    (relative) in five passes; a fit that is stopped by ``max_iter`` passes is reported and
    marked as such.
    """

    names: tuple[str, ...]
    raw: tuple[str, ...] = ()
    levels: tuple[float, ...] = LEVELS
    l1: float = 1.0
    max_iter: int = 40
    tol: float = 1e-4
    kind: str = "linear"
    keeps_rows: bool = False

    @property
    def width(self) -> int:
        return len(self.names) + 1  # intercept first

    def fit(
        self, chunks: DataFrame, models: DataFrame, frame=None, target="y", local_values=None
    ) -> DataFrame:
        models = fit(chunks, models, self, "linear", local_values=local_values)
        late = models.filter((F.size("params") > 0) & (F.get("params", F.size("params") - 1) == 0))
        if n := late.count():
            warnings.warn(f"{n} fits have not converged in {self.max_iter} passes", stacklevel=2)
        return models

    def converged(self, params: np.ndarray) -> bool:
        return bool(params[-1])

    def passes(self, params: np.ndarray) -> int:
        return int(params[-2])

    # --- what the engine calls -----------------------------------------------------------

    def states(self) -> tuple[type, ...]:
        return (Fitting,)

    def constants(self, x, y) -> np.ndarray:
        return np.empty(0)

    def start(self, aux) -> Fitting:
        return Fitting()

    def rows(self, x, y, to_end, aux):
        return np.column_stack([np.ones(len(y)), x]), y

    def sums(self, rows, work: Fitting) -> np.ndarray:
        x, y = rows
        if work.step == 0:
            return np.concatenate([[len(y)], _upper(x.T @ x), x.T @ y, [y @ y]])
        out = [np.array([len(y)], dtype=float)]
        for i, tau in enumerate(self.levels):
            for b, h in zip(work.points[i], work.widths[i], strict=True):
                if h > 0:
                    out += self._derivatives(x, y, tau, b, h * KERNEL)
        return np.concatenate(out)

    @staticmethod
    def _derivatives(x, y, tau, b, h) -> list[np.ndarray]:
        """Loss, gradient and second derivatives; the loss itself is not smoothed."""
        r = y - x @ b
        below = 1.0 / (1.0 + np.exp(np.clip(r / h, -40.0, 40.0)))
        bend = below * (1.0 - below) / h
        loss = np.maximum(tau * r, (tau - 1) * r).sum()
        return [np.array([loss]), x.T @ (below - tau), _upper((x * bend[:, None]).T @ x)]

    def update(self, sums, work: Fitting, aux) -> tuple[Fitting, bool]:
        p, n = self.width, sums[0]
        if work.step == 0:
            return self._begin(sums, n, p), False
        work.step += 1
        size = 1 + p + p * (p + 1) // 2
        at = 1
        for i in range(len(self.levels)):
            tried = []
            for b, h in zip(work.points[i], work.widths[i], strict=True):
                if h > 0:
                    part, at = sums[at : at + size], at + size
                    loss = part[0] / n + self.l1 * (work.weights * np.abs(b)).sum()
                    tried.append((loss, h, b, part[1 : 1 + p], part[1 + p :]))
            if tried:
                self._next_points(work, i, n, min(tried, key=lambda t: t[0]))
        work.converged = not work.widths.any()
        return work, work.converged or work.step > self.max_iter

    def _next_points(self, work: Fitting, i: int, n: float, best) -> None:
        loss, h, b, gradient, bend = best
        gain = work.loss[i] - loss
        if gain > 0:
            work.best[i], work.loss[i], work.width[i] = b, loss, h
        tau = self.levels[i]
        unit = max(work.loss[i], 1e-3 * work.sigma * tau * (1 - tau))
        work.still[i] = 0 if gain > self.tol * unit else work.still[i] + 1
        if work.still[i] > len(AGAIN):
            work.widths[i] = 0
            return
        hessian = _square(bend, self.width)
        hessian += np.diag(_damping(hessian, work, n))
        step = _minimum(gradient, hessian, b, n * self.l1 * work.weights) - b
        for k, (go, shrink) in enumerate(zip(STEPS, SHRINK, strict=True)):
            work.points[i, k], work.widths[i, k] = b + go * step, h * shrink
        if gain <= 0:  # the best point is elsewhere: look at it again
            again = AGAIN[min(work.still[i], len(AGAIN)) - 1]
            work.points[i, -1], work.widths[i, -1] = work.best[i], work.width[i] * again

    def _begin(self, sums, n, p) -> Fitting:
        gram = _square(sums[1 : 1 + p * (p + 1) // 2], p)
        rhs, yy = sums[-1 - p : -1], sums[-1]
        mean, square = gram[0] / n, np.diag(gram) / n
        spread = np.sqrt(np.maximum(square - mean**2, 0.0))
        weights = np.where(np.isin(["", *self.names], self.raw), 1.0, spread)
        weights[0] = 0.0
        if self.l1:  # penalized fits start from the mean alone
            b = np.zeros(p)
            b[0] = rhs[0] / n
            sigma = float(np.sqrt(max(yy / n - b[0] ** 2, 0.0))) or 1.0
        else:
            b = np.linalg.solve(gram + 1e-10 * np.trace(gram) / p * np.eye(p), rhs)
            sigma = float(np.sqrt(max(yy - b @ rhs, 0.0) / n)) or 1.0
        t, k = len(self.levels), len(STEPS)
        best = np.tile(b, (t, 1))
        best[:, 0] += [NormalDist().inv_cdf(q) * sigma for q in self.levels]
        points, widths = np.zeros((t, k, p)), np.zeros((t, k))
        points[:, 0], widths[:, 0] = best, FIRST_WIDTH * sigma
        scale = np.where(spread > 0, spread, 1.0)
        scale[0] = 1.0
        return Fitting(
            best, np.full(t, np.inf), np.full(t, FIRST_WIDTH * sigma), np.zeros(t, int),
            points, widths, weights, scale, sigma, 1,
        )

    def polish(self, rows, work: Fitting) -> Fitting:
        """From close by to the exact minimum, with all rows at hand."""
        x, y = rows
        pull = len(y) * self.l1 * work.weights
        own = np.flatnonzero(pull)  # a penalty is one more row: its coefficient against 0
        wide = np.vstack([x, np.eye(self.width)[own]])
        label = np.concatenate([y, np.zeros(len(own))])
        sure = []
        for i, tau in enumerate(self.levels):
            up = np.concatenate([np.full(len(y), tau), pull[own]])
            down = np.concatenate([np.full(len(y), 1 - tau), pull[own]])
            work.best[i], exact = least_loss(wide, label, up, down, work.best[i], 50 * self.width)
            r = y - x @ work.best[i]
            work.loss[i] = np.maximum(tau * r, (tau - 1) * r).mean()
            work.loss[i] += self.l1 * (work.weights * np.abs(work.best[i])).sum()
            sure.append(exact)
        work.converged |= all(sure)
        return work

    def params(self, work: Fitting, aux) -> np.ndarray:
        """Coefficients by level, loss by level, passes, and whether the fit has converged."""
        if work.best is None:
            return np.empty(0)
        tail = [work.step, float(work.converged)]
        return np.concatenate([work.best.ravel(), work.loss, tail])

    # --- the model -----------------------------------------------------------------------

    def coefficients(self, params: np.ndarray) -> np.ndarray:
        t, p = len(self.levels), self.width
        return np.asarray(params)[: t * p].reshape(t, p)

    def predict(self, x: np.ndarray, params: np.ndarray, aux: np.ndarray) -> np.ndarray:
        """Rows by levels."""
        beta = self.coefficients(params)
        return beta[:, 0] + x @ beta[:, 1:].T


def _upper(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square))]


def _square(upper: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


def _damping(hessian: np.ndarray, work: Fitting, n: float) -> np.ndarray:
    """A little on the diagonal, in units of each column's spread."""
    mean_bend = (np.diag(hessian) / work.scale**2).mean() / n
    return (1e-6 * mean_bend + 1e-9 / work.sigma) * n * work.scale**2


def _minimum(gradient, hessian, at, pull, sweeps: int = 200) -> np.ndarray:
    """Where ``gradient'd + d'hessian d / 2 + pull |at + d|`` is least, as ``at + d``."""
    slope = gradient - hessian @ at
    if not pull.any():
        return np.linalg.solve(hessian, -slope)
    x, bent, diagonal = at.copy(), hessian @ at, np.diag(hessian)
    size = np.sqrt(diagonal)
    smallest = 1e-10 * max(1.0, float((np.abs(at) * size).max()))
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(diagonal > 0):
            rest = slope[j] + bent[j] - diagonal[j] * x[j]
            new = -np.sign(rest) * max(abs(rest) - pull[j], 0.0) / diagonal[j]
            if new != x[j]:
                bent += hessian[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]) * size[j])
                x[j] = new
        if moved < smallest:
            break
    return x
