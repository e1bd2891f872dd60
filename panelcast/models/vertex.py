"""Exact minimum of a sum of check losses, from a point that is close to it.

The minimum lies at a vertex, where as many rows are met exactly as there are coefficients.
From one vertex to the next, one of these rows is let go and the edge is followed down to the
row where the loss turns up again (the simplex method for regression quantiles).
"""

from __future__ import annotations

import numpy as np

REFRESH = 40  # steps after which the inverse is computed anew
SMALL = 1e-9


def independent(rows: np.ndarray, most: int) -> list[int]:
    """The first ``most`` rows that do not depend on the ones before them."""
    base, chosen = np.empty((0, rows.shape[1])), []
    for i, row in enumerate(rows):
        size = np.linalg.norm(row)
        rest = row - base.T @ (base @ row)
        rest -= base.T @ (base @ rest)
        left = np.linalg.norm(rest)
        if left > 1e-7 * size:
            base = np.vstack([base, rest / left])
            chosen.append(i)
            if len(chosen) == most:
                break
    return chosen


def least_loss(x, y, up, down, start, steps: int) -> tuple[np.ndarray, bool]:
    """Coefficients, and whether they are the minimum; ``up`` and ``down`` weigh each row's
    positive and negative residuals.  ``start`` is returned where no vertex is better."""

    def loss(b):
        r = y - x @ b
        return np.where(r > 0, up * r, -down * r).sum()

    # dependent columns keep the coefficients they have
    columns = np.array(independent(x.T, x.shape[1]))
    a, rest = x[:, columns], y - x @ start
    scale = np.abs(a).max(axis=0)
    a = a / scale
    spread = np.abs(rest).mean()
    # ties would let the method stand still: a little noise sets them apart
    noisy = rest + SMALL * spread * np.random.default_rng(0).random(len(y))
    basis = _first_basis(a, noisy, a.shape[1])
    if len(basis) < a.shape[1]:
        return start, False
    inverse = np.linalg.inv(a[basis])
    best = False
    for step in range(steps):
        if step % REFRESH == REFRESH - 1:
            inverse = np.linalg.inv(a[basis])
        r = noisy - a @ (inverse @ noisy[basis])
        slope = np.where(r > 0, up, -down)
        slope[basis] = 0.0
        pull = inverse.T @ (a.T @ slope)
        rates = np.concatenate([down[basis] - pull, up[basis] + pull])
        out = int(rates.argmin())
        if rates[out] >= -SMALL * (up.mean() + down.mean()) * len(y) ** 0.5:
            best = True
            break
        leaving, sign = out % len(basis), 1.0 if out < len(basis) else -1.0
        along = sign * (a @ inverse[:, leaving])
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = r / along
        turn[basis] = -1.0
        ahead = np.flatnonzero((turn >= 0) & (np.abs(along) > 1e-11))
        ahead = ahead[np.argsort(turn[ahead], kind="stable")]
        rising = rates[out] + np.cumsum((up[ahead] + down[ahead]) * np.abs(along[ahead]))
        at = int(np.searchsorted(rising, 0.0))
        if at >= len(ahead):
            break
        entering = ahead[at]
        row = a[entering] @ inverse
        inverse[:, leaving] /= row[leaving]
        others = np.arange(len(basis)) != leaving
        inverse[:, others] -= np.outer(inverse[:, leaving], row[others])
        basis[leaving] = entering
    found = start.copy()
    found[columns] += np.linalg.solve(a[basis], rest[basis]) / scale
    return (found, best) if loss(found) <= loss(start) else (start, False)


def _first_basis(a: np.ndarray, r: np.ndarray, width: int) -> np.ndarray:
    """Rows that are nearly met already, as many as there are coefficients."""
    order = np.argsort(np.abs(r), kind="stable")
    for many in (8 * width, len(order)):
        chosen = independent(a[order[:many]], width)
        if len(chosen) == width:
            break
    return order[chosen]
