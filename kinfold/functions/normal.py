"""Normal distribution functions on numpy arrays (the driver and the Python workers have no statistics library)."""

from __future__ import annotations

import math

import numpy as np

_X, _W = np.polynomial.legendre.leggauss(48)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def density(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def quantile(p: float) -> float:
    """By bisection on the distribution function: exact to rounding, and needs no table."""
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def bivariate(h: np.ndarray, k: np.ndarray, r: float) -> np.ndarray:
    """P(X <= h, Y <= k) at correlation r, integrating the density over the angle from 0 to asin r."""
    h, k = np.broadcast_arrays(np.clip(np.asarray(h, float), -40, 40), np.clip(np.asarray(k, float), -40, 40))
    top = math.asin(max(-1.0, min(1.0, r)))
    angle = top * (_X + 1) / 2
    sin, cos2 = np.sin(angle), np.maximum(np.square(np.cos(angle)), 1e-300)
    power = -(np.square(h)[..., None] + np.square(k)[..., None] - 2 * (h * k)[..., None] * sin) / (2 * cos2)
    return np.clip(cdf(h) * cdf(k) + top / 2 * (np.exp(np.maximum(power, -745)) * _W).sum(-1) / (2 * math.pi), 0, 1)


def cells(rows: np.ndarray, columns: np.ndarray, r: float) -> np.ndarray:
    """Probabilities of the cells that thresholds (with infinite ends) cut."""
    grid = bivariate(rows[:, None], columns[None, :], r)
    return np.maximum(np.diff(np.diff(grid, axis=0), axis=1), 1e-12)
