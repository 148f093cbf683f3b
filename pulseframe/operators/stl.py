"""Seasonal-trend decomposition by LOESS of many series of one length at once.

On evenly spaced values a local regression is a fixed matrix of tricube weights. Robustness weights differ by series, but enter
as factors of the moments, so each smoothing of all series is a handful of matrix products.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np

ROBUST_ROUNDS = 15
LEAST_WEIGHT = 1e-9


def _odd(x: float) -> int:
    """The least odd number that is not below ``x``."""
    n = ceil(x)
    return n if n % 2 else n + 1


@lru_cache(maxsize=None)
def _kernel(n: int, span: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Tricube weights and offsets of the values 0..n-1 (rows) around -ahead..n-1+ahead (columns)."""
    offset = np.arange(n)[:, None] - np.arange(-ahead, n + ahead)[None, :]
    far = np.abs(offset)
    reach = np.sort(far, axis=0)[min(span, n) - 1].astype(float)
    reach = np.maximum(reach + max(0, span - n) // 2, 1e-12)
    share = far / reach
    weight = np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 3) ** 3, 0.0))
    return weight, offset.astype(float)


@lru_cache(maxsize=None)
def _moments(n: int, span: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights of ``_kernel``, times offsets to the power of 0, 1 and 2."""
    weight, offset = _kernel(n, span, ahead)
    return weight, weight * offset, weight * offset * offset


def loess(y: np.ndarray, span: int, degree: int, robust: np.ndarray | None = None, ahead: int = 0) -> np.ndarray:
    """Each row of ``y`` smoothed at its places, and at ``ahead`` more on both ends. Degree 0 or 1."""
    weight, near, square = _moments(y.shape[1], span, ahead)
    rho = np.ones_like(y) if robust is None else np.maximum(robust, LEAST_WEIGHT)
    weighed, s0 = rho * y, rho @ weight
    mean = weighed @ weight
    mean /= s0
    if degree == 0:
        return mean
    # In place: these arrays are passed through many times.
    s1, spread, t1 = rho @ near, rho @ square, weighed @ near
    for moment in (s1, spread, t1):
        moment /= s0
    part = s1 * s1
    spread -= part
    np.multiply(s1, mean, out=part)
    t1 -= part
    s1 *= t1
    # Without enough spread of the weighted places there is no slope, as at the very end of few values.
    flat = spread <= (0.001 * max(y.shape[1] - 1, 1)) ** 2
    np.copyto(spread, 1.0, where=flat)
    s1 /= spread
    np.copyto(s1, 0.0, where=flat)
    mean -= s1
    return mean


@lru_cache(maxsize=None)
def _low_pass(n: int, period: int) -> np.ndarray:
    """(n + 2 period) x n: moving means of period, period and 3 values, and then a LOESS over a period."""
    m = np.eye(n + 2 * period)
    for width in (period, period, 3):
        m = np.lib.stride_tricks.sliding_window_view(m, width, axis=1).mean(axis=2)
    return loess(m, _odd(period), 1)


@lru_cache(maxsize=None)
def _phases(n: int, period: int) -> np.ndarray:
    """n x period: the phase of each place."""
    return (np.arange(n)[:, None] % period == np.arange(period)).astype(float)


def _phase_means(y: np.ndarray, period: int, n: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Mean of each phase, repeated over ``n`` places."""
    rho = np.ones_like(y) if robust is None else np.maximum(robust, LEAST_WEIGHT)
    phases = _phases(y.shape[1], period)
    return ((rho * y) @ phases / (rho @ phases))[:, np.arange(n) % period]


def _cycles(y: np.ndarray, period: int, span: int | None, robust: np.ndarray | None) -> np.ndarray:
    """The values of each phase smoothed over the cycles, one more cycle on both ends; a constant without a span."""
    rows, n = y.shape
    if span is None:
        return _phase_means(y, period, n + 2 * period, robust)
    out = np.empty((rows, n + 2 * period))
    for phase in range(period):
        rho = None if robust is None else robust[:, phase::period]
        out[:, phase::period] = loess(y[:, phase::period], span, 1, rho, ahead=1)
    return out


def seasonal(y: np.ndarray, period: int, span: int | None = None, rounds: int = ROBUST_ROUNDS) -> np.ndarray:
    """The seasonal part of each row, robust against outliers.

    Without a ``span`` the season is the same in every cycle; with one, it may drift, and ``span`` cycles (odd, 3 or more) are
    smoothed together. An outlier far above the season's own changes may then leak into its neighbours. Rows need two whole periods
    of finite values.
    """
    n = y.shape[1]
    trend_span = _odd(1.5 * period / (1 - 1.5 / (span or 10 * n + 1)))
    trend, robust = np.zeros_like(y), None
    for _ in range(rounds + 1):
        cycles = _cycles(y - trend, period, span, robust)
        season = cycles[:, period:period + n] - cycles @ _low_pass(n, period)
        left = y - season
        trend = loess(left, trend_span, 1, robust)
        left -= trend
        np.abs(left, out=left)
        ordered = np.sort(left, axis=1)
        limit = 6 * ((ordered[:, (n - 1) // 2] + ordered[:, n // 2]) / 2)[:, None]
        share = left / np.where(limit > 0, limit, 1.0)
        robust = np.minimum(share, 1)
        robust *= robust
        np.subtract(1, robust, out=robust)
        robust *= robust
        np.copyto(robust, 1.0, where=share <= 0.001)
        np.copyto(robust, 0.0, where=share > 0.999)
        np.copyto(robust, (left == 0) * 1.0, where=limit <= 0)
    return season if span else _phase_means(season, period, n)
