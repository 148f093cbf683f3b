"""Anomalous values in the recent buffer of each series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import ANOMALY_WINDOW, SERIES_LENGTH
from pulseframe.operators.frames import chosen_values, complete
from pulseframe.operators.snapshot import recent_sample
from pulseframe.operators.stl import seasonal

MAD_SCALE = 1.4826
CHUNK = 256


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1.0 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + top * d)
            c = 1.0 + top / c
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * f


def student_t_quantile(p: float, dof: float) -> float:
    """Upper-half quantile (p > 0.5) of Student's t distribution."""
    lo, hi = 0.0, 1.0
    cdf = lambda t: 1.0 - 0.5 * _beta_tail(dof / (dof + t * t), dof / 2, 0.5)
    while cdf(hi) < p:
        lo, hi = hi, 2 * hi
    scale = lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5 * log(dof * pi)
    # The distribution is concave here, so Newton steps from below stay below and close in.
    for _ in range(100):
        step = (p - cdf(lo)) / exp(scale - (dof + 1) / 2 * log(1 + lo * lo / dof))
        lo += step
        if abs(step) <= 1e-13 * lo:
            break
    return lo


@lru_cache(maxsize=None)
def _critical(n: int, i: int, alpha: float) -> float:
    """Limit for the i-th most extreme of n values in the generalised ESD test."""
    dof = n - i - 1
    t = student_t_quantile(1 - alpha / (2 * (n - i + 1)), dof)
    return t * (n - i) / sqrt((dof + t * t) * (n - i + 1))


def _middle(ordered: np.ndarray, size: int) -> np.ndarray:
    """Median of the first ``size`` values of each sorted row, as a column."""
    return (ordered[:, (size - 1) // 2] + ordered[:, size // 2])[:, None] / 2


def _extreme(left: np.ndarray, max_share: float, alpha: float) -> np.ndarray:
    """Marks of generalised ESD with median and MAD, for rows of one length."""
    rows, n = left.shape
    most = max(0, min(int(n * max_share), n - 3))
    at = np.arange(rows)
    gone, open_, count = np.zeros(left.shape, dtype=bool), np.ones(rows, dtype=bool), np.zeros(rows, dtype=int)
    turn = np.full(left.shape, n)
    # What is left of a row after rounding is no spread.
    least = 1e-12 * np.abs(left).max(axis=1, initial=0)
    for i in range(1, most + 1):
        size = n - i + 1
        centre = _middle(np.sort(np.where(gone, np.inf, left), axis=1), size)
        far = np.where(gone, np.inf, np.abs(left - centre))
        spread = MAD_SCALE * _middle(np.sort(far, axis=1), size)[:, 0]
        open_ &= spread > least
        far[gone] = -1.0
        worst = far.argmax(axis=1)
        turn[at, worst], gone[at, worst] = i, True
        beyond = far[at, worst] > _critical(n, i, alpha) * spread
        count[open_ & beyond] = i
    return turn <= count[:, None]


def anomaly_marks(
    frames: np.ndarray, lengths: np.ndarray, period: int, max_share: float = 0.1, alpha: float = 0.05, span: int | None = None
) -> np.ndarray:
    """Which values of each row (padded behind its length) are anomalies: seasonal hybrid ESD.

    The season comes from a robust STL and is the same in every cycle, unless ``span`` lets it drift. Rows shorter than two
    periods, or with a missing or infinite value, have none.
    """
    marks = np.zeros(frames.shape, dtype=bool)
    whole = complete(frames, lengths) & (lengths >= 2 * period) if period >= 1 else np.zeros(len(frames), dtype=bool)
    for n in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == n))
        for some in np.array_split(rows, -(-len(rows) // CHUNK)):
            left = frames[some, :n]
            if period > 1:
                left = left - seasonal(left, period, span)
            marks[some, :n] = _extreme(left - np.median(left, axis=1, keepdims=True), max_share, alpha)
    return marks


def seasonal_esd(values: np.ndarray, period: int, max_share: float = 0.1, alpha: float = 0.05, span: int | None = None) -> list[int]:
    """Positions of the anomalies of one series."""
    frames = np.asarray(values, dtype=float)[None, :]
    return np.flatnonzero(anomaly_marks(frames, np.array([frames.shape[1]]), period, max_share, alpha, span)[0]).tolist()


def anomaly_column(sample: Column, period: int = ANOMALY_WINDOW, span: int | None = None) -> Column:
    """Anomalous values of an array of at most 128 values, in series order; NULL for NULL."""

    @F.pandas_udf("array<double>")
    def detect(samples: pd.Series) -> pd.Series:
        return chosen_values(samples, lambda frames, lengths: anomaly_marks(frames, lengths, period, span=span))

    return detect(sample)


def anomalies(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: int = ANOMALY_WINDOW, n: int = SERIES_LENGTH,
    span: int | None = None,
) -> DataFrame:
    """(keys, anomalies) of each series' recent buffer."""
    recent = recent_sample(df.withColumn(value, F.col(value).cast("double")), keys, order, value, n)
    return recent.select(*keys, anomaly_column(F.col("sample"), period, span).alias("anomalies"))


def anomalies_mad(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: float = 3.5, n: int = SERIES_LENGTH
) -> DataFrame:
    """(keys, value, score) of buffer values far from the median, in units of the scaled MAD. No Python."""
    recent = recent_sample(df.withColumn(value, F.col(value).cast("double")), keys, order, value, n)

    def median(a: Column) -> Column:
        size = F.size(a)
        return (F.get(a, F.floor((size - 1) / 2).cast("int")) + F.get(a, F.floor(size / 2).cast("int"))) / 2

    measured = recent.withColumn("__m", median(F.array_sort("sample"))).withColumn(
        "__d", median(F.array_sort(F.transform("sample", lambda x: F.abs(x - F.col("__m")))))
    )
    rows = measured.select(*keys, "__m", "__d", F.explode("sample").alias("value"))
    score = F.try_divide(F.abs(F.col("value") - F.col("__m")), F.col("__d") * MAD_SCALE)
    return rows.withColumn("score", score).where(F.col("score") > limit).select(*keys, "value", "score")
