"""Level shifts in the recent buffer of each series (E-divisive with medians)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import ANOMALY_WINDOW, BREAKOUT_BETA, SERIES_LENGTH
from pulseframe.operators.frames import chosen_values, complete
from pulseframe.operators.snapshot import recent_sample

# Series that share a search: their medians take 128 * 128 * 8 bytes each.
CHUNK = 256


def _segment_medians(z: np.ndarray) -> np.ndarray:
    """``m[i, j]``: median of ``z[i:j]``, for each column of ``z``.

    Values stand for themselves by their rank in the column, which takes a byte. A rank enters all columns' sorted segments at
    once: behind it each place gets the middle of its two old neighbours and the new rank.
    """
    n, columns = z.shape
    order = z.argsort(axis=0, kind="stable")
    kind = np.uint8 if n < 255 else np.int32
    beyond = np.iinfo(kind).max
    rank = np.empty((n, columns), dtype=kind)
    np.put_along_axis(rank, order, np.arange(n, dtype=kind)[:, None], axis=0)
    low, high = np.zeros((2, n, n, columns), dtype=kind)
    held, fresh = np.empty((2, n + 1, columns), dtype=kind)
    for i in range(n):
        held[:] = beyond
        for size, new in enumerate(rank[i:], 1):
            np.minimum(held[:size], new, out=fresh[:size])
            np.maximum(fresh[1:size], held[:size - 1], out=fresh[1:size])
            held, fresh = fresh, held
            held[size] = beyond
            low[i, i + size - 1], high[i, i + size - 1] = held[(size - 1) // 2], held[size // 2]
    ordered = np.take_along_axis(z, order, axis=0)
    m = np.full((n + 1, n + 1, columns), np.nan)
    for i in range(n):
        m[i, i + 1:] = (np.take_along_axis(ordered, low[i, i:].astype(np.intp), 0) + np.take_along_axis(ordered, high[i, i:].astype(np.intp), 0)) / 2
    return m


def _best_breaks(z: np.ndarray, min_size: int, degree: int, beta: float) -> np.ndarray:
    """``previous[end]``: where the last level of the first ``end`` values starts, 0 for one level; a column per series.

    The best split of every prefix is found from the best splits of shorter ones; each further break must pay a penalty that
    grows with the breaks before it.
    """
    n, columns = z.shape
    med, every = _segment_medians(z), np.arange(columns)
    best, breaks, previous = np.zeros((n + 1, columns)), np.zeros((n + 1, columns)), np.zeros((n + 1, columns), dtype=int)
    last = med[0].copy()
    for end in range(2 * min_size, n + 1):
        cuts = slice(min_size, end - min_size + 1)
        cut, start = np.arange(min_size, end - min_size + 1)[:, None], previous[cuts]
        weight = (cut - start) * (end - cut) / (end - start) ** 2
        growth = {0: 1.0, 1: breaks[cuts], 2: 2 * breaks[cuts] + 1}[degree]
        gain = best[cuts] + weight * (last[cuts] - med[cuts, end]) ** 2 - beta * growth
        top = gain.argmax(axis=0)
        most, at = gain[top, every], top + min_size
        better = most > 0
        best[end], previous[end] = np.where(better, most, 0), np.where(better, at, 0)
        breaks[end] = np.where(better, breaks[at, every] + 1, 0)
        last[end] = np.where(better, med[at, end, every], last[end])
    return previous


def break_marks(
    frames: np.ndarray, lengths: np.ndarray, min_size: int = ANOMALY_WINDOW, degree: int = 2, beta: float = BREAKOUT_BETA
) -> np.ndarray:
    """Which values of each row (padded behind its length) start a new level.

    A row too short for two levels, constant, or with a missing or infinite value has none. The search goes from prefix to
    prefix, so rows of several lengths share it: what stands behind a row's end does not matter. A row that the next one
    continues, with the same least and greatest value, takes its breaks from that one's search.
    """
    marks = np.zeros(frames.shape, dtype=bool)
    rows = np.flatnonzero(complete(frames, lengths) & (lengths >= 2 * min_size))
    low, high = (f(frames[rows], axis=1, keepdims=True) if len(rows) else np.empty((0, 1)) for f in (np.nanmin, np.nanmax))
    rows, low, high = (a[(high > low)[:, 0]] for a in (rows, low, high))
    # A growing buffer: as long as neither its least nor its greatest value changes, one search of the longest finds the breaks of all.
    of = np.arange(len(rows))
    for r in range(len(rows) - 2, -1, -1):
        size = lengths[rows[r]]
        if size <= lengths[rows[r + 1]] and low[r] == low[r + 1] and high[r] == high[r + 1] and (
            np.array_equal(frames[rows[r], :size], frames[rows[r + 1], :size])
        ):
            of[r] = of[r + 1]
    longest = np.unique(of)
    longest = longest[np.argsort(lengths[rows[longest]], kind="stable")]
    column, users = np.empty(len(rows), dtype=int), np.argsort(of, kind="stable")
    starts = np.searchsorted(of[users], np.arange(len(rows) + 1))
    for some in np.array_split(longest, -(-len(longest) // CHUNK)) if len(longest) else []:
        at, size = rows[some], lengths[rows[some]]
        z = (frames[at, :size.max()] - low[some]) / (high[some] - low[some])
        previous = _best_breaks(np.ascontiguousarray(np.nan_to_num(z).T), min_size, degree, beta)
        column[some] = np.arange(len(some))
        sharing = np.concatenate([users[starts[i]:starts[i + 1]] for i in some])
        at, every, here = rows[sharing], column[of[sharing]], lengths[rows[sharing]]
        while (here := previous[here, every]).any():
            marks[at[here > 0], here[here > 0]] = True
    return marks


def breakpoints(values: np.ndarray, min_size: int = ANOMALY_WINDOW, degree: int = 2, beta: float = BREAKOUT_BETA) -> list[int]:
    """Start positions of the new levels of one series."""
    frames = np.asarray(values, dtype=float)[None, :]
    return np.flatnonzero(break_marks(frames, np.array([frames.shape[1]]), min_size, degree, beta)[0]).tolist()


def breakout_column(sample: Column, min_size: int = ANOMALY_WINDOW) -> Column:
    """Values at the breaks of an array of at most 128 values; NULL for NULL."""

    @F.pandas_udf("array<double>")
    def detect(samples: pd.Series) -> pd.Series:
        return chosen_values(samples, lambda frames, lengths: break_marks(frames, lengths, min_size))

    return detect(sample)


def breakouts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, min_size: int = ANOMALY_WINDOW, n: int = SERIES_LENGTH
) -> DataFrame:
    """(keys, breakouts) of each series' recent buffer."""
    recent = recent_sample(df.withColumn(value, F.col(value).cast("double")), keys, order, value, n)
    return recent.select(*keys, breakout_column(F.col("sample"), min_size).alias("breakouts"))
