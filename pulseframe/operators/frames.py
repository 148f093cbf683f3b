"""Arrays of recent values as 2-D frames, so that numpy handles the buffers of many series and records at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd


def padded(samples: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest, lengths): values from the left, NaN behind them. A missing array is an empty row."""
    rows = [np.empty(0) if s is None else np.asarray(s, dtype=float) for s in samples]
    lengths = np.array([len(r) for r in rows], dtype=int)
    frames = np.full((len(rows), lengths.max(initial=0)), np.nan)
    frames[np.arange(frames.shape[1]) < lengths[:, None]] = np.concatenate(rows) if rows else []
    return frames, lengths


def chosen_values(samples: pd.Series, mark: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """The values of each array that ``mark(frames, lengths)`` marks, in their order; NULL for a missing array."""
    frames, lengths = padded(list(samples))
    marks = mark(frames, lengths)
    return pd.Series([None if s is None else f[m] for s, f, m in zip(samples, frames, marks)], dtype=object)


def complete(frames: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows without a missing or infinite value within their length."""
    return np.isfinite(frames).sum(axis=1) == lengths
