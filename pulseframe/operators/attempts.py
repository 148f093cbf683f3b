"""Filters and transformations in a user's own Python, whose failing rows go to a table of rejects.

The function gets the columns it names as a pandas frame, a batch at a time, and must treat each row by itself. If it raises, the
batch is halved until the rows at fault stand alone, so a few bad rows cost a few more calls and the others stay vectorised.
All other columns stay in the JVM. What comes back is the whole input with an ``error`` column, NULL where all went well;
missing values in it come back as NULL. Write it once, then ``accepted`` and ``rejects`` are two scans of it. Streams work too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR, KEPT = "error", "kept"


def by_halves(work: Callable[[pd.DataFrame], pd.DataFrame], frame: pd.DataFrame) -> list[tuple[pd.DataFrame | None, int, str | None]]:
    """(outcome, rows, error) of consecutive parts of a frame; a part with an error is one row."""
    try:
        out = work(frame)
        if len(out) != len(frame):
            raise ValueError(f"{len(out)} rows for {len(frame)}")
        return [(out, len(frame), None)]
    except Exception as e:  # noqa: BLE001 - whatever a user's function raises
        if len(frame) == 1:
            return [(None, 1, f"{type(e).__name__}: {e}")]
        half = len(frame) // 2
        return by_halves(work, frame.iloc[:half].reset_index(drop=True)) + by_halves(work, frame.iloc[half:].reset_index(drop=True))


def _attempt(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """The rows with a struct ``__out`` of ``fields`` and ``error``."""
    names = list(fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for out, rows, error in by_halves(work, frame) if len(frame) else ():
            part = pd.DataFrame(index=range(rows), columns=names, dtype=object) if out is None else out[names].reset_index(drop=True).astype(object)
            parts.append(part.assign(**{ERROR: error}))
        whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*names, ERROR], dtype=object)
        return whole.where(whole.notna(), None)

    schema = ", ".join(f"`{n}` {kind}" for n, kind in {**fields, ERROR: "string"}.items())
    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    # Not deterministic as far as Spark knows: it must not run once for a filter on the outcome and again for the outcome.
    attempt = F.pandas_udf(run, schema).asNondeterministic()
    return df.withColumn("__out", attempt(F.struct(*columns)))


def try_filter(df: DataFrame, decide: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str]) -> DataFrame:
    """Adds ``kept`` and ``error``. A row without a decision (missing, or neither true nor false) counts as failed and is not kept."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        verdict = pd.Series(decide(frame), dtype=object)
        if not verdict.map(pd.api.types.is_bool).all():
            raise TypeError("neither true nor false")
        return pd.DataFrame({KEPT: verdict.to_numpy()})

    out = F.col("__out")
    return _attempt(df, work, columns, {KEPT: "boolean"}).select(
        *df.columns, F.coalesce(out[KEPT], F.lit(False)).alias(KEPT), out[ERROR].alias(ERROR)
    )


def try_transform(df: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Sets the columns ``fields`` (name to type) to what the function returns under these names, and adds ``error``.

    A failed row keeps its old values; columns that are new are NULL there.
    """
    out = F.col("__out")
    done = _attempt(df, lambda frame: change(frame.copy()), columns, fields)
    failed = out[ERROR].isNotNull()
    old = [F.when(failed, F.col(c)).otherwise(out[c]).alias(c) if c in fields else F.col(c) for c in df.columns]
    return done.select(*old, *[out[c].alias(c) for c in fields if c not in df.columns], out[ERROR].alias(ERROR))


def accepted(done: DataFrame) -> DataFrame:
    """Rows that went through and, after a filter, were kept, in the columns they had."""
    good = done.where(F.col(ERROR).isNull())
    return (good.where(KEPT).drop(KEPT) if KEPT in done.columns else good).drop(ERROR)


def rejects(done: DataFrame) -> DataFrame:
    """Rows on which the user's function failed, with the error."""
    failed = done.where(F.col(ERROR).isNotNull())
    return failed.drop(KEPT) if KEPT in done.columns else failed
