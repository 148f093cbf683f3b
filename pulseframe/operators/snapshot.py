"""Per-series answers: catalog, last value, recent sample, state after the last record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import SERIES_LENGTH
from pulseframe.operators.rolling import _statistics
from pulseframe.operators.scale import newest


def metric_catalog(df: DataFrame, key: str = "topic") -> DataFrame:
    """Every known key, sorted."""
    return df.select(key).distinct().orderBy(key)


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Newest value per key; partial aggregation keeps one row per key and task before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias("last"))


def recent_sample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = SERIES_LENGTH
) -> DataFrame:
    """Up to ``n`` newest values per key as an array, oldest first."""
    kept = newest(df.select(*keys, *order, value), keys, order, n)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return kept.groupBy(*keys).agg(F.transform(rows, lambda r: r["__v"]).alias("sample"))


def sampler_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = SERIES_LENGTH
) -> DataFrame:
    """``data`` (values), ``values`` (time and value pairs) and ``len`` of the recent buffer."""
    kept = newest(df.select(*keys, *order, value), keys, order, n)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    collected = kept.groupBy(*keys).agg(rows.alias("__rows"))
    return collected.select(
        *keys,
        F.transform("__rows", lambda r: r["__v"]).alias("data"),
        F.transform("__rows", lambda r: F.struct(r[order[0]].alias("timestamp"), r["__v"].alias("value"))).alias("values"),
        F.size("__rows").alias("len"),
    )


def series_snapshot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = SERIES_LENGTH
) -> DataFrame:
    """Statistics of each series' buffer after its last record."""
    kept = newest(df.select(*keys, *order, F.col(value).cast("double").alias("__x")), keys, order, n)
    x = F.col("__x")
    positive = F.when(x > 0, x)
    parts = {
        "n": F.count(x), "sum": F.sum(x), "m2": F.var_pop(x) * F.count(x), "min": F.min(x), "max": F.max(x),
        "log": F.sum(F.ln(positive)), "inv": F.sum(1 / positive), "sq": F.sum(x * x),
    }
    summed = kept.groupBy(*keys).agg(*[c.alias(f"__{k}") for k, c in parts.items()])
    return summed.select(*keys, *[c.alias(k) for k, c in _statistics({k: F.col(f"__{k}") for k in parts}).items()])


def observed_span(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: Column, n: int = SERIES_LENGTH
) -> DataFrame:
    """First and last whole second in the buffer; NULL for two samples or fewer, or a span of zero."""
    kept = newest(df.select(*keys, *order, F.floor(seconds).cast("bigint").alias("__s")), keys, order, n)
    bounds = kept.groupBy(*keys).agg(
        F.min("__s").alias("__lo"), F.max("__s").alias("__hi"), F.count("*").alias("samples")
    )
    known = (F.col("samples") > 2) & (F.col("__lo") != F.col("__hi"))
    return bounds.select(
        *keys, "samples",
        F.when(known, F.col("__lo")).alias("s"),
        F.when(known, F.col("__hi")).alias("e"),
        F.when(known, F.col("__hi") - F.col("__lo")).alias("elapsed"),
    )
