"""Rolling statistics and forecasts over the last rows of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.model import CONSISTENCY_LIMIT, FORECAST_PERIOD, SERIES_LENGTH
from pulseframe.operators.scale import HOT_ROWS, BLOCK_ROWS, over_series

STATISTICS = [
    "n_of_samples", "std_dev", "minimum", "maximum", "mean", "geometric_mean", "harmonic_mean",
    "quadratic_mean", "variance",
]
_PARTS = ["n", "sum", "var", "min", "max", "log", "inv", "sq"]


def _parts(x: Column) -> dict[str, Column]:
    """Mergeable summaries of a set of values, from which all statistics follow."""
    positive = F.when(x > 0, x)
    return {
        "n": F.count(x), "sum": F.sum(x), "var": F.var_pop(x), "min": F.min(x), "max": F.max(x),
        "log": F.sum(F.ln(positive)), "inv": F.sum(1 / positive), "sq": F.sum(x * x),
    }


def _statistics(p: dict[str, Column]) -> dict[str, Column]:
    n = p["n"]
    variance = F.when(n > 1, F.try_divide(p["m2"], n - 1))
    return {
        "n_of_samples": n,
        "std_dev": F.sqrt(variance),
        "minimum": p["min"],
        "maximum": p["max"],
        "mean": F.try_divide(p["sum"], n),
        "geometric_mean": F.when(p["min"] > 0, F.exp(F.try_divide(p["log"], n))).when(p["min"] == 0, F.lit(0.0)),
        "harmonic_mean": F.when(p["min"] > 0, F.try_divide(n, p["inv"])).when(p["min"] == 0, F.lit(0.0)),
        "quadratic_mean": F.sqrt(F.try_divide(p["sq"], n)),
        "variance": variance,
    }


def _merge(older: Column, newer: dict[str, Column]) -> dict[str, Column]:
    """Summary of two adjoining runs; the older one may be absent."""
    o = {k: older.getField(k) for k in _PARTS}
    zero = F.lit(0.0)
    n1 = F.coalesce(o["n"], F.lit(0))
    n = n1 + newer["n"]
    add = lambda k: F.coalesce(o[k], zero) + F.coalesce(newer[k], zero)
    gap = F.try_divide(newer["sum"], newer["n"]) - F.try_divide(o["sum"], n1)
    within = F.coalesce(o["var"] * n1, zero) + F.coalesce(newer["var"] * newer["n"], zero)
    between = F.coalesce(gap * gap * F.try_divide(n1 * newer["n"], n), zero)
    return {
        "n": n, "sum": add("sum"), "m2": within + between, "min": F.least(o["min"], newer["min"]),
        "max": F.greatest(o["max"], newer["max"]), "log": add("log"), "inv": add("inv"), "sq": add("sq"),
    }


def _rolling(df: DataFrame, part: list[str], order: Sequence[str], value: str, window: int) -> DataFrame:
    """Summaries of the last ``window`` rows with a constant amount of work per row.

    Rows are numbered and grouped in runs of ``window``. The rows wanted at any
    point are the tail of the previous run and the head of the current one, so
    one running aggregate in each direction and one ``lag`` give every frame.
    All three sorts share the single shuffle on the series key: the ``lag`` is
    ordered by run and number, which is the order the heads need anyway.
    """
    series = Window.partitionBy(*part).orderBy(*order)
    numbers = Window.partitionBy(*part).orderBy("__run", "__i")
    run = Window.partitionBy(*part, "__run")
    head = run.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    tail = run.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    numbered = df.withColumn("__i", F.row_number().over(series) - 1).withColumn(
        "__run", F.floor(F.col("__i") / window)
    )
    tails = numbered.withColumn("__tail", F.struct(*[c.over(tail).alias(k) for k, c in _parts(x).items()]))
    older = F.when(
        F.pmod("__i", F.lit(window)) != window - 1, F.lag("__tail", window - 1).over(numbers)
    )
    heads = {f"__{k}": c.over(head) for k, c in _parts(x).items()}
    return tails.withColumn("__older", older).drop("__tail").withColumns(heads).drop("__i", "__run")


def rolling_stats(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int = SERIES_LENGTH,
    hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Statistics of the last ``window`` values of the series, the current one included."""

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        rolled = _rolling(rows, part, order, value, window)
        merged = _merge(F.col("__older"), {k: F.col(f"__{k}") for k in _PARTS})
        return rolled.withColumns(_statistics(merged)).drop("__older", *[f"__{k}" for k in _PARTS])

    return over_series(df, keys, order, window - 1, compute, hot_rows, block_rows)


def _line_weights(period: int) -> list[float]:
    """Weights, newest value first, of the least-squares line read one step ahead."""
    centre = (period + 1) / 2
    spread = sum((i - centre) ** 2 for i in range(1, period + 1))
    ahead = period + 1 - centre
    return [1 / period + ahead * (i - centre) / spread for i in range(period, 0, -1)]


def _line_ahead(x: Column, series, period: int, behind: int = 0) -> Column:
    terms = [w * F.lag(x, i + behind).over(series) for i, w in enumerate(_line_weights(period))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def forecast(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    period: int = FORECAST_PERIOD,
    hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``tsf_next`` (line forecast of the next value) and ``statistical_oscillator``.

    Until enough values are known both columns repeat the value. The oscillator
    is the relative error, in percent, of the forecast made one row earlier.
    """
    x = F.col(value).cast("double")

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        series = Window.partitionBy(*part).orderBy(*order)
        ahead = _line_ahead(x, series, period)
        before = _line_ahead(x, series, period, behind=1)
        known = F.row_number().over(series)
        return rows.withColumns({
            "tsf_next": F.when(known >= period, ahead).otherwise(x),
            "statistical_oscillator": F.when(known <= period, x).otherwise(
                F.try_divide(100.0 * (x - before), x)
            ),
        })

    return over_series(df, keys, order, period, compute, hot_rows, block_rows)


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: int,
    hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``sma``: the mean of the last ``period`` values, NULL until there are as many."""
    x = F.col(value).cast("double")

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(period - 1), 0)
        return rows.withColumn("sma", F.when(F.count(x).over(frame) == period, F.avg(x).over(frame)))

    return over_series(df, keys, order, period - 1, compute, hot_rows, block_rows)


def consistency(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: float = CONSISTENCY_LIMIT,
    min_samples: int = 0, window: int = SERIES_LENGTH,
    hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``consistent``: whether the spread of the last values stays within ``limit``."""
    kept = df.columns
    stats = rolling_stats(df, keys, order, value, window, hot_rows, block_rows)
    enough = F.col("n_of_samples") + 1 >= min_samples
    return stats.withColumn("consistent", enough & F.coalesce(F.col("std_dev") <= limit, F.lit(False))).select(
        *kept, "std_dev", "consistent"
    )


def enrich_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS, buffer: bool = False,
) -> DataFrame:
    """Statistics and forecasts together, over one shuffle on the series key.

    ``buffer`` also adds the last 128 values themselves, for per-record detection.
    """

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        done = forecast(rows, part, order, value, hot_rows=None)
        if buffer:
            frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(SERIES_LENGTH - 1), 0)
            done = done.withColumn("buffer", F.collect_list(F.col(value).cast("double")).over(frame))
        return rolling_stats(done, part, order, value, hot_rows=None)

    return over_series(df, keys, order, SERIES_LENGTH - 1, compute, hot_rows, block_rows)
