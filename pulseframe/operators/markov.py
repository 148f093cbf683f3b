"""Markov chain forecasts over the recent values of each series."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.model import MARKOV_ORDER, MARKOV_STEPS, SERIES_LENGTH
from pulseframe.operators.scale import BLOCK_ROWS, HOT_ROWS, over_series
from pulseframe.operators.snapshot import recent_sample


def transitions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, states: int = MARKOV_ORDER,
    step: float | None = None, hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, state, next, n): how often each run of ``states`` values is followed by a value.

    ``step`` rounds values down to its multiples, so that runs of measured values repeat.
    """
    x = F.col(value).cast("double")
    seen = df.select(*keys, *order, (x if step is None else F.floor(x / step) * step).alias("next"))

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        series = Window.partitionBy(*part).orderBy(*order)
        run = [F.lag("next", i).over(series) for i in range(states, 0, -1)]
        return rows.withColumns({"state": F.array(*run), "__known": F.row_number().over(series)})

    runs = over_series(seen, keys, order, states, compute, hot_rows, block_rows)
    return runs.where(F.col("__known") > states).groupBy(*keys, "state", "next").agg(F.count("*").alias("n"))


def _chain(values: list[float], states: int, steps: int, seed: int | None, latest: bool) -> list[float]:
    """Follow the chain; ``latest`` starts at the newest run and shortens it while it was never left."""
    padded = [None] * states + list(values)
    follow: dict[tuple, Counter] = defaultdict(Counter)
    for size in range(1, states + 1):
        for at in range(states, len(padded)):
            follow[tuple(padded[at - size:at])][padded[at]] += 1
    import random

    dice = None if seed is None else random.Random(seed)
    run = tuple(padded[-states:]) if latest else (None,) * states
    out: list[float] = []
    while len(out) < steps:
        state = run
        while latest and state and state not in follow:
            state = state[1:]
        choices = follow.get(state)
        if not choices:
            break
        if dice is None:
            chosen = min(choices, key=lambda v: (-choices[v], v))
        else:
            chosen = dice.choices(sorted(choices), [choices[v] for v in sorted(choices)])[0]
        out.append(chosen)
        run = (*run[1:], chosen)
    return out


def forecast_column(
    sample, states: int = MARKOV_ORDER, steps: int = MARKOV_STEPS, seed: int | None = None, latest: bool = False
):
    """Forecast of an array of at most 128 values, oldest first.

    A chain that starts before the oldest value has seen each of its first ``states`` states once, so that many steps are
    the first values themselves, with any seed, and take no Python.
    """
    if not latest and steps <= states:
        return F.slice(sample.cast("array<double>"), 1, steps)

    @F.pandas_udf("array<double>")
    def follow(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: None if s is None else _chain(list(s), states, steps, seed, latest))

    return follow(sample)


def markov_forecast(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, states: int = MARKOV_ORDER,
    steps: int = MARKOV_STEPS, seed: int | None = None, latest: bool = False, n: int = SERIES_LENGTH,
) -> DataFrame:
    """(keys, forecast) of each series' recent buffer.

    The chain starts before the oldest value; ``latest`` makes it go on from the
    newest one. Without a seed the most frequent successor is taken, the smaller
    value first in a tie.
    """
    recent = recent_sample(df.withColumn(value, F.col(value).cast("double")), keys, order, value, n)
    return recent.select(*keys, forecast_column(F.col("sample"), states, steps, seed, latest).alias("forecast"))


def generated(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, states: int = MARKOV_ORDER, steps: int = MARKOV_STEPS,
    paths: int = 1, seed: int = 0, step: float | None = None, hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, path, step, value): values drawn from the transitions of each whole series, ``paths`` ways on from its newest run.

    A successor is drawn in proportion to its count, by a hash of seed, keys, path and step, so reruns agree. A path ends at a
    run that was never left; a series of fewer than ``states`` values has none. Each step is one join with the counts.
    """
    counts = transitions(df, keys, order, value, states, step, hot_rows, block_rows)
    run = Window.partitionBy(*keys, "state")
    chances = counts.withColumns({
        "__upto": F.sum("n").over(run.orderBy("next")), "__total": F.sum("n").over(run),
    }).checkpoint().select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("state").alias("__from"), "next", "n", "__upto", "__total")
    x = F.col(value).cast("double")
    newest = recent_sample(df.withColumn(value, x if step is None else F.floor(x / step) * step), keys, order, value, states)
    at = newest.where(F.size("sample") == states).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(paths - 1).cast("bigint"))).alias("path"), F.col("sample").alias("__run"),
        F.array().cast("array<double>").alias("__drawn"),
    )
    names = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    for number in range(1, steps + 1):
        dice = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *names, F.col("path").cast("string"), F.lit(str(number)))), 1, 8), 16, 10).cast("bigint")
        at = at.withColumn("__dice", dice)
        draw = F.col("__dice") % F.col("__total")
        met = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__run") == F.col("__from")]
        drawn = at.join(chances, [*met, draw >= F.col("__upto") - F.col("n"), draw < F.col("__upto")], "left")
        moved = F.col("next").isNotNull()
        at = drawn.select(
            *keys, "path", F.when(moved, F.concat(F.slice("__run", 2, states), F.array("next"))).alias("__run"),
            F.when(moved, F.concat("__drawn", F.array("next"))).otherwise(F.col("__drawn")).alias("__drawn"),
        )
    found = at.select(*keys, "path", F.posexplode("__drawn").alias("step", "value"))
    return found.withColumn("step", (F.col("step") + 1).cast("bigint"))
