"""Rolling statistics and forecasts: hand-computed cases, edges, and hot series cut into blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import rolling, snapshot
from pulseframe.operators.scale import newest


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "key string, i bigint, x double")


def stats(spark, values, **kw):
    return rolling.rolling_stats(series(spark, values), ["key"], ["i"], "x", **kw).orderBy("i").collect()


def test_three_values(spark):
    row = stats(spark, [1, 2, 4])[-1]
    assert row.n_of_samples == 3
    assert row["mean"] == pytest.approx(7 / 3) and row.geometric_mean == pytest.approx(2)
    assert row.harmonic_mean == pytest.approx(12 / 7) and row.quadratic_mean == pytest.approx(math.sqrt(7))
    assert row.variance == pytest.approx(7 / 3)


def test_one_value_has_no_spread(spark):
    row = stats(spark, [5])[0]
    assert row.std_dev is None and row.variance is None and row["mean"] == 5


def test_zero_and_negative_values(spark):
    rows = stats(spark, [3, 0, -1])
    assert rows[1].geometric_mean == 0 and rows[1].harmonic_mean == 0
    assert rows[2].geometric_mean is None and rows[2].harmonic_mean is None


@pytest.mark.parametrize("count", [1, 7, 127, 128, 129, 255, 256, 257, 400])
def test_window_of_128(spark, count):
    dice = random.Random(count)
    values = [dice.uniform(1, 9) for _ in range(count)]
    last = stats(spark, values)[-1]
    held = np.array(values[-128:])
    assert last.n_of_samples == len(held)
    assert last["mean"] == pytest.approx(held.mean()) and last.minimum == held.min() and last.maximum == held.max()
    if count > 1:
        assert last.variance == pytest.approx(held.var(ddof=1))


def test_old_outlier_leaves_no_trace(spark):
    rows = stats(spark, [1e300] + [1.0, 2.0] * 100)
    assert rows[-1].variance == pytest.approx(np.var([1.0, 2.0] * 64, ddof=1))


def test_forecast_of_a_line(spark):
    rows = rolling.forecast(series(spark, range(1, 10)), ["key"], ["i"], "x").orderBy("i").collect()
    assert [r.tsf_next for r in rows[:7]] == [1, 2, 3, 4, 5, 6, 7]
    assert rows[7].tsf_next == pytest.approx(9) and rows[8].tsf_next == pytest.approx(10)
    assert [r.statistical_oscillator for r in rows[:8]] == list(range(1, 9))
    assert rows[8].statistical_oscillator == pytest.approx(0)


def test_oscillator_of_zero_is_null(spark):
    rows = rolling.forecast(series(spark, [1] * 8 + [0]), ["key"], ["i"], "x").orderBy("i").collect()
    assert rows[8].statistical_oscillator is None


def test_weights_sum_to_one():
    assert sum(rolling._line_weights(8)) == pytest.approx(1)


def test_moving_average(spark):
    rows = rolling.moving_average(series(spark, [1, 2, 3, 4]), ["key"], ["i"], "x", 3).orderBy("i").collect()
    assert [r.sma for r in rows] == [None, None, 2, 3]


def test_consistency(spark):
    rows = rolling.consistency(series(spark, [1, 1, 1, 5]), ["key"], ["i"], "x").orderBy("i").collect()
    assert [r.consistent for r in rows] == [False, True, True, False]


@pytest.mark.parametrize("partitions", [3, 8])
@pytest.mark.parametrize("block_rows", [128, 500])
def test_hot_series_equal_uncut_ones(spark, partitions, block_rows):
    """One key with most rows, some short ones; ties of the time are broken by the id."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    dice = random.Random(block_rows)
    rows = [("hot" if i % 10 else f"k{i % 70}", i // 3, i, dice.uniform(1, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts bigint, id bigint, x double").repartition(5)
    cut = rolling.enrich_series(df, ["key"], ["ts", "id"], "x", hot_rows=200, block_rows=block_rows)
    uncut = rolling.enrich_series(df, ["key"], ["ts", "id"], "x", hot_rows=None)
    numbers = [c for c in uncut.columns if c not in ("key", "ts", "id")]
    pick = lambda d: {r.id: r for r in d.collect()}
    a, b = pick(cut), pick(uncut)
    assert cut.count() == 3000 and a.keys() == b.keys()
    for i in a:
        for c in numbers:
            assert (a[i][c] is None and b[i][c] is None) or a[i][c] == pytest.approx(b[i][c], rel=1e-9, abs=1e-9)
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_blocks_do_not_depend_on_the_ranges(spark, monkeypatch):
    from pulseframe.operators import scale

    df = spark.range(3000).select(F.lit("a").alias("key"), "id")
    monkeypatch.setattr(scale, "MAX_RANGES", 3)
    blocks = scale.consecutive_blocks(df, ["key"], ["id"], 5, 200, 3000)
    sizes = blocks.groupBy("__block").agg(F.count("*").alias("n"), F.count_if("__carry").alias("c"), F.min("id").alias("lo")).orderBy("__block").collect()
    assert [(r.n, r.c, r.lo) for r in sizes[:15]] == [(200, 0, 0)] + [(205, 5, 200 * b - 5) for b in range(1, 15)]


def test_blocks_must_hold_the_look_back(spark):
    with pytest.raises(ValueError):
        rolling.rolling_stats(series(spark, range(50)), ["key"], ["i"], "x", hot_rows=10, block_rows=100).count()


def test_newest_rows_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "a").otherwise("b").alias("key"), "id")
    kept = newest(df, ["key"], ["id"], 128).groupBy("key").agg(F.min("id"), F.max("id"), F.count("*")).orderBy("key").collect()
    assert [tuple(r) for r in kept] == [("a", 3872, 3999, 128), ("b", 4872, 4999, 128)]


def test_sample_is_oldest_first(spark):
    row = snapshot.recent_sample(series(spark, range(129)), ["key"], ["i"], "x").first()
    assert row.sample == [float(v) for v in range(1, 129)]


def test_snapshot_equals_last_rolling_row(spark):
    values = [random.Random(1).uniform(1, 5) for _ in range(200)]
    snap = snapshot.series_snapshot(series(spark, values), ["key"], ["i"], "x").first()
    last = stats(spark, values)[-1]
    assert snap.n_of_samples == 128 and snap.variance == pytest.approx(last.variance)


def test_time_span(spark):
    def span(values):
        df = series(spark, values)
        return snapshot.observed_span(df, ["key"], ["i"], F.col("x")).first()

    assert span([1.2, 5.9]).s is None
    assert span([1.2, 1.4, 1.9]).s is None
    row = span([1.2, 3.0, 5.9])
    assert (row.s, row.e, row.elapsed) == (1, 5, 4)
