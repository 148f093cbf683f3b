"""Joins on awkward inputs: open ranges, both plans of a range table, swaps, bands of very different widths."""

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import joins
from pulseframe.operators.routing import merge_enrichment
from pulseframe.operators.scale import running_sums

INF = float("inf")
RANGES = [(100.0, INF, "high", 1), (-INF, 0.0, "low", 2), (0.0, 10.0, "some", 3), (5.0, 20.0, "more", 4), (3.0, 3.0, "none", 5)]


@pytest.mark.parametrize("limit", [0, 1_000])
def test_open_ranges_by_both_plans(spark, limit):
    values = [-1e300, -0.5, 0.0, 7.0, 12.0, 20.0, 99.9, 100.0, 1e300, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    ranges = spark.createDataFrame(RANGES, "lo double, hi double, label string, seq int")
    out = joins.label_by_range_table(df, "v", ranges, broadcast_rows=limit)
    assert out.columns == ["i", "v", "label"]
    assert [r.label for r in out.orderBy("i").collect()] == ["low", "low", "some", "some", "more", None, None, "high", "high", None]


def test_only_open_ranges(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "v double")
    ranges = spark.createDataFrame([(0.0, INF, "up", 1)], "lo double, hi double, label string, seq int")
    assert {r.v: r.label for r in joins.label_by_range_table(df, "v", ranges).collect()} == {1.0: "up", -1.0: None}


def test_bands_of_any_width_meet_once(spark):
    a = spark.createDataFrame([("k", v) for v in (0.0, 1.0, 50.0, 1e9, -3.0)], "k string, x double")
    b = spark.createDataFrame([("k", v) for v in (0.0, 1.2, 49.0, 1e9 + 1, -2.9, 7e8)], "k string, y double")
    out = joins.band_overlap_join(a, b, ["k"], "x", "y", 0.3, 0.5)

    def band(v, q):
        return tuple(sorted((v - v * q / 2, v + v * q / 2)))

    want = sorted(
        (x, y) for x in (0.0, 1.0, 50.0, 1e9, -3.0) for y in (0.0, 1.2, 49.0, 1e9 + 1, -2.9, 7e8)
        if band(x, 0.3)[0] <= band(y, 0.5)[1] and band(y, 0.5)[0] <= band(x, 0.3)[1]
    )
    assert sorted((r.x, r.y) for r in out.collect()) == want


def test_merge_keeps_sibling_fields(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")).alias("log"), F.lit(3).alias("n")).alias("analytical_data"))
    out = merge_enrichment(df, log=F.struct(F.lit(9).alias("b"), F.lit("x").alias("c"))).first().analytical_data
    assert out.asDict(recursive=True) == {"log": {"a": 1, "b": 9, "c": "x"}, "n": 3}


def test_overlap_counts_on_one_hot_key(spark):
    dice = random.Random(4)
    price = lambda: dice.choice([0.0, 1.0, 1.005, -7.0, round(dice.uniform(-50, 50), 2)])
    left = [("hot" if dice.random() < 0.9 else "cold", price()) for _ in range(400)] + [("hot", None), (None, 1.0), ("alone", 1.0)]
    right = [("hot" if dice.random() < 0.9 else "cold", price()) for _ in range(300)] + [("hot", None), (None, 1.0)]
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "i int, k string, x double")
    b = spark.createDataFrame(right, "k string, y double").repartition(5)

    def band(v, q):
        return sorted((v - v * q / 2, v + v * q / 2))

    def meet(x, y):
        return band(x, 0.3)[0] <= band(y, 0.5)[1] and band(y, 0.5)[0] <= band(x, 0.3)[1]

    want = [sum(k is not None and k == j and None not in (x, y) and meet(x, y) for j, y in right) for k, x in left]
    out = joins.band_overlap_counts(a, b, ["k"], "x", "y", 0.3, 0.5)
    assert out.columns == ["i", "k", "x", "meets"]
    assert [r.meets for r in out.orderBy("i").collect()] == want and max(want) > 50


def test_running_sums_over_ranges(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, at int, n long").repartition(4)
    out = running_sums(df, ["k"], ["at"], ["n"])
    assert {(r.k, r.at): r.n for r in out.collect()} == {(k, i): sum(n for j, at, n in rows if j == k and at <= i) for k, i, _ in rows}


def _equi_join_inputs(df):
    """The plan as it was made, without what running it would adapt."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_filed_bands_are_not_broadcast(spark, tmp_path):
    # The table is small, the bands filed from it are not: only the sizes under a key may be sent to every task.
    spark.range(2_000).selectExpr("id % 3 as k", "id + 0.5 as x").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    out = joins.band_overlap_join(t, t.withColumnRenamed("x", "y"), ["k"], "x", "y", 0.01, 0.02)
    assert "SortMergeJoin [k" in _equi_join_inputs(out)
    rows = [(i % 3, i + 0.5) for i in range(2_000)]
    want = sum(j == k and x - x * 0.005 <= y + y * 0.01 and y - y * 0.01 <= x + x * 0.005 for k, x in rows for j, y in rows)
    assert out.count() == want


def test_bands_are_filed_for_sizes_under_their_key_only(spark, monkeypatch):
    a = spark.createDataFrame([(str(k), float(2 ** (k % 30))) for k in range(300)] + [("0", None), (None, 1.0), ("alone", 1.0)], "k string, x double")
    b = a.select("k", (F.col("x") * 1.01).alias("y"))
    monkeypatch.setattr(joins, "BROADCAST_SEGMENTS", 0)
    out = joins.band_overlap_join(a, b, ["k"], "x", "y", 0.1, 0.1)
    assert sorted((r.k, r.x) for r in out.collect()) == sorted((str(k), float(2 ** (k % 30))) for k in range(300)) + [("alone", 1.0)]
    zero = joins.band_overlap_join(a, a.select("k", F.col("x").alias("y")), ["k"], "x", "y", 0.0, 0.0)
    assert zero.count() == 301 and zero.where("same and contains").count() == 301
