"""User functions that fail on some rows."""

import pandas as pd
import pytest

from pulseframe.operators.attempts import accepted, by_halves, rejects, try_filter, try_transform

ROWS = [(i, x, f"t{i}") for i, x in enumerate([4, 0, None, 5, 0, 10, -2])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, x int, error_text string").repartition(3)


def test_filter_sends_failures_away(rows):
    done = try_filter(rows, lambda f: pd.Series([20 % int(x) == 0 for x in f["x"]]), ["x"]).cache()
    assert sorted(r.id for r in accepted(done).collect()) == [0, 3, 5, 6] and accepted(done).columns == rows.columns
    failed = {r.id: r.error.split(":")[0] for r in rejects(done).collect()}
    assert failed == {1: "ZeroDivisionError", 2: "ValueError", 4: "ZeroDivisionError"}
    assert done.where("error is null and not kept").count() == 0 and done.count() == len(ROWS)


def test_filter_without_a_decision(rows):
    done = try_filter(rows, lambda f: pd.Series([None if i == 3 else i > 3 for i in f["id"]], dtype=object), ["id"])
    assert {r.id: (r.kept, r.error) for r in done.collect()} == {i: (i > 3, "TypeError: neither true nor false" if i == 3 else None) for i in range(7)}


def test_transformation_keeps_what_it_could_not_change(rows):
    def change(frame):
        if frame["x"].isna().any():
            raise LookupError("no value")
        return frame.assign(x=frame["x"] * 2, twice=[f"{t}{t}" for t in frame["error_text"]])

    done = try_transform(rows, change, ["x", "error_text"], {"x": "int", "twice": "string"})
    assert done.columns == ["id", "x", "error_text", "twice", "error"]
    want = {i: (None if x is None else x * 2, None if x is None else t + t, "LookupError: no value" if x is None else None) for i, x, t in ROWS}
    assert {r.id: (r.x, r.twice, r.error) for r in done.collect()} == want


def test_wrong_number_of_rows_is_a_failure(rows):
    done = try_transform(rows, lambda f: f.iloc[:0], ["x"], {"x": "int"})
    assert accepted(done).isEmpty() and {r.id: r.x for r in rejects(done).collect()} == {i: x for i, x, _ in ROWS}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x int")
    assert try_filter(empty, lambda f: f["x"] > 0, ["x"]).count() == 0


def test_few_failures_cost_few_calls():
    calls = []

    def work(frame):
        calls.append(len(frame))
        if (frame["x"] == 777).any():
            raise ValueError("bad")
        return frame

    parts = by_halves(work, pd.DataFrame({"x": range(1024)}))
    assert sum(n for _, n, _ in parts) == 1024 and [e for _, _, e in parts if e] == ["ValueError: bad"] and len(calls) == 21
