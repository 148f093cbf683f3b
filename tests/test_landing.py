"""Files of a table as a stream finds them."""

from pathlib import Path

import pyarrow.parquet as pq

from pulseframe.plans import stream_queries


def test_a_longer_table_lands_in_more_files(spark, tmp_path):
    """A file, and so the task that reads or writes it, has a bounded number of rows, and files follow each other in time."""
    rows = spark.range(6_000).selectExpr("(id * 7919) % 6000 as at", "id as event_id", "cast(id as string) as props").repartition(3)
    path = str(tmp_path / "in")
    stream_queries._land(rows, "at", path, file_rows=300)
    landed = sorted(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    at = [pq.read_table(f)["at"].to_pylist() for f in landed]
    assert len(at) == 20 and max(map(len, at)) <= 330
    assert all(max(a) < min(b) for a, b in zip(at, at[1:])) and sum(map(len, at)) == 6_000
    assert spark.read.parquet(path).dtypes == rows.dtypes


def test_a_table_without_rows_lands_too(spark, tmp_path):
    stream_queries._land(spark.createDataFrame([], "at long, x string"), "at", str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "in")).count() == 0
