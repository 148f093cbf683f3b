import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from awkward import EDGE, SCHEMA  # noqa: E402

def table(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), "s", None, 1, "p", 2, 0.5, "z", "t", "b", "d", "B", 3, 4, "r") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge(spark):
    return table(spark, EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """The smallest test table, with plain rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, sorted((r.doc_id, r.text) for r in df.collect())
