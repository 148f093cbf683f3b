"""Places of rows in one global order per group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def running_start(
    df: DataFrame, groups: list[str], order: list[str], amount: Column, name: str, cells: int = CELLS, seed: int = 7
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the group that come before.

    A group's order is pseudo-random but fixed: by a hash of ``order`` (unique within a group), cut into ``cells``. Sums
    per cell give each cell its start, and rows only meet the others of their cell, so a group that holds a third of all
    rows is still spread over ``cells`` pieces. The table of cells has at most groups x ``cells`` rows.
    """
    keys = [*groups, "__cell"]
    hashed = df.withColumn("__amount", amount).withColumn("__hash", F.xxhash64(F.lit(seed), *order))
    hashed = hashed.withColumn("__cell", F.pmod("__hash", F.lit(cells)))
    inside = Window.partitionBy(*keys).orderBy("__hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    earlier = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*keys).agg(F.sum("__amount").alias("__sum"))
        .withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"__at_{k}") for k in keys], "__start")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__at_{k}"))
    return placed.join(starts, same).withColumn(name, F.col("__start") + F.col("__inside")).drop(
        *[f"__at_{k}" for k in keys], "__start", "__inside", "__cell", "__hash", "__amount"
    )
