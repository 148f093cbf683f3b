"""Ways to keep one hot series from landing in one task.

Series operators look back over a bounded number of rows. A series that is too
long for one task is cut into blocks of consecutive rows, and each block also
receives the last ``lookback`` rows before it. Results are those of the uncut
series. Series below the limit take one plain shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.session import ensure_checkpoint_dir

HOT_ROWS = 4_000_000
BLOCK_ROWS = 1_000_000
# Partitions of the range exchange. Blocks are cut from positions, so their size does not depend on it.
MAX_RANGES = 10_000


def split_hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(cold rows, hot rows or None, number of hot rows).

    One aggregate over the key columns alone; a single summary row reaches the
    driver. The list of hot keys is joined without a hint, so Spark broadcasts
    it only when its measured size allows.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
    found, total = hot.agg(F.count("*"), F.sum("__n")).first()
    if not found:
        return df, None, 0
    names = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])
    return df.join(names, same, "left_anti"), df.join(names, same, "left_semi"), total


def consecutive_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, block_rows: int, total: int
) -> DataFrame:
    """Cut rows, sorted by key and order, into blocks of ``block_rows`` rows.

    Adds ``__block`` and ``__carry``; a carry row is a copy of one of the
    ``lookback`` rows before the block. The range exchange picks its bounds by
    sampling, so its outcome is pinned with a checkpoint before it is read twice.
    """
    if block_rows < max(lookback, 1):
        raise ValueError("a block must hold at least the rows that are looked back at")
    ensure_checkpoint_dir(df.sparkSession)
    ranges = min(max(1, -(-total // block_rows)), MAX_RANGES)
    placed = (
        df.repartitionByRange(ranges, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__row", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("__range", F.shiftright("__row", 33))
    )
    # One row per range: at most ``ranges`` rows, whatever the data size.
    offsets = placed.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    position = F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(offsets), "__range").withColumn("__pos", position)
    block = F.floor(F.col("__pos") / block_rows).cast("bigint")
    near_end = F.pmod("__pos", F.lit(block_rows)) >= block_rows - lookback
    target = F.when(near_end & F.lit(lookback > 0), F.array(block, block + 1)).otherwise(F.array(block))
    return numbered.select("*", F.posexplode(target).alias("__copy", "__block")).withColumn(
        "__carry", F.col("__copy") > 0
    ).drop("__range", "__row", "__before", "__pos", "__copy")


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``compute(rows, partition_columns)`` per series, cutting hot series into blocks.

    ``compute`` must only look at the current row and the ``lookback`` rows before
    it. ``order`` must be unique within a key. ``hot_rows=None`` skips the check.
    """
    if hot_rows is None or df.isStreaming:
        return compute(df, list(keys))
    cold, hot, total = split_hot_keys(df, keys, hot_rows)
    if hot is None:
        return compute(df, list(keys))
    blocks = consecutive_blocks(hot, keys, order, lookback, block_rows, total)
    done = compute(blocks, [*keys, "__block"]).where(~F.col("__carry")).drop("__block", "__carry")
    return compute(cold, list(keys)).unionByName(done)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, spread: int = 64) -> DataFrame:
    """The newest ``n`` rows per key, reduced in two steps.

    Each key is first reduced within ``spread`` sub-groups, so the final step
    sees at most ``spread * n`` rows per key however large the key is.
    """
    latest = [F.desc(c) for c in order]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(spread)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*latest)
    kept = salted.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    final = Window.partitionBy(*keys).orderBy(*latest)
    return kept.withColumn("__rn", F.row_number().over(final)).where(F.col("__rn") <= n)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each of ``values`` becomes its sum over the key's rows up to and with this one, in an order that no two rows of a key share.

    A key with very many rows is spread over ranges of the order: sums run inside a range, and one row a key and range carries
    what lies before it. The ranges come from a sample, so they are pinned before they are read twice. Keys must not be null.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"__of_{v}") for v in values]).select(
        *keys, "__range", *[F.coalesce(F.sum(f"__of_{v}").over(earlier), F.lit(0)).alias(f"__before_{v}") for v in values]
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({v: F.sum(v).over(inside) for v in values}).join(carried, [*keys, "__range"])
    return summed.withColumns({v: F.col(v) + F.col(f"__before_{v}") for v in values}).select(*df.columns)
