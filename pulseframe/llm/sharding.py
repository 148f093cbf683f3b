"""Shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.positions import running_start

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
KEY_SHIFT = 33
RANGE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. All keys jump together; one leaves as soon as it would land beyond the last shard."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    while len(left):
        key[left] = key[left] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = RANGE / ((key[left] >> np.uint64(KEY_SHIFT)).astype(np.float64) + 1.0)
        jump = np.floor((bucket[left] + 1) * step)
        left = left[jump < shards]
        bucket[left] = jump[jump < shards].astype(np.int64)
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(jump_hash(batch.to_numpy(), shards).astype(np.int32))

    return assign(key)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    The key and the number of shards alone decide; with one more shard (``grown_shard``) a row stays or goes to the new
    one. A null key counts as 0. ``size`` is the UTF-8 bytes of the text (null: none) plus 16, ``text_crc32`` that of the
    text (null: of no bytes). Slots number a shard's rows from 0 without gaps, in a fixed pseudo-random order; repeated
    rows share a shard and have slots of their own. Other columns are left out, so none can clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    stable = F.coalesce("doc_id", F.lit(0)).cast("bigint")
    placed = rows.withColumn("shard", shard_of(stable, shards)).withColumn("grown_shard", shard_of(stable, shards + 1))
    slotted = running_start(placed, ["shard"], ["doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )
