"""Importance resampling towards a target distribution, over hashed words and word pairs (Xie et al., 2023).

Every text goes through Arrow kernels: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the words of a
chunk, ``dictionary_encode`` their numbers. Neighbouring numbers, one shifted against the other, are the pairs; only
distinct words and distinct pairs are hashed (CRC-32). ``take`` fetches what a bucket is worth, and sums per segment give
each document its weight.

1. One pass counts the buckets of the documents (source) and of the target's texts. A table of ``BUCKETS`` rows reaches
   the driver, which turns it into one gain a bucket.
2. A second pass weighs the documents. A document's noise is a Gumbel variable from the hash of its id, so the highest
   scores are a sample without replacement in proportion to the weights.
3. Ranks. Scores are counted in cells, whose number the range of gains bounds. Only cells that can hold drawn documents
   are sorted, by range, and a row's rank is the size of the ranges before its own plus its place in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text
from pulseframe.session import ensure_checkpoint_dir, scratch_path

BUCKETS = 10_000
#: What lies between words once A-Z is in lower case: all ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Scores that are counted together.
CELL = 64
RANGE_ROWS = 1_000_000


class Features:
    """Words and word pairs of a chunk of texts: per text their number, and the bucket of each."""

    def __init__(self, texts: pa.Array) -> None:
        parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
        words, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
        filled = pc.greater(pc.binary_length(words), 0)
        coded = pc.filter(words, filled).dictionary_encode()
        row = pc.filter(row, filled).to_numpy(zero_copy_only=False).astype(np.int64)
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        self.rows = len(texts)
        self.n_words = np.bincount(row, minlength=self.rows)
        # A word's hash goes on into those of the pairs that it begins.
        single = np.fromiter(map(crc32, names), np.int64, len(names))
        begun = [crc32(b" ", h) for h in single.tolist()]
        first = np.flatnonzero(row[1:] == row[:-1])
        pairs, which = np.unique(number[first] * len(names) + number[first + 1], return_inverse=True)
        left, right = np.divmod(pairs, max(1, len(names)))
        double = np.fromiter((crc32(names[b], begun[a]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.int64, len(pairs))
        self.row = np.concatenate([row, row[first]])
        self.bucket = np.concatenate([(single % BUCKETS)[number], (double % BUCKETS)[which]])
        self.n_features = np.bincount(self.row, minlength=self.rows)

    def totals(self, gains: pa.Array) -> np.ndarray:
        """Sum of gains over each text's features."""
        order = np.argsort(self.row, kind="stable")
        running = np.zeros(len(order) + 1, np.int64)
        np.cumsum(gains.take(pa.array(self.bucket[order])).to_numpy(), out=running[1:])
        ends = np.cumsum(self.n_features)
        return running[ends] - running[ends - self.n_features]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all features of a column of texts; a task adds its own up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for chunk in spans.chunks(batches):
            total += np.bincount(Features(chunk.column(0)).bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int]) -> list[int]:
    """Gain of each bucket: how much more frequent it is in the target, in thousandths of a natural logarithm, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [
        math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + BUCKETS) / (float(source.get(b, 0) + 1) * float(t_all + BUCKETS))))
        for b in range(BUCKETS)
    ]


def fit_gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """Gains of a target's texts against those of the documents; ``BUCKETS`` rows of each reach the driver."""
    both = bucket_counts(docs).withColumn("target", F.lit(False)).unionByName(bucket_counts(target).withColumn("target", F.lit(True)))
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in both.collect():
        counts[r["target"]][r["bucket"]] = r["n"]
    return gains_of(*counts)


def weigh_documents(docs: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = pa.array(gains, pa.int64())
        for chunk in spans.chunks(batches):
            f = Features(chunk.column(1))
            weight = f.totals(worth) // np.maximum(f.n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), *(pa.array(c.astype(np.int64)) for c in (f.n_words, f.n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    weighed = id_and_text(docs).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample_documents(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, gains: list[int] | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with ``least_words`` words, the ``percent`` in a hundred (rounded down) with the highest scores are
    drawn and ranked from 1; ties go to the smaller doc_id (null last, then by row). All others have no rank. A text
    without words (null: empty) has no features and weight 0. Repeated rows are documents of their own, with equal scores
    and consecutive ranks. An empty target or no documents are no error. Columns besides doc_id and text are not read.
    ``gains`` defaults to those fitted on the same documents.
    """
    spark = docs.sparkSession
    scored = weigh_documents(docs, fit_gains(docs, target) if gains is None else gains, seed)
    # Scores are written once, with a number for each row: both passes below see the same rows in the same order.
    path = scratch_path(spark, "scores")
    scored.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    cell = F.floor(F.col("score") / CELL)
    fit = F.col("n_words") >= least_words
    held = {r["cell"]: r["n"] for r in scored.where(fit).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    wanted = percent * sum(held.values()) // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    lowest, total = 0, 0
    for lowest in sorted(held, reverse=True):
        total += held[lowest]
        if total >= wanted:
            break
    high = F.coalesce(fit & (cell >= lowest), F.lit(False))
    ordered = scored.where(high).withColumn("__down", -F.col("score")).withColumn("__none", F.col("doc_id").isNull())
    ranked = consecutive_ranks(ordered, ["__down", "__none", "doc_id", "place"], total)
    rank = F.when(F.col("rank") <= wanted, F.col("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def consecutive_ranks(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3 ... in an order that no two share, without a window over all of them.

    The bounds of the ranges come from a sample, so their outcome is pinned before it is read twice.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = (
        rows.repartitionByRange(max(1, -(-total // RANGE_ROWS)), *order)
        .sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("__range", F.shiftright("__row", 33))
    )
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    starts = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(starts, "__range").withColumn("rank", F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
