"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w . x): all grades share the weights of the hashed text, and ordered thresholds cut
the common scale. Features are binary: each distinct word of a document, hashed to ``BINS``, and thermometer codes of a few
shares (symbols, capitals, repeats) and of the length. Weights are fitted by follow-the-regularised-leader steps with an L1
term, which leaves most of them at zero. The fit takes a sample of at most ``SAMPLE`` rated documents, those with the least
hash of their doc_id, in one task; scoring takes all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.quality_rules import measures
from pulseframe.llm.tables import id_and_text

BINS = 1 << 22
SAMPLE = 20_000
EPOCHS = 6
RATE, SMOOTH, L2 = 1.0, 1.0, 0.1
#: L1 terms of the codes, which are few, and of the words, most of which say nothing.
CODE_L1, WORD_L1 = 0.1, 8.0
#: Bins of the codes come before those of the words.
CODES = 128
KEEP_PROBABILITY = 0.5

WORD_BREAK = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8)
LENGTHS = (1, 5, 10, 20, 50, 100, 500, 2_000)


@dataclass(frozen=True)
class GradeModel:
    """Weights that are not zero, by bin, and the ordered thresholds between grades."""

    bins: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BINS, np.float32)
        out[self.bins] = self.weights
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """[document, k]: P(grade > k)."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def features(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of each row's features, by row, without repeats; with ``keep``, only of the bins marked there."""
    low = spans.LOWER[data]
    starts, ends, row = spans.words(low, bounds, WORD_BREAK)
    bins = CODES + (spans.range_hash(spans.prefix_hash(low), starts, ends) % np.uint64(BINS - CODES)).astype(np.int64)
    m = measures(data, bounds)
    total = np.maximum(m["word_chars"], 1)
    codes = [(m["n_words"], np.array(LENGTHS) - 0.5)]
    shares = (m["n_symbols"] / total, m["n_capitals"] / total, m["n_shouts"] / total, m["n_repeat_words"] / np.maximum(m["n_words"], 1), m["n_dup_lines"] / np.maximum(m["n_lines"], 1))
    codes += [(s, np.array(SHARES)) for s in shares]
    all_rows, all_bins = [row], [bins]
    for k, (value, steps) in enumerate(codes):
        at, step = np.nonzero(value[:, None] > steps[None, :])
        all_rows.append(at)
        all_bins.append(k * len(SHARES) + step)
    row, bins = np.concatenate(all_rows), np.concatenate(all_bins)
    if keep is not None:
        wanted = keep[bins]
        row, bins = row[wanted], bins[wanted]
    pair = np.unique(row.astype(np.int64) * BINS + bins)
    return pair // BINS, pair % BINS


def fit(documents: list[np.ndarray], grades: np.ndarray, levels: int, seed: int = 5) -> GradeModel:
    """The model of documents (arrays of bins) with grades 0 to ``levels`` - 1."""
    z, n, w = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
    l1 = np.where(np.arange(BINS) < CODES, CODE_L1, WORD_L1)
    share = (np.cumsum(np.bincount(grades, minlength=levels))[:-1] + 1.0) / (len(grades) + levels)
    thresholds = np.maximum.accumulate(np.log(share / (1 - share)) + 0.01 * np.arange(levels - 1))
    squares = np.ones(levels - 1)
    order = np.random.default_rng(seed)
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(EPOCHS):
        for i in order.permutation(len(documents)):
            x, y = documents[i], int(grades[i])
            score = w[x].sum()
            above = sigmoid(thresholds[y] - score) if y < levels - 1 else 1.0
            below = sigmoid(thresholds[y - 1] - score) if y else 0.0
            p = max(above - below, 1e-12)
            g = 1.0 - above - below  # of the negative log-likelihood in the score
            step = np.sqrt(n[x] + g * g)
            z[x] += g - (step - np.sqrt(n[x])) / RATE * w[x]
            n[x] += g * g
            w[x] = np.where(np.abs(z[x]) <= l1[x], 0.0, (np.sign(z[x]) * l1[x] - z[x]) / ((SMOOTH + np.sqrt(n[x])) / RATE + L2))
            for k, slope in ((y, above * (1 - above) / p), (y - 1, -below * (1 - below) / p)):
                if 0 <= k < levels - 1:
                    squares[k] += slope * slope
                    thresholds[k] += RATE * slope / np.sqrt(squares[k])
            thresholds = np.maximum.accumulate(thresholds)
    used = np.flatnonzero(w)
    return GradeModel(used, w[used].astype(np.float32), thresholds)


def fit_grades(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE) -> GradeModel:
    """Fit on at most ``sample`` of the ratings (doc_id, grade). Ratings without a document or a grade do not count."""
    rated = ratings.where(F.col("grade").between(0, levels - 1)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # At most ``sample`` rows of two numbers.
    marked = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "grade", F.xxhash64("doc_id", "text").alias("order"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in spans.chunks(batches):
            row, bins = features(*spans.text_bytes(chunk.column(0)))
            cuts = np.searchsorted(row, np.arange(chunk.num_rows + 1))
            packed = [bins[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), chunk.column(1), chunk.column(2)], names=["bins", "grade", "order"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, grades = [], []
        for batch in batches:
            documents += [np.frombuffer(b, np.int32) for b in batch.column(0).to_pylist()]
            grades += batch.column(1).to_pylist()
        if not documents:
            return
        model = fit(documents, np.array(grades), levels)
        parts = [model.bins.astype(np.int32), model.weights.astype(np.float32), model.thresholds.astype(np.float64)]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["bins", "weights", "thresholds"])

    found = (
        marked.mapInArrow(extract, "bins binary, grade int, order long").repartition(1).sortWithinPartitions("order", "grade")
        .mapInArrow(train, "bins binary, weights binary, thresholds binary").first()
    )
    if found is None:  # nothing rated: every grade is as likely as the others
        share = np.arange(1, levels) / levels
        return GradeModel(np.empty(0, np.int32), np.empty(0, np.float32), np.log(share / (1 - share)))
    return GradeModel(np.frombuffer(found[0], np.int32), np.frombuffer(found[1], np.float32), np.frombuffer(found[2], np.float64))


def score_grades(docs: DataFrame, model: GradeModel, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """One row per document: doc_id, expected_grade, tails (P(grade > k) for each k), kept.

    ``kept``: the best grade has at least the probability ``keep``. Null and empty texts are scored by their length alone;
    repeated rows repeat their result; columns besides doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        used = weights != 0
        for chunk in spans.chunks(batches):
            row, bins = features(*spans.text_bytes(chunk.column(1)), keep=used)
            tails = model.tails(np.bincount(row, weights[bins], minlength=chunk.num_rows))
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(tails.sum(1)), pa.array(tails.tolist(), pa.list_(pa.float64())), pa.array(tails[:, -1] >= keep)],
                names=["doc_id", "expected_grade", "tails", "kept"],
            )

    return id_and_text(docs).mapInArrow(score, f"doc_id {kind}, expected_grade double, tails array<double>, kept boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; a label that says neither counts for nothing."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where(F.col("grade").isNotNull())
