"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule rejects a document when a signal reaches its cutoff. A cutoff of a rule is certified for a stratum (a language)
if, on the stratum's labelled good documents, an exact binomial test refutes that the rule rejects more than its share of
the allowed false rejections. Shares: the limit is divided evenly among the rules, so a stratum's good documents are
rejected at most at the limit by all rules together; the error probability is divided among strata and rules
(Bonferroni), and the cutoffs of one rule are tested from the mildest to the strictest until the first failure (a fixed
sequence, which needs no further correction). Of the certified cutoffs, the one that rejects most labelled bad documents,
less ``good_cost`` times the good ones, is used, the mildest among equals. A stratum with too few labels to certify
anything rejects nothing beyond the base rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text
from pulseframe.session import ensure_checkpoint_dir

SYMBOLS = spans._mask(b"#*$%&|<>")
NEWLINE = spans._mask(b"\n")
CAPITALS = spans._mask(bytes(range(ord("A"), ord("Z") + 1)))
SHOUTS = spans._mask(b"!")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SPREAD = 256
TEXT_HASH = "__text_hash"

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_shouts long"
#: Signal of each rule as SQL over the metrics. All are shares, so one grid of cutoffs serves them.
RULES = {
    "symbols": "n_symbols / word_chars",
    "capitals": "n_capitals / word_chars",
    "shouts": "n_shouts / word_chars",
    "repeats": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
}
#: Cutoffs from the strictest to the mildest.
GRID = tuple(round(0.02 * 1.25**i, 4) for i in range(18))


def measures(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of each row of a chunk."""
    rows = len(bounds) - 1
    starts, ends, row = spans.words(data, bounds)
    solid = ~spans.SPACE[data]
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": spans.per_row(solid & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": spans.per_row(SYMBOLS[data], bounds),
    }
    line_start, line_end, line_row = spans.words(data, bounds, NEWLINE)
    word_before = np.searchsorted(starts, line_start)
    full = word_before < np.searchsorted(starts, line_end)
    line_row = line_row[full]
    keys = spans.mix(spans.range_names(data, line_start[full], line_end[full]) + line_row.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = lines - np.bincount(line_row[first], minlength=rows)
    window, at = spans.word_windows(spans.range_names(data, starts, ends), row, WINDOW)
    keys = spans.mix(window + row[at].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(row) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + WINDOW, -1)
    covered = np.cumsum(edges)[:-1] > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    out["n_lines"] = lines
    out["n_capitals"] = spans.per_row(CAPITALS[data], bounds)
    out["n_shouts"] = spans.per_row(SHOUTS[data], bounds)
    return out


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, stratum (the language, null: empty) and the metrics of every whole text; a null text has no words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in spans.chunks(batches):
            found = measures(*spans.text_bytes(chunk.column(1)))
            columns = [chunk.column(0), chunk.column(3), chunk.column(2), *[pa.array(v.astype(np.int64)) for v in found.values()]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", TEXT_HASH, "stratum", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = id_and_text(docs, F.coalesce("lang", F.lit("")).alias("stratum")).withColumn(TEXT_HASH, F.xxhash64("text"))
    return rows.mapInArrow(measure, f"doc_id {kind}, {TEXT_HASH} long, stratum string, {METRICS}").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), exactly, by a sum from the largest term."""
    if k >= n:
        return 0.0
    if k >= n * p:  # not in the lower tail: nothing to certify
        return 0.0
    i = np.arange(k, -1, -1, dtype=float)
    log_odds = math.log(p) - math.log1p(-p)
    ratio = np.log(i[:-1]) - np.log(n - i[1:]) - log_odds
    terms = np.concatenate([[0.0], np.cumsum(ratio)])
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    return top + math.log(np.exp(terms).sum())


def choose_cutoff(
    good: np.ndarray, bad: np.ndarray, n_good: int, limit: float, error: float, good_cost: float
) -> float | None:
    """The cutoff of one rule in one stratum. ``good[i]`` and ``bad[i]`` are the labelled documents that ``GRID[i]`` rejects."""
    best, found = 0.0, None
    for i in reversed(range(len(GRID))):
        if n_good == 0 or _log_binomial_tail(int(good[i]), n_good, limit) > math.log(error):
            break
        gain = float(bad[i]) - good_cost * float(good[i])
        if gain > best:
            best, found = gain, GRID[i]
    return found


def _signal(sql: str) -> Column:
    return F.expr(f"coalesce(try_divide({sql.replace(' / ', ', ')}), 0)")


def certified_cutoffs(
    metrics: DataFrame, labels: DataFrame, limit: float = 0.02, error: float = 0.05, good_cost: float = 10.0
) -> DataFrame:
    """(stratum, rule, cutoff): the cutoffs certified on all labelled documents that pass the base rule.

    Labels are (doc_id, quality); other qualities than 0 and 1 are ignored. Counts per stratum, rule and cutoff are
    aggregated before anything meets, so a group has a bounded number of rows.
    """
    marked = metrics.where(~F.col("base_failed")).join(
        labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id"
    )
    # The number of cutoffs that a signal reaches, i.e. that reject the document.
    reached = {rule: sum((_signal(sql) >= c).cast("int") for c in GRID) for rule, sql in RULES.items()}
    by_rule = F.create_map(*[x for rule, n in reached.items() for x in (F.lit(rule), n)])
    bins = marked.select("stratum", "quality", F.explode(by_rule).alias("rule", "bin"))
    counts = bins.groupBy("stratum", "rule", "bin").agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")
    )
    strata = marked.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    share = limit / len(RULES)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(len(GRID) + 1), np.zeros(len(GRID) + 1)
        np.add.at(good, group["bin"], group["good"])
        np.add.at(bad, group["bin"], group["bad"])
        rejected = lambda x: np.cumsum(x[::-1])[::-1][1:]  # noqa: E731  cutoff i rejects what reaches more than i
        risk = error / (len(RULES) * int(group["strata"].iloc[0]))
        cutoff = choose_cutoff(rejected(good), rejected(bad), int(good.sum()), share, risk, good_cost)
        first = group.iloc[0]
        return pd.DataFrame({"stratum": [first["stratum"]], "rule": [first["rule"]], "cutoff": [cutoff]}).dropna()

    # One row of ``strata``, so this join adds a column and no rows.
    return counts.withColumn("one", F.lit(1)).join(strata.withColumn("one", F.lit(1)), "one").groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cutoff double"
    )


def _judged(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``judge_documents`` with the hash of the text and the stratum besides."""
    ensure_checkpoint_dir(docs.sparkSession)
    metrics = quality_metrics(docs).checkpoint()
    cutoffs = certified_cutoffs(metrics, labels, **limits)
    # A stratum may hold most documents: its row of cutoffs is repeated, and the documents are dealt among the copies.
    copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    limits_row = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).withColumn("__copy", copies)
    dealt = metrics.withColumn("__copy", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SPREAD)).cast("int"))
    joined = dealt.join(limits_row, ["stratum", "__copy"], "left")
    reached = F.lit(False)
    for rule, sql in RULES.items():
        reached = reached | F.coalesce(_signal(sql) >= F.col(rule), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~reached).drop("__copy", *RULES)


def judge_documents(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, the metrics, base_failed, kept.

    A document is kept unless it fails the base rule or reaches a certified cutoff of its stratum. Repeated rows are
    judged alike, a null text has no words and fails. Metrics are computed once and written to the shared folder.
    """
    return _judged(docs, labels, **limits).drop("stratum", TEXT_HASH)


def keep_documents(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The documents that ``judge_documents`` keeps, with all their columns.

    Each row is decided by its own doc_id, text and language, so rows that share a doc_id, or have none, do not decide for each other.
    """
    kept = _judged(docs, labels, **limits).where("kept").select(
        F.col("doc_id").alias("__kept"), F.col(TEXT_HASH).alias("__kept_text"), F.col("stratum").alias("__kept_stratum")
    ).distinct()
    own = (
        docs["doc_id"].eqNullSafe(kept["__kept"])
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["__kept_text"])
        & (F.coalesce(docs["lang"], F.lit("")) == kept["__kept_stratum"])
    )
    return docs.join(kept, own, "left_semi")
