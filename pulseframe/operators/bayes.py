"""Multinomial Naive Bayes categories for log lines, trained and applied with joins and sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.text import words
from pulseframe.session import ensure_checkpoint_dir, stored

#: So many weights, of about a hundred bytes each, are sent to every task.
MOST_SENT = 400_000


def token_counts(training: DataFrame) -> DataFrame:
    """(label, token, n) of a (label, text) training set."""
    return training.select("label", F.explode(words(F.col("text"))).alias("token")).groupBy("label", "token").agg(
        F.count("*").alias("n")
    )


def model_table(training: DataFrame) -> DataFrame:
    """(label, token, n, label_tokens, vocabulary, log_prob): the trained model as a table.

    Probabilities are Laplace smoothed. Totals come from the checkpointed counts,
    which are bounded by the vocabulary, and not from the texts again.
    """
    ensure_checkpoint_dir(training.sparkSession)
    counts = token_counts(training).checkpoint()
    totals = counts.groupBy("label").agg(F.sum("n").alias("label_tokens"))
    size = counts.agg(F.count_distinct("token").alias("vocabulary"))
    return counts.join(totals, "label").withColumn("vocabulary", size.scalar()).withColumn(
        "log_prob", F.ln((F.col("n") + 1) / (F.col("label_tokens") + F.col("vocabulary")))
    )


@dataclass
class LogCategories:
    """A trained categoriser, as tables of any size."""

    labels: DataFrame  # label, prior, total: log prior and log of the smoothed number of tokens
    weights: DataFrame  # token, label, weight: ln(count + 1); and one row with label NULL and weight 1 for each known token
    default: str
    rare: DataFrame | None = None  # the weights of further tokens, if there are too many to send all to every task

    def _sums(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, label, s): the weights of each text's tokens, added up.

        The weights of the most frequent tokens, of a bounded number, are sent to every task, which adds them up where the text
        is: no row per token is moved. Only tokens that are rare in training meet their weights in a shuffle, counted within
        each text first.
        """
        tokens = texts.select(key, F.explode(words(F.col(text))).alias("token"))
        common = tokens.join(F.broadcast(self.weights), "token").groupBy(key, "label").agg(F.sum("weight").alias("s"))
        if self.rare is None:
            return common
        others = tokens.join(F.broadcast(self.weights.where("label is null").select("token")), "token", "left_anti")
        counted = others.groupBy(key, "token").agg(F.count("*").alias("n"))
        # Files say less than what their rows take in memory: these are too many to send.
        rest = counted.join(self.rare.hint("merge"), "token").select(key, "label", (F.col("n") * F.col("weight")).alias("s"))
        return common.unionByName(rest).groupBy(key, "label").agg(F.sum("s").alias("s"))

    def best(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, category) of texts with a known token; no two of the texts have one key.

        The score of a label is prior + the weights of the text's tokens - known tokens * total. Labels that share a token
        with the text are scored one by one. For the others only the number of known tokens counts, so the best of them is
        found once per number; it may be any label, as a shared token only adds to its score. No table of texts times
        labels is made. The sums are read several times and so are checkpointed.
        """
        ensure_checkpoint_dir(texts.sparkSession)
        per_text = self._sums(texts, key, text).groupBy(key).agg(
            F.max(F.when(F.col("label").isNull(), F.col("s"))).cast("bigint").alias("known"),
            F.filter(F.collect_list(F.struct("label", "s")), lambda h: h["label"].isNotNull()).alias("hits"),
        ).checkpoint()
        shared = per_text.select(key, "known", F.inline("hits")).join(self.labels, "label").select(
            key, F.struct((-(F.col("prior") + F.col("s") - F.col("known") * F.col("total"))).alias("cost"), "label").alias("best")
        )
        numbers = per_text.select("known").distinct()
        without = numbers.crossJoin(self.labels).groupBy("known").agg(
            F.min(F.struct((-(F.col("prior") - F.col("known") * F.col("total"))).alias("cost"), "label")).alias("best")
        )
        rest = per_text.select(key, "known").join(without, "known").select(key, "best")
        return shared.unionByName(rest).groupBy(key).agg(F.min("best")["label"].alias("category"))

    def categorize(self, df: DataFrame, text: str) -> DataFrame:
        """Adds ``category``, which depends on the text alone: each distinct text is scored once, whatever ids rows have.

        A text without any known token gets the most frequent label, a NULL text none. The text itself is only moved to find
        the distinct ones: rows meet their category by half of its hash, 128 bits.
        """
        keyed = df.withColumn("__key", F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16))
        texts = keyed.where(F.col(text).isNotNull()).select("__key", F.col(text).alias("__body")).dropDuplicates(["__key"])
        best = self.best(texts, "__key", "__body").withColumnRenamed("__key", "__scored")
        joined = keyed.join(best, F.col("__key") == F.col("__scored"), "left")
        named = F.when(F.col("__key").isNotNull(), F.coalesce("category", F.lit(self.default)))
        return joined.withColumn("category", named).drop("__key", "__scored")


def train(training: DataFrame, most_sent: int = MOST_SENT) -> LogCategories:
    """Fit on (label, text). The driver receives the vocabulary size, the number of texts and the most frequent label.

    The counts, bounded by the vocabulary, are stored as Parquet, a fraction of a checkpoint: texts are read once. Of the weights, about ``most_sent`` of the
    most frequent tokens are broadcast when texts are scored.
    """
    ensure_checkpoint_dir(training.sparkSession)
    counts = stored(token_counts(training), "tokens")
    per_label = training.groupBy("label").agg(F.count("*").alias("docs")).checkpoint()
    per_token = counts.groupBy("token").agg(F.sum("n").alias("all"), (F.count("*") + 1).alias("entries"))
    vocabulary, entries = per_token.agg(F.count("*"), F.coalesce(F.sum("entries"), F.lit(0))).first()
    docs, top = per_label.agg(F.sum("docs"), F.max(F.struct("docs", "label"))["label"]).first()
    if not docs:
        raise ValueError("training needs a labelled text")
    totals = counts.groupBy("label").agg(F.sum("n").alias("tokens"))
    labels = per_label.join(totals, "label", "left").select(
        "label", F.ln(F.col("docs") / docs).alias("prior"), F.ln(F.coalesce("tokens", F.lit(0)) + vocabulary).alias("total")
    ).checkpoint()
    known = per_token.select("token", F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"), "all")
    of_label = counts.select("token", "label", F.ln(F.col("n") + 1).alias("weight"))
    columns = ["token", "label", "weight"]
    if entries <= most_sent:
        return LogCategories(labels, stored(of_label.unionByName(known.select(columns)), "weights"), top)
    # Tokens seen more often than this have that many weights in all. Most tokens share a few counts.
    often = per_token.agg(F.percentile("all", 1.0 - most_sent / entries, F.col("entries"))).first()[0]
    weights = stored(of_label.join(per_token.select("token", "all"), "token").unionByName(known), "weights")
    return LogCategories(labels, weights.where(F.col("all") > often).select(columns), top, weights.where(F.col("all") <= often).select(columns))


def accuracy(categorized: DataFrame, truth: str, category: str = "category") -> DataFrame:
    return categorized.groupBy(truth).agg(
        F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(category)).alias("correct")
    )


def text_payload(data: Column) -> Column:
    """Text of a record whose data is a JSON string, NULL for any other type."""
    return F.when(F.schema_of_variant(data) == "STRING", F.try_variant_get(data, "$", "string"))
