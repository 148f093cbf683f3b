"""A training corpus from the documents: quality rules, one of each near-duplicate group, no personal data, mixed, encoded.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``. All
but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.bpe import encode_documents
from pulseframe.llm.jaccard_join import one_of_each
from pulseframe.llm.mixing import mixed_texts
from pulseframe.llm.pii import mask_documents
from pulseframe.llm.quality_rules import keep_documents
from pulseframe.llm.queries import TOKENIZER
from pulseframe.llm.tables import documents, labels
from pulseframe.session import scratch_path, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    ship_package(spark)
    return keep_documents(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links join, the one with the least doc_id stays."""
    ship_package(spark)
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    ship_package(spark)
    return mask_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents are repeated or left out."""
    ship_package(spark)
    return mixed_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text."""
    import public_tokenizers

    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixing),
    ("byte-level BPE", encoding),
]

#: SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Between two stages, rows are written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
