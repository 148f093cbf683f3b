"""Labelled log lines for the categoriser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SECTION = r"(?m)^[ \t]*([A-Za-z0-9_.-]+):[ \t]*\[[ \t]*$"
_BLOCK = r"(?ms)^[ \t]*[A-Za-z0-9_.-]+:[ \t]*\[[ \t]*\n(.*?)^[ \t]*\][ \t]*$"


def training_files(spark: SparkSession, path: str) -> DataFrame:
    """``label: [`` sections of text files; each file is parsed whole, files in parallel."""
    return parse_sections(spark.read.text(path, wholetext=True))


def parse_sections(df: DataFrame, value: str = "value") -> DataFrame:
    """(label, text) rows of a text with one ``label: [ ... ]`` section per label, one sample per line."""
    labels = F.regexp_extract_all(F.col(value), F.lit(_SECTION), F.lit(1))
    blocks = F.regexp_extract_all(F.col(value), F.lit(_BLOCK), F.lit(1))
    sections = df.select(F.explode(F.arrays_zip(labels.alias("label"), blocks.alias("block"))).alias("s"))
    lines = sections.select(F.col("s.label").alias("label"), F.explode(F.split("s.block", "\n")).alias("text"))
    return lines.select("label", F.trim("text").alias("text")).where(F.col("text") != "")


def labelled(df: DataFrame, label: str, text: str) -> DataFrame:
    """Any table with a label and a text column as a training set."""
    return df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("label"), F.col(text).alias("text")
    )
