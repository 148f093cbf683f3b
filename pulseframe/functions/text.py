"""Lines, tokens and words of text columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.edits import swap_distances

# Quoted groups and bare runs; an unclosed quote reaches to the end of the text.
QUOTED_TOKENS = r""""[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s\p{Z}'"]+"""
WORD = r"[\p{L}\p{N}]+"
_SEPARATOR = r"[\s\p{P}\p{Z}]+"
_OTHER = r"[^\p{L}\p{N}\s\p{P}\p{Z}]+"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def all_lines(text: Column) -> Column:
    """Trimmed lines with tabs as single spaces, empty lines included."""
    whole = F.regexp_replace(text, r"\r?\n$", "")
    return F.transform(F.split(whole, r"\r?\n"), lambda l: F.regexp_replace(F.replace(l, F.lit("\t"), F.lit(" ")), _EDGE_SPACE, ""))


def lines(text: Column) -> Column:
    return F.filter(all_lines(text), lambda l: l != "")


def map_lines(text: Column, change: Callable[[Column], Column]) -> Column:
    """The change applied to each line; a line it yields NULL for is left out."""
    return F.filter(F.transform(lines(text), change), lambda l: l.isNotNull())


def explode_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def is_regex(pattern: str) -> bool:
    """Whether Spark can use a pattern, tested once on the driver by the class that will compile it."""
    java = SparkContext._active_spark_context._jvm.java.util.regex
    try:
        java.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def grep_lines(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """Lines that contain a match of the pattern, with their number in the text; none for a pattern that is no regex."""
    exploded = df.select(*keep, F.posexplode(all_lines(F.col(text))).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(pattern)) if is_regex(pattern) else exploded.limit(0)


def _raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({QUOTED_TOKENS})"), F.lit(1))


def _bare(token: Column) -> Column:
    first = F.left(token, F.lit(1))
    closed = (F.length(token) > 1) & (F.right(token, F.lit(1)) == first)
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    rest = F.regexp_replace(F.substring(token, F.lit(2), F.length(token)), _EDGE_SPACE, "")
    return F.when(~first.isin('"', "'"), token).when(closed, inner).otherwise(rest)


def quoted_tokens(text: Column) -> Column:
    """Tokens by white space and quotes, for texts without backslash escapes."""
    return F.filter(F.transform(_raw_tokens(text), _bare), lambda t: t != "")


def _split_escaped(text: str) -> list[str]:
    tokens, current, quote, escaped = [], [], None, False
    for c in text:
        if escaped:
            current.append(c)
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == quote or (quote is None and (c in "'\"" or c.isspace())):
            if current:
                tokens.append("".join(current))
            current = []
            quote = None if c == quote else c if c in "'\"" else None
        else:
            current.append(c)
    if escaped:
        current.append("\\")
    rest = "".join(current).strip()
    return [*tokens, rest] if rest else tokens


def tokenize(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows with a ``tokens`` array. Only texts with a backslash go through Python."""
    chosen = df.select(*keep, text)
    escapes = F.contains(F.col(text), F.lit("\\"))
    native = chosen.where(~escapes).select(*keep, quoted_tokens(F.col(text)).alias("tokens"))
    return native.unionByName(chosen.where(escapes).select(*keep, _escaped_tokens(F.col(text)).alias("tokens")))


def _escaped_tokens(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: None if t is None else _split_escaped(t))

    return split(text)


def token_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(token, n). Quotes are stripped from the distinct tokens, after most copies are counted away."""
    escapes = F.contains(F.col(text), F.lit("\\"))

    def counted(tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("token").agg(F.count("*").alias("n"))

    raw = counted(df.where(~escapes).select(F.explode(_raw_tokens(F.col(text))).alias("token")))
    native = raw.select(_bare(F.col("token")).alias("token"), "n").where(F.col("token") != "")
    slow = counted(df.where(escapes).select(F.explode(_escaped_tokens(F.col(text))).alias("token")))
    return native.unionByName(slow).groupBy("token").agg(F.sum("n").alias("n"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def token_kinds(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every piece of a text with its kind: ``word``, ``separator`` or ``unknown``.

    A piece has characters of one kind only, so its first one tells which.
    """
    pieces = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"({WORD}|{_SEPARATOR}|{_OTHER})"), F.lit(1))
    return df.select(*keep, F.posexplode(pieces).alias("pos", "value")).withColumn("kind", piece_kind(F.col("value")))


def piece_kind(piece: Column) -> Column:
    return F.when(piece.rlike(f"^{WORD}"), "word").when(piece.rlike(f"^{_SEPARATOR}"), "separator").otherwise("unknown")


def word_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.select(*by, F.explode(words(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def damerau(left: Column, right: Column, limit: int | None = None) -> Column:
    """Edit distance in which swapping neighbours is one edit, on the candidate pairs of a join; beyond ``limit``, limit + 1."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        out = pd.Series(pd.array([None] * len(a), dtype="Int32"))
        out[known.to_numpy()] = swap_distances(a[known].tolist(), b[known].tolist(), limit)
        return out

    return distance(left, right)
