"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

Terms are runs of letters and digits of the lower-cased text. The lexicon holds the terms whose document frequency lies in
a band of shares (i.e. an inverse-document-frequency band). Each of ``LEXICONS`` random subsets of the lexicon gives one
hash: of the document's distinct terms in it, sorted. Two fingerprints are as alike as the share of subsets in which they
agree.

The lexicon reaches the rows as a constant filter of ``CELLS`` bits. With at least the share ``low`` of all documents to a
term, it has at most (mean distinct terms of a document) / ``low`` terms whatever the corpus size, some 60,000 for texts of
300 distinct terms. A term outside the band passes the filter with the probability of a two-probe Bloom filter (0.5 % at
9,000 terms), the same in every document, so it only widens the lexicon.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = 0.005, 0.10
LEXICONS = 5
KEEP_OF_TEN = 7
CELLS = 1 << 18
#: Documents are chained in buckets of consecutive ids: of so many rows, or more where there would be too many buckets.
ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 20_000
QUANTILES = 256


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _probes(term: Column) -> list[Column]:
    return [term.bitwiseAND(F.lit(CELLS - 1)), F.shiftrightunsigned(term, 20).bitwiseAND(F.lit(CELLS - 1))]


def lexicon_filter(texts: DataFrame, low: float = LOW, high: float = HIGH) -> Column:
    """The filter of the terms whose share of documents is in [low, high]; counts are over all documents.

    At most ``CELLS`` / 64 numbers come to the driver.
    """
    total = texts.count()
    frequency = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = frequency.where((F.col("n") >= F.lit(low) * total) & (F.col("n") <= F.lit(high) * total) & (F.col("n") > 1))
    cells = band.select(F.explode(F.array(*_probes(F.col("term")))).alias("cell"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell").bitwiseAND(F.lit(63)).cast("int"))
    packed = cells.select(F.shiftright("cell", 6).cast("int").alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = [0] * (CELLS // 64)
    for row in packed.collect():
        bits[row["at"]] = row["bits"]
    return F.expr("array(" + ",".join(f"bigint('{b}')" for b in bits) + ")")


def in_lexicon(bits: Column, term: Column) -> Column:
    found = [
        F.call_function("bit_get", F.get(bits, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63)).cast("int")) == 1
        for cell in _probes(term)
    ]
    return found[0] & found[1]


def with_fingerprint(df: DataFrame, text: Column, bits: Column, name: str) -> DataFrame:
    """Add ``name``, an array of one hash per random lexicon.

    A document without a term in the lexicon is hashed by all its terms, and a subset without a term of it by its whole
    lexicon terms; otherwise all such documents would look alike.
    """
    df = df.withColumn("__all", terms(text))
    df = df.withColumn("__band", F.array_sort(F.filter("__all", lambda t: in_lexicon(bits, t))))
    df = df.withColumn("__used", F.when(F.size("__band") > 0, F.col("__band")).otherwise(F.array_sort("__all")))
    parts = []
    for r in range(LEXICONS):
        own = F.filter("__used", lambda t, r=r: F.pmod(F.xxhash64(t, F.lit(r)), F.lit(10)) < KEEP_OF_TEN)
        # The order is part of the hash, which is why the terms are sorted.
        parts.append(F.lpad(F.lower(F.hex(F.xxhash64(F.when(F.size(own) > 0, own).otherwise(F.col("__used")), F.lit(r)))), 16, "0"))
    return df.withColumn(name, F.array(*parts)).drop("__all", "__band", "__used")


def likeness(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x).cast("double") / LEXICONS


def _bucket(docs: DataFrame) -> Column:
    """Consecutive doc_ids in buckets, at most ``MOST_BUCKETS`` and a few: the rank is interpolated between quantiles."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, bounds = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", shares, 20 * QUANTILES)).first()
    if not n:
        return F.lit(-1).cast("bigint")
    at = F.expr("array(" + ",".join(f"bigint('{b}')" for b in bounds) + ")")
    steps = F.array(*[F.lit(QUANTILES >> i) for i in range(1, QUANTILES.bit_length())])
    # Binary search for the last quantile that is not above the id.
    low = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(at, i + s) <= F.col("doc_id"), i + s).otherwise(i))
    width = F.greatest(F.get(at, low + 1).cast("double") - F.get(at, low), F.lit(1.0))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("doc_id").cast("double") - F.get(at, low)) / width))
    place = F.floor((low + inside) * F.lit(n / QUANTILES / max(ROWS_PER_BUCKET, n / MOST_BUCKETS))).cast("bigint")
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("bigint")).otherwise(place)


def with_next(rows: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add ``next_*``: the columns of the row with the next doc_id (behind the last: the first), null ids first.

    ``prepare`` is applied to the rows before they are chained; it may add columns.

    Rows move once, into buckets of consecutive ids. Each bucket also gets the first row of the one behind it, so no row
    has to look beyond its bucket, and no task sees more than a bucket.
    """
    rows = rows.withColumn("__bucket", _bucket(rows))
    firsts = rows.groupBy("__bucket").agg(F.min("doc_id").alias("__first"))
    order = Window.orderBy("__bucket")  # one row per bucket
    around = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    homes = firsts.select(
        F.col("__first"), F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(around)).alias("__home")
    )
    # One row per bucket, so the list has a fixed bound.
    guests = rows.join(F.broadcast(homes), F.col("doc_id").eqNullSafe(F.col("__first"))).withColumn("__bucket", F.col("__home")).drop("__first", "__home")
    both = prepare(rows.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1))))
    inside = Window.partitionBy("__bucket").orderBy("__guest", F.asc_nulls_first("doc_id"), "text")
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(inside))
    return both.where(F.col("__guest") == 0).drop("__guest", "__bucket")


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the characters replaced by as many (or all) first ones of the next document.
    Null texts count as empty; texts without terms share one fingerprint, as all equal texts do. Repeated rows are documents
    of their own, each next to the other; a null id comes before all others. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = lexicon_filter(rows, low, high)
    pairs = with_next(rows, ["text", "own"], lambda df: with_fingerprint(df, F.col("text"), bits, "own"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited).drop("text", "next_text")
    done = with_fingerprint(pairs, F.col("edited"), bits, "other")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "-").alias("fingerprint"), F.array_join("other", "-").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
