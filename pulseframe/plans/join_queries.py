"""Range label, band and fuzzy joins, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators.fuzzy import fuzzy_join
from pulseframe.operators.joins import band_overlap_counts, band_overlap_join, label_by_range_table, label_by_ranges
from pulseframe.plans.tables import table

BANDS = [(0, 10, "low"), (10, 30, "mid"), (25, 45, "high"), (10, 30, "again"), (40, 49, "top")]


def range_label(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return label_by_ranges(rows, "l_quantity", BANDS).groupBy("label", "l_quantity").agg(F.count("*").alias("n"))


def _label_prices(spark, d, **limits):
    """Order prices labelled by the balance ranges of customers, which overlap in many ways; some have an open end."""
    balance, open_end = F.col("c_acctbal") * 40, F.col("c_custkey") % 50
    ranges = table(spark, d, "customer").select(
        F.when(open_end == 7, float("-inf")).otherwise(F.when(open_end == 8, balance + 200_000).otherwise(balance)).alias("lo"),
        F.when(open_end == 8, float("inf")).when(open_end == 7, F.col("c_acctbal")).otherwise(
            balance + 500 + F.col("c_nationkey") * 90).alias("hi"),
        F.col("c_name").alias("label"), F.col("c_custkey").alias("seq"),
    )
    return label_by_range_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ranges, **limits)


def range_label_join(spark, d):
    return _label_prices(spark, d)


def range_label_join_large(spark, d):
    """The same by the plan for range tables that are too long to broadcast."""
    return _label_prices(spark, d, broadcast_rows=0)


def band_overlap(spark, d):
    """Observed unit prices against the listed price of the part, with tolerances."""
    seen = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", "l_quantity").alias("unit")
    )
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_retailprice")
    pairs = band_overlap_join(seen, listed, ["partkey"], "unit", "p_retailprice", 0.3, 0.5)
    return pairs.select(
        "l_orderkey", "l_linenumber", "partkey", "unit", "contains", "interior", "same", "less", "more",
        "overlap_lo", "overlap_hi",
    )


def band_overlap_binned(spark, d):
    """Close balances of suppliers and customers of one nation; bands are filed by their width."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    pairs = band_overlap_join(s, c, ["nation"], "s_acctbal", "c_acctbal", 0.01, 0.02)
    return pairs.select("nation", "s_suppkey", "c_custkey", "contains", "interior", "less")


def band_overlap_count(spark, d):
    """How many orders of one status, which is that of half of all orders, are near in price, with tolerances."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return band_overlap_counts(orders, orders, ["o_orderstatus"], "o_totalprice", "o_totalprice", 0.01, 0.05)


def fuzzy_names(spark, d):
    """Customer names one edit apart."""
    return fuzzy_join(table(spark, d, "customer"), None, "c_name", None, 1).select(
        "left_text", "right_text", F.col("distance").cast("bigint").alias("distance")
    )


def fuzzy_parts(spark, d):
    """Part names against shifted ones, up to two edits of which a swap is one, with both distances."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("name"))
    typed = table(spark, d, "part").select(F.concat(F.substring("p_name", 2, 99), F.substring("p_type", 1, 1)).alias("other"))
    pairs = fuzzy_join(names, typed.select(F.lower("other").alias("other")), "name", "other", 2, metric="damerau")
    return pairs.select(
        "left_text", "right_text", F.levenshtein("left_text", "right_text").cast("bigint").alias("distance"),
        F.col("distance").cast("bigint").alias("swaps"),
    )


def _lines(spark, d, metric):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    # SQL counts edits of bytes: characters of several bytes become one sign in both.
    lines = lines.select(F.regexp_replace("line", "[^\\x00-\\x7F]", "?").alias("line"))
    return fuzzy_join(lines, None, "line", None, 2, metric).select("left_text", "right_text", F.col("distance").cast("bigint").alias("distance"))


def fuzzy_lines(spark, d):
    """Whole lines of the documents, of up to tens of thousands of characters, at most two edits apart."""
    return _lines(spark, d, "levenshtein")


def fuzzy_lines_swaps(spark, d):
    """The same where swapping neighbours is one edit."""
    return _lines(spark, d, "damerau")


def _lines_sql(function: str) -> str:
    return f"""WITH l AS (SELECT DISTINCT t, length(t) AS n FROM (
               SELECT regexp_replace(unnest(string_split(text, chr(10))), '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents))
           , near AS MATERIALIZED (
               SELECT a.t AS left_text, b.t AS right_text FROM l a JOIN l b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.t < b.t
               WHERE levenshtein(a.t, b.t) <= 4)
           SELECT left_text, right_text, {function}(left_text, right_text) AS distance FROM near WHERE {function}(left_text, right_text) <= 2"""


_CASE = " ".join(f"WHEN v >= {lo} AND v < {hi} THEN '{label}'" for lo, hi, label in sorted(BANDS[:3] + BANDS[4:]))
RANGE_SQL = """
    WITH r AS (
        SELECT lo, hi, arg_min(c_name, c_custkey) AS label FROM (
            SELECT *, CASE c_custkey % 50 WHEN 7 THEN '-inf'::DOUBLE WHEN 8 THEN c_acctbal * 40 + 200000 ELSE c_acctbal * 40 END AS lo,
                   CASE c_custkey % 50 WHEN 8 THEN 'inf'::DOUBLE WHEN 7 THEN c_acctbal
                        ELSE c_acctbal * 40 + 500 + c_nationkey * 90 END AS hi FROM customer)
        WHERE hi > lo GROUP BY lo, hi
    ), hit AS (
        SELECT o_orderkey, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo, hi) AS rn
        FROM orders JOIN r ON o_totalprice >= lo AND o_totalprice < hi)
    SELECT o.o_orderkey, o.o_totalprice, h.label FROM orders o LEFT JOIN hit h ON o.o_orderkey = h.o_orderkey AND h.rn = 1"""
QUERIES = {
    "range_label": (
        range_label,
        f"""SELECT label, v AS l_quantity, count(*) AS n FROM (
            SELECT CASE {_CASE} END AS label, v FROM (SELECT l_quantity AS v FROM lineitem)) GROUP BY ALL""",
    ),
    "range_label_join": (range_label_join, RANGE_SQL),
    "range_label_join_large": (range_label_join_large, RANGE_SQL),
    "band_overlap_join": (
        band_overlap,
        """SELECT l_orderkey, l_linenumber, partkey, unit, unit BETWEEN rlo AND rhi AS contains, rlo < llo AND lhi < rhi AS interior,
                  llo = rlo AND lhi = rhi AS same, llo <= rlo AND lhi <= rhi AS less, llo >= rlo AND lhi >= rhi AS more,
                  greatest(llo, rlo) AS overlap_lo, least(lhi, rhi) AS overlap_hi
           FROM (SELECT *, unit - unit * 0.3 / 2 AS llo, unit + unit * 0.3 / 2 AS lhi FROM (
               SELECT l_orderkey, l_linenumber, l_partkey AS partkey, l_extendedprice / l_quantity AS unit FROM lineitem))
           JOIN (SELECT p_partkey, p_retailprice - p_retailprice * 0.5 / 2 AS rlo, p_retailprice + p_retailprice * 0.5 / 2 AS rhi FROM part)
             ON partkey = p_partkey AND llo <= rhi AND rlo <= lhi""",
    ),
    "band_overlap_binned": (
        band_overlap_binned,
        """WITH s AS (SELECT *, s_acctbal * 0.01 / 2 AS h FROM supplier), c AS (SELECT *, c_acctbal * 0.02 / 2 AS h FROM customer),
                s2 AS (SELECT *, least(s_acctbal - h, s_acctbal + h) AS lo, greatest(s_acctbal - h, s_acctbal + h) AS hi FROM s),
                c2 AS (SELECT *, least(c_acctbal - h, c_acctbal + h) AS lo, greatest(c_acctbal - h, c_acctbal + h) AS hi FROM c)
           SELECT s_nationkey AS nation, s_suppkey, c_custkey, s_acctbal BETWEEN c2.lo AND c2.hi AS contains,
                  c2.lo < s2.lo AND s2.hi < c2.hi AS interior, s2.lo <= c2.lo AND s2.hi <= c2.hi AS less
           FROM s2 JOIN c2 ON s_nationkey = c_nationkey AND s2.lo <= c2.hi AND c2.lo <= s2.hi""",
    ),
    "band_overlap_counts": (
        band_overlap_count,
        """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice * 0.01 / 2 AS h, o_totalprice * 0.05 / 2 AS w FROM orders)
           SELECT a.o_orderkey, a.o_orderstatus, a.o_totalprice, count(b.o_orderkey) AS meets
           FROM o a LEFT JOIN o b ON a.o_orderstatus = b.o_orderstatus
             AND b.o_totalprice - b.w <= a.o_totalprice + a.h AND a.o_totalprice - a.h <= b.o_totalprice + b.w GROUP BY ALL""",
    ),
    "fuzzy_join": (
        fuzzy_names,
        """WITH n AS (SELECT DISTINCT c_name AS t FROM customer)
           SELECT a.t AS left_text, b.t AS right_text, levenshtein(a.t, b.t) AS distance
           FROM n a JOIN n b ON a.t < b.t AND levenshtein(a.t, b.t) <= 1""",
    ),
    "fuzzy_join_lines": (fuzzy_lines, _lines_sql("levenshtein")),
    "fuzzy_join_lines_damerau": (fuzzy_lines_swaps, _lines_sql("damerau_levenshtein")),
    "fuzzy_join_damerau": (
        fuzzy_parts,
        """WITH a AS (SELECT DISTINCT lower(p_name) AS t FROM part),
                b AS (SELECT DISTINCT lower(substr(p_name, 2) || substr(p_type, 1, 1)) AS t FROM part)
           SELECT a.t AS left_text, b.t AS right_text, levenshtein(a.t, b.t) AS distance, damerau_levenshtein(a.t, b.t) AS swaps
           FROM a JOIN b ON damerau_levenshtein(a.t, b.t) <= 2""",
    ),
}
