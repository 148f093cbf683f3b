"""Range labels, band relations and windows around anchors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.fields import error_band
from pulseframe.operators.scale import BLOCK_ROWS, MAX_RANGES, running_sums
from pulseframe.session import ensure_checkpoint_dir

BROADCAST_SEGMENTS = 100_000
MAX_CHAINED = 24


def label_by_ranges(df: DataFrame, value: str, ranges: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Adds ``label`` of the first half-open range ``[lo, hi)`` holding the value, NULL without one.

    For the short lists people write down: one CASE expression, no join. Ranges
    count in ascending order of their bounds; a repeated range keeps its first label.
    """
    first: dict[tuple[float, float], str] = {}
    for lo, hi, label in ranges:
        first.setdefault((float(lo), float(hi)), label)
    x = F.col(value)
    found = F.lit(None).cast("string")
    for (lo, hi), label in sorted(first.items(), reverse=True):
        found = F.when((x >= lo) & (x < hi), F.lit(label)).otherwise(found)
    return df.withColumn("label", found)


def disjoint_segments(ranges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ranges (lo, hi, label, seq) cut down to the parts in which each one is the first to match.

    In ascending order of the bounds, the first range that ends after a value is
    the only one that can be its first match. So a range counts only beyond the
    furthest end before it: what is left are disjoint (lo, hi, label) segments,
    however many ranges overlap. The running maximum is taken per block of ranges
    and carried over by one row per block.
    """
    first = ranges.where(F.col("hi") > F.col("lo")).groupBy("lo", "hi").agg(F.min_by("label", "seq").alias("label"))
    blocks = min(max(1, -(-ranges.count() // block_rows)), MAX_RANGES)
    placed = first.repartitionByRange(blocks, "lo", "hi").withColumn("__part", F.spark_partition_id())
    if blocks > 1:
        ensure_checkpoint_dir(ranges.sparkSession)
        placed = placed.checkpoint()
    inside = Window.partitionBy("__part").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reached = placed.withColumn("__end", F.max("hi").over(inside))
    if blocks > 1:
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = placed.groupBy("__part").agg(F.max("hi").alias("__m")).select("__part", F.max("__m").over(earlier).alias("__carried"))
        reached = reached.join(F.broadcast(carried), "__part").withColumn("__end", F.greatest("__end", "__carried"))
    start = F.greatest("lo", "__end")
    return reached.select(start.alias("lo"), "hi", "label").where(F.col("hi") > F.col("lo"))


def label_by_range_table(
    df: DataFrame, value: str, ranges: DataFrame, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_SEGMENTS
) -> DataFrame:
    """Same labels from a table (lo, hi, label, seq) of any size.

    A segment is filed under the power of two next above its width, in the at most
    two bins of that size it touches. A bin holds three segments at the most, so
    values meet few segments in the equi-join. A counted, short list of segments
    is broadcast per bin size and the rows stay where they are. A long one meets
    the distinct values in a shuffled join, whose labels are joined to the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    segments = disjoint_segments(ranges, block_rows).checkpoint()
    # Segments are disjoint, so at most two of them have no finite width to be filed by.
    infinite = (F.col("hi") - F.col("lo")) == float("inf")
    ends = [(r["lo"], r["hi"], r["label"]) for r in segments.where(infinite).collect()]
    x = F.col(value)
    beyond = F.lit(None).cast("string")
    for lo, hi, label in ends:
        beyond = F.when((x >= lo) & (x < hi), F.lit(label)).otherwise(beyond)

    def labelled(rows: DataFrame, label: Column) -> DataFrame:
        return rows.select(*df.columns, F.coalesce(label, beyond).alias("label"))

    leveled = segments.where(~infinite).withColumn("__level", F.ceil(F.log2(F.col("hi") - F.col("lo"))).cast("int"))
    # Bin sizes are exponents of doubles: a handful in practice, 2,100 at the very most.
    sizes = {r["__level"]: r["n"] for r in leveled.groupBy("__level").agg(F.count("*").alias("n")).collect()}
    levels = sorted(sizes)
    if not levels:
        return labelled(df, F.lit(None).cast("string"))

    def bin_of(x: Column, level: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), level))

    level = F.col("__level")
    touched = F.array_distinct(F.array(bin_of(F.col("lo"), level), bin_of(F.col("hi"), level)))
    filed = leveled.withColumn("__bin", F.explode(touched))
    if sum(sizes.values()) <= broadcast_rows and len(levels) <= MAX_CHAINED:
        rows = df
        for n in levels:
            part = filed.where(level == n).select(
                "__bin", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("label").alias(f"__l{n}")
            )
            here = (bin_of(x, F.lit(n)) == F.col("__bin")) & (x >= F.col("__lo")) & (x < F.col("__hi"))
            rows = rows.join(F.broadcast(part), here, "left").drop("__bin", "__lo", "__hi")
        found = [f"__l{n}" for n in levels]
        return labelled(rows, F.coalesce(*[F.col(n) for n in found]))
    probes = df.select(value).where(x.isNotNull()).distinct().withColumn(
        "__level", F.explode(F.array(*[F.lit(l) for l in levels]))
    ).withColumn("__bin", bin_of(x, level))
    hits = probes.join(filed, ["__level", "__bin"]).where((x >= F.col("lo")) & (x < F.col("hi")))
    named = hits.select(F.col(value).alias("__value"), F.col("label").alias("__found"))
    return labelled(df.join(named, x == F.col("__value"), "left"), F.col("__found"))


def band_overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, left_q: float, right_q: float
) -> DataFrame:
    """Pairs of one key whose tolerance bands meet, and how the bands relate.

    A band belongs to the power of two next above its width and touches at most two bins of that size, or of a larger one.
    Two bands meet in the bins of the wider one, so a key with many bands is spread over its bins, a wide band is not cut
    into many pieces, and distant bands never meet. A pair is kept only in the bin where the overlap starts, and so appears
    once. A band is filed at most twice for its own size and for each larger one that the other side has under its key. The
    filed bands are sort-merged: they may be far more than the size of their table tells, and pairs more than bands.
    """
    a = left.where(F.col(left_value).isNotNull()).withColumn("l_band", error_band(F.col(left_value), left_q))
    b = right.where(F.col(right_value).isNotNull()).withColumn("r_band", error_band(F.col(right_value), right_q))

    def size_of(band: str) -> Column:
        width = F.col(f"{band}.hi") - F.col(f"{band}.lo")
        return F.when(width > 0, F.ceil(F.log2(width)).cast("int"))

    a, b = a.withColumn("__l_size", size_of("l_band")), b.withColumn("__r_size", size_of("r_band"))
    ensure_checkpoint_dir(left.sparkSession)

    def sizes(df: DataFrame, own: str) -> DataFrame:
        """The sizes that occur under each key. Exponents of doubles: a few dozen in practice, 2,100 at the very most."""
        found = df.select(*keys, own).distinct().groupBy(*keys).agg(F.collect_set(own).alias("__sizes")).checkpoint()
        entries = found.agg(F.coalesce(F.sum(F.size("__sizes") + 1), F.lit(0))).first()[0]
        return found.hint("broadcast" if entries <= BROADCAST_SEGMENTS else "merge")

    def bin_of(x: Column) -> Column:
        scaled = x / F.pow(F.lit(2.0), F.col("__size"))
        return scaled - F.pmod(scaled, F.lit(1.0))

    def filed(df: DataFrame, band: str, own: str, others: DataFrame) -> DataFrame:
        # A band without any width fits into bins of every size.
        larger = F.filter("__sizes", lambda n: F.col(own).isNull() | (n > F.col(own)))
        each = F.array_union(F.array(F.coalesce(F.col(own), F.lit(0))), larger)
        sized = df.join(others, [*keys]).withColumn("__size", F.explode(each)).drop("__sizes")
        return sized.withColumn("__bin", F.explode(F.array_distinct(F.array(bin_of(F.col(f"{band}.lo")), bin_of(F.col(f"{band}.hi"))))))

    start = F.greatest("l_band.lo", "r_band.lo")
    meet = (F.col("l_band.lo") <= F.col("r_band.hi")) & (F.col("r_band.lo") <= F.col("l_band.hi"))
    wider = F.coalesce(F.greatest("__l_size", "__r_size"), F.lit(0))
    here = (F.col("__size") == wider) & (F.col("__bin") == bin_of(start))
    of_left, of_right = sizes(a, "__l_size"), sizes(b, "__r_size")
    partners = filed(b, "r_band", "__r_size", of_left).hint("merge")
    pairs = filed(a, "l_band", "__l_size", of_right).join(partners, [*keys, "__size", "__bin"]).where(meet & here)
    joined = pairs.drop("__bin", "__size", "__l_size", "__r_size")
    l, r = F.col("l_band"), F.col("r_band")
    return joined.withColumns({
        "contains": (r["lo"] <= F.col(left_value)) & (F.col(left_value) <= r["hi"]),
        "interior": (r["lo"] < l["lo"]) & (l["hi"] < r["hi"]),
        "same": (l["lo"] == r["lo"]) & (l["hi"] == r["hi"]),
        "less": (l["lo"] <= r["lo"]) & (l["hi"] <= r["hi"]),
        "more": (l["lo"] >= r["lo"]) & (l["hi"] >= r["hi"]),
        "overlap_lo": start, "overlap_hi": F.least("l_band.hi", "r_band.hi"),
    })


def band_overlap_counts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, left_q: float, right_q: float
) -> DataFrame:
    """The left rows with ``meets``: how many right bands of the key meet theirs. No pair is made.

    A band meets all that start at or below its upper end, but for those that end below its lower end. Both numbers are
    running counts over the ends of all bands in order. Equal ends are counted together before they are sorted, and a value is
    asked for once, so the sums see each of a key's distinct ends once; a key with most of the rows is spread over ranges. A row
    without a key or a value meets nothing.
    """
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    listed = right.where(usable & F.col(right_value).isNotNull()).groupBy(*keys, F.col(right_value).alias("__v")).agg(F.count("*").alias("__n"))
    asked = left.where(usable & F.col(left_value).isNotNull()).select(*keys, F.col(left_value).alias("__v")).distinct()
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast(left.schema[left_value].dataType)
    band, own = error_band(F.col("__v"), right_q), error_band(F.col("__v"), left_q)
    # At one place: ends that are asked about from above, the ends themselves, ends that are asked about from below.
    starts = listed.select(*keys, band["lo"].alias("__x"), F.lit(1).alias("__rank"), F.col("__n").alias("__starts"), zero.alias("__ends"))
    ends = listed.select(*keys, band["hi"].alias("__x"), F.lit(1).alias("__rank"), zero.alias("__starts"), F.col("__n").alias("__ends"))
    marks = starts.unionByName(ends).groupBy(*keys, "__x", "__rank").agg(F.sum("__starts").alias("__starts"), F.sum("__ends").alias("__ends"))
    edges = F.explode(F.array(F.struct(own["lo"].alias("x"), F.lit(0).alias("rank")), F.struct(own["hi"].alias("x"), F.lit(2).alias("rank"))))
    probes = asked.select(*keys, F.col("__v").alias("__asked"), edges.alias("__edge")).select(
        *keys, F.col("__edge.x").alias("__x"), F.col("__edge.rank").alias("__rank"), zero.alias("__starts"), zero.alias("__ends"), "__asked"
    )
    totals = running_sums(marks.withColumn("__asked", none).unionByName(probes), keys, ["__x", "__rank", "__asked"], ["__starts", "__ends"])
    answers = totals.where(F.col("__rank") != 1).groupBy(*keys, F.col("__asked").alias(left_value)).agg(
        F.sum(F.when(F.col("__rank") == 2, F.col("__starts")).otherwise(-F.col("__ends"))).alias("meets")
    )
    return left.join(answers, [*keys, left_value], "left").select(*left.columns, F.coalesce("meets", zero).alias("meets"))


def interval_aggregates(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    """Hull, intersection, sum, width and midpoint of the intervals of a key."""
    g = df.select(*keys, lo.alias("__lo"), hi.alias("__hi")).groupBy(*keys).agg(
        F.min("__lo").alias("hull_lo"), F.max("__hi").alias("hull_hi"), F.max("__lo").alias("__in_lo"),
        F.min("__hi").alias("__in_hi"), F.sum("__lo").alias("sum_lo"), F.sum("__hi").alias("sum_hi"),
        F.count("*").alias("n"),
    )
    common = F.col("__in_lo") <= F.col("__in_hi")
    return g.withColumns({
        "common_lo": F.when(common, F.col("__in_lo")), "common_hi": F.when(common, F.col("__in_hi")),
        "width": F.col("hull_hi") - F.col("hull_lo"), "midpoint": (F.col("hull_lo") + F.col("hull_hi")) / 2,
    }).drop("__in_lo", "__in_hi")


def around_window(
    anchors: DataFrame, events: DataFrame, keys: Sequence[str], anchor_id: str, at: str, value: str, width: int
) -> DataFrame:
    """Count and sum of a key's events within half the width on either side of each anchor.

    ``at`` is an integer time in both inputs. Events of one instant are added up
    before the shuffle and anchors of one instant are answered once. Rows meet in
    time slots as wide as the window, so a task sees a bounded number of rows per
    instant of a slot; running totals read at the two window edges give the answer
    without pairing anchors with events.
    """
    half = width // 2
    slot = max(width, 1)
    t = F.col(at)
    instants = events.groupBy(*keys, at).agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    slots = F.array_distinct(F.array(F.floor((t - half) / slot), F.floor((t + half) / slot)))
    zero = F.lit(0).cast("bigint")
    rows = instants.select(
        *keys, t.alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__at"), "__n", "__s",
        F.explode(slots).alias("__slot"),
    )
    edges = F.array(
        F.struct((t - half).alias("t"), F.lit(0).alias("kind")), F.struct((t + half).alias("t"), F.lit(2).alias("kind"))
    )
    asked = anchors.select(*keys, at).distinct()
    probes = asked.select(*keys, at, F.floor(t / slot).alias("__slot"), F.explode(edges).alias("e")).select(
        *keys, F.col("e.t").alias("__t"), F.col("e.kind").alias("__kind"), t.cast("bigint").alias("__at"),
        zero.alias("__n"), F.lit(0.0).alias("__s"), "__slot",
    )
    upto = Window.partitionBy(*keys, "__slot").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.unionByName(probes).withColumns({"__cn": F.sum("__n").over(upto), "__cs": F.sum("__s").over(upto)})
    sign = F.when(F.col("__kind") == 2, 1).otherwise(-1)
    answers = totals.where(F.col("__kind") != 1).groupBy(*keys, F.col("__at").alias(at)).agg(
        F.sum(F.col("__cn") * sign).alias("events"), F.sum(F.col("__cs") * sign).alias("total")
    )
    return anchors.select(*keys, anchor_id, at).join(answers, [*keys, at]).drop(at)
