"""Field access, conversions, times and the metric record, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOS = 1_000_000_000

METRIC = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("platform", T.StringType()),
    T.StructField("skey", T.StringType()),
    T.StructField("src", T.StringType()),
])


def json_get(document: Column, *path: str, kind: str = "string") -> Column:
    """Value at a path of a VARIANT document; NULL where any step is missing."""
    return F.try_variant_get(document, "$" + "".join(f".{p}" for p in path), kind)


def float_to_int(value: Column) -> Column:
    """Truncation toward zero that saturates at the limits of a BIGINT."""
    low, high = -(2**63), 2**63 - 1
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return (
        F.when(F.isnan(value), F.lit(0))
        .when(value <= float(low), F.lit(low))
        .when(value >= float(high), F.lit(high))
        .otherwise(cut.try_cast("bigint"))
    )


def int_to_float(value: Column) -> Column:
    return value.cast("double")


def epoch_nanos(seconds: Column, nanos: Column) -> Column:
    return seconds.cast("bigint") * F.lit(NANOS) + nanos.cast("bigint")


def fractional_seconds(ns: Column) -> Column:
    """Seconds of a nanosecond timestamp, with the fraction kept."""
    return ns / F.lit(float(NANOS))


def nanos_part(ns: Column) -> Column:
    return F.pmod(ns, F.lit(NANOS))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp, read as UTC where it has no zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def time_window(at: Column, width: int) -> Column:
    """``{s, e}`` around a time: half the width on each side."""
    half = width // 2
    return F.struct((at - half).alias("s"), (at + half).alias("e"))


def error_band(value: Column, q: float | Column) -> Column:
    """Observation-error band ``{lo, hi}`` around a value, for either sign of it."""
    half = value * q / 2
    return F.struct(F.least(value - half, value + half).alias("lo"), F.greatest(value - half, value + half).alias("hi"))


def metric_record(
    key: Column, value: Column, timestamp_ns: Column, tags: Column, src: Column, platform: Column | None = None
) -> Column:
    return F.struct(
        key.alias("key"), value.alias("value"), timestamp_ns.cast("double").alias("timestamp"), tags.alias("tags"),
        (F.lit("local") if platform is None else platform).alias("platform"),
        F.element_at(F.split(key, "/"), -1).alias("skey"), src.alias("src"),
    )


def metric_to_json(record: Column) -> Column:
    return F.to_json(record)


def metrics_from_json(df: DataFrame, text: str, default_src: str = "localhost") -> DataFrame:
    """Adds the columns of the metric record in a JSON text: ``key`` is required, the rest has defaults."""
    m = F.col("__m")
    return df.withColumn("__m", F.from_json(F.col(text), METRIC)).where(m["key"].isNotNull()).withColumns({
        "key": m["key"], "value": m["value"], "timestamp": m["timestamp"],
        "tags": F.coalesce(m["tags"], F.create_map().cast("map<string,string>")),
        "platform": F.coalesce(m["platform"], F.lit("local")),
        "skey": F.coalesce(m["skey"], F.element_at(F.split(m["key"], "/"), -1)),
        "src": F.coalesce(m["src"], F.lit(default_src)),
    }).drop("__m")
