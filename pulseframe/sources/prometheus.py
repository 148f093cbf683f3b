"""Prometheus exposition text as telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.model import FLOAT_CONTENT, OTHER_CONTENT, GatewayConfig, finite, stable_id, telemetry

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_SAMPLE = rf"^({_NAME})\s*(?:\{{(.*)\}})?\s+([^\s]+)(?:\s+(-?\d+))?\s*$"
_SAMPLE_LINE = rf"(?m)^[ \t]*({_NAME}\b.*)$"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def last_wins(keys: Column, values: Column) -> Column:
    """Map of two arrays in which a repeated key keeps its last value."""
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"]))
    empty = F.create_map().cast("map<string,string>")
    one_by_one = F.aggregate(F.zip_with(keys, values, lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), v)), empty, put)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(one_by_one)


def unescaped(text: Column) -> Column:
    """The text of a quoted value or a description: backslash, line feed and quote are written with a backslash."""
    marked = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    plain = F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(plain, F.lit("\0"), F.lit("\\"))


def read_scrapes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Scrapes landed as one file each; a file's time is the time of its scrape."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("scrape_id"), F.col("value").alias("text"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("scraped_ms"),
    )


def prometheus_samples(scrapes: DataFrame, text: str = "text", scraped_ms: str = "scraped_ms") -> DataFrame:
    """One row per counter, gauge or untyped sample, with its labels.

    ``scrapes`` has one row per scrape (scrape_id, text, scraped_ms). Descriptions
    and kinds are looked up inside the row, so no shuffle is needed. Samples of
    histograms and summaries are skipped.
    """
    body = F.col(text)

    def documented(what: str) -> Column:
        pattern = F.lit(rf"(?m)^#[ \t]+{what}[ \t]+({_NAME})[ \t]*(.*?)[ \t\r]*$")
        return last_wins(F.regexp_extract_all(body, pattern, F.lit(1)), F.regexp_extract_all(body, pattern, F.lit(2)))

    # The maps are made in a projection of their own, below the explode: once per scrape.
    scraped = scrapes.select(
        "scrape_id", scraped_ms, documented("HELP").alias("__help"), documented("TYPE").alias("__kind"),
        F.regexp_extract_all(body, F.lit(_SAMPLE_LINE), F.lit(1)).alias("__lines"),
    )
    fields = ["metric", "__labels", "__number", "__own"]
    parts = scraped.select("scrape_id", scraped_ms, "__help", "__kind", F.posexplode("__lines").alias("seq", "__line")).select(
        "scrape_id", scraped_ms, "__help", "__kind", "seq",
        *[F.regexp_extract("__line", _SAMPLE, i).alias(name) for i, name in enumerate(fields, 1)],
    )
    metric = F.col("metric")
    base = F.try_element_at("__kind", F.regexp_replace(metric, "_(bucket|sum|count)$", ""))
    kind = F.lower(F.coalesce(
        F.try_element_at("__kind", metric), F.when(F.lower(base).isin("histogram", "summary"), base), F.lit("untyped"),
    ))
    number = F.regexp_replace("__number", r"^(?i)([+-]?)inf$", "$1Infinity")
    typed = parts.where(metric != "").withColumns({"kind": kind, "value": number.try_cast("double")}).where(
        F.col("kind").isin("counter", "gauge", "untyped") & F.col("value").isNotNull()
    )
    labels = last_wins(
        F.regexp_extract_all("__labels", F.lit(_LABEL), F.lit(1)), F.transform(F.regexp_extract_all("__labels", F.lit(_LABEL), F.lit(2)), unescaped)
    )
    return typed.select(
        "scrape_id", "seq", "metric", "kind", F.coalesce(unescaped(F.try_element_at("__help", metric)), F.lit("N/A")).alias("description"),
        F.when(F.col("__labels") == "", F.create_map().cast("map<string,string>")).otherwise(labels).alias("labels"), "value",
        F.when(F.col("__own") != "", F.col("__own").try_cast("bigint")).otherwise(F.col(scraped_ms)).alias("timestamp_ms"),
    )


def prometheus_to_telemetry(samples: DataFrame, cfg: GatewayConfig, label_keys: bool = False) -> DataFrame:
    """Telemetry rows of samples; with ``label_keys`` each set of labels is a series of its own."""
    value = finite(F.col("value"))
    suffix = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(F.lit("/"), e["key"], F.lit("="), e["value"])), "")
    destination = F.concat(F.lit("/" + cfg.prometheus_prefix + "/"), F.col("metric"))
    props = F.to_variant_object(F.struct(
        F.col("timestamp_ms").alias("timestamp"), F.col("description"), F.col("metric").alias("prometheus_key"), F.col("labels"),
    ))
    return telemetry(
        samples, cfg,
        id=stable_id(F.col("scrape_id"), F.col("seq"), F.col("metric")),
        origin=F.lit(cfg.source),
        destination=F.concat(destination, suffix) if label_keys else destination,
        content_type=F.when(value.isNull(), F.lit(OTHER_CONTENT)).otherwise(F.lit(FLOAT_CONTENT)),
        data=value, data_float=value, properties=props, event_ns=F.col("timestamp_ms") * F.lit(1_000_000),
    )
