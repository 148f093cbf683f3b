"""JSON envelopes as telemetry rows, in batch or as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.fields import json_get
from pulseframe.model import GatewayConfig, finite, float_token, topic_key

_DATA = "$.body.details.details.data"


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per line of the files below a path."""
    return (spark.readStream if streaming else spark.read).text(path)


def split_payloads(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per JSON value where a payload holds several, one after another.

    Reading of a payload stops at the first value that cannot be decoded. Rows
    holding a single value need no Python: they pass through ``parse_envelopes``.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            rows = []
            for number, text in zip(batch["payload_id"], batch[value]):
                at, seq = 0, 0
                while text is not None:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at >= len(text):
                        break
                    try:
                        _, end = decoder.raw_decode(text, at)
                    except ValueError:
                        break
                    rows.append((number, seq, text[at:end]))
                    at, seq = end, seq + 1
            yield pd.DataFrame(rows, columns=["payload_id", "seq", "value"])

    return df.select("payload_id", value).mapInPandas(split, "payload_id bigint, seq bigint, value string")


def parse_envelopes(df: DataFrame, cfg: GatewayConfig, value: str = "value") -> DataFrame:
    """Telemetry rows of JSON envelopes; anything without a destination is dropped."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(value)))
    v = F.col("__v")

    def text(*path: str):
        return json_get(v, *path)

    details = ("body", "details")
    ns = json_get(v, *details, "properties", "zabbix_clock", kind="bigint") * F.lit(1_000_000_000) + F.coalesce(
        json_get(v, *details, "properties", "zabbix_ns", kind="bigint"), F.lit(0)
    )
    # Records without a clock may carry nanoseconds (logs) or milliseconds (scrapes).
    stamp = json_get(v, *details, "properties", "timestamp", kind="bigint")
    event_ns = F.coalesce(ns, F.when(stamp < F.lit(10**15), stamp * F.lit(1_000_000)).otherwise(stamp))
    destination = text(*details, "destination")
    is_float = float_token(F.col(value), _DATA, v)
    return parsed.where(destination.isNotNull()).select(
        text("id").alias("id"),
        text("headers", "messageType").alias("message_type"),
        text("headers", "route").alias("route"),
        text("headers", "streamName").alias("stream_name"),
        text("headers", "version").alias("version"),
        text(*details, "origin").alias("origin"),
        destination.alias("destination"),
        topic_key(destination, cfg).alias("topic"),
        json_get(v, *details, "properties", kind="variant").alias("properties"),
        text(*details, "details", "detailType").alias("detail_type"),
        json_get(v, *details, "details", "contentType", kind="int").alias("content_type"),
        json_get(v, *details, "details", "data", kind="variant").alias("data"),
        F.when(is_float, finite(F.try_variant_get(v, _DATA, "double"))).alias("data_float"),
        event_ns.alias("event_ns"),
        F.timestamp_micros(F.floor(event_ns / 1000).cast("bigint")).alias("event_ts"),
    )


def subscribe(df: DataFrame, cfg: GatewayConfig, key: str | None = None) -> DataFrame:
    """Records of one topic below the prefix, by default the aggregate topic."""
    topic = cfg.aggregate_topic if key is None else f"{cfg.topic_prefix}/{key.lstrip('/')}"
    return df.where(F.col("topic") == topic)


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All records of several inputs; a column an input lacks is NULL."""
    merged = first
    for other in others:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def monitor(df: DataFrame, cfg: GatewayConfig, key: str, to: str = "console"):
    """Tail one topic of a stream to the console or an in-memory table."""
    writer = subscribe(df, cfg, key).select("topic", F.to_json(F.struct("*")).alias("value")).writeStream
    return (writer.format(to).queryName("monitor") if to == "memory" else writer.format(to)).start()
