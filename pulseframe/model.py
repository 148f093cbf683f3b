"""The telemetry record: one flat typed row per item, and its nested JSON form.

Operators work on the flat row, so column pruning and predicate pushdown reach
the scan. Only sources and sinks deal with the nested envelope.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content type codes carried by every record.
FLOAT_CONTENT = 0
LOG_CONTENT = 2
INT_CONTENT = 3
STRING_CONTENTS = (1, 2, 4)
OTHER_CONTENT = 10

# Sizes and periods every series uses.
SERIES_LENGTH = 128
FORECAST_PERIOD = 8
MARKOV_ORDER = 8
MARKOV_STEPS = 8
ANOMALY_WINDOW = 7
BREAKOUT_BETA = 0.008
CONSISTENCY_LIMIT = 0.01

TELEMETRY_COLUMNS = [
    "id", "message_type", "route", "stream_name", "version", "origin", "destination",
    "topic", "properties", "detail_type", "content_type", "data", "data_float",
    "event_ns", "event_ts",
]

TAGS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("value", T.StringType())]))
HOSTS = T.ArrayType(T.StructType([T.StructField("host", T.StringType()), T.StructField("name", T.StringType())]))

ANALYTICAL_TABLE = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("key", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("zabbix_host", T.StringType()),
    T.StructField("zabbix_item", T.StringType()),
    T.StructField("data_type", T.ByteType()),
    T.StructField("data_int", T.LongType()),
    T.StructField("data_float", T.DoubleType()),
    T.StructField("data_str", T.StringType()),
])


@dataclass(frozen=True)
class GatewayConfig:
    """Identity of a gateway and the options that steer its stages."""

    protocol_version: str = "v2"
    platform: str = "local"
    source: str = "localhost"
    route: str = "local"
    topic_root: str = "telemetry"
    aggregate_key: str = "aggregation"
    aggregate: bool = False
    aggregate_and_split: bool = False
    events_key: str = "events"
    syslog_file: str = "/var/log/syslog"
    analysis: bool = False
    logs_analysis: bool = False
    scripted: bool = False
    discard: bool = False
    anomalies_window: int = ANOMALY_WINDOW
    extra: dict = field(default_factory=dict)

    @property
    def topic_prefix(self) -> str:
        return f"{self.topic_root}/metric/{self.protocol_version}/{self.platform}"

    @property
    def aggregate_topic(self) -> str:
        return f"{self.topic_prefix}/{self.aggregate_key}"

    @property
    def syslog_destination(self) -> str:
        return f"{self.topic_root}/log/syslog"

    @property
    def prometheus_prefix(self) -> str:
        return f"{self.topic_root}/prometheus_metric/{self.protocol_version}/{self.platform}"


def topic_key(destination: Column, cfg: GatewayConfig) -> Column:
    """Topic of a destination; a destination that already is a full topic stays as it is."""
    prefix = cfg.topic_prefix
    return F.when(destination.startswith(prefix + "/"), destination).otherwise(F.concat(F.lit(prefix), destination))


def stable_id(*parts: Column) -> Column:
    """Identifier that a retried task reproduces, unlike a random one."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def finite(value: Column) -> Column:
    """NULL for NaN and infinities, which JSON cannot carry."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def telemetry(
    df: DataFrame,
    cfg: GatewayConfig,
    *,
    id: Column,
    destination: Column,
    content_type: Column,
    data: Column,
    origin: Column | None = None,
    properties: Column | None = None,
    data_float: Column | None = None,
    event_ns: Column | None = None,
    message_type: str = "telemetry",
    keep: list[Column] | None = None,
) -> DataFrame:
    """Build flat telemetry rows; every source goes through this one builder."""
    ns = F.lit(None).cast("bigint") if event_ns is None else event_ns.cast("bigint")
    as_float = F.lit(None).cast("double") if data_float is None else finite(data_float.cast("double"))
    return df.select(
        id.alias("id"),
        F.lit(message_type).alias("message_type"),
        F.lit(cfg.route).alias("route"),
        F.lit(cfg.platform).alias("stream_name"),
        F.lit(cfg.protocol_version).alias("version"),
        (F.lit(cfg.platform) if origin is None else origin).alias("origin"),
        destination.alias("destination"),
        topic_key(destination, cfg).alias("topic"),
        (F.lit(None).cast("variant") if properties is None else properties).alias("properties"),
        F.lit("").alias("detail_type"),
        content_type.cast("int").alias("content_type"),
        data.cast("variant").alias("data"),
        as_float.alias("data_float"),
        ns.alias("event_ns"),
        F.timestamp_micros(F.floor(ns / 1000).cast("bigint")).alias("event_ts"),
        *(keep or []),
    )


def internal_telemetry(
    df: DataFrame, cfg: GatewayConfig, destination: Column, name: Column, content_type: Column, data: Column, ns: Column
) -> DataFrame:
    """Records a gateway emits about itself, such as batch timings."""
    props = F.to_variant_object(F.struct(
        F.floor(ns / F.lit(1_000_000_000)).cast("bigint").alias("zabbix_clock"),
        F.pmod(ns, F.lit(1_000_000_000)).cast("bigint").alias("zabbix_ns"),
        F.lit(cfg.source).alias("zabbix_host_name"),
        name.alias("name"),
    ))
    return telemetry(
        df, cfg, id=stable_id(F.lit(cfg.source), destination, ns), destination=destination,
        content_type=content_type, data=data, data_float=data.cast("double"), properties=props, event_ns=ns,
    )


def envelope_struct(df: DataFrame) -> Column:
    """Nested envelope of a flat row, with ``analytical_data`` where the row has it."""
    details = [F.col("detail_type").alias("detailType"), F.col("content_type").alias("contentType"), F.col("data")]
    if "analytical_data" in df.columns:
        details.append(F.col("analytical_data"))
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.struct(
            F.col("message_type").alias("messageType"), F.col("route"), F.col("stream_name").alias("streamName"),
            nothing.alias("cultureCode"), F.col("version"), nothing.alias("encryptionAlgorithm"),
            nothing.alias("compressionAlgorithm"),
        ).alias("headers"),
        F.struct(
            F.struct(
                F.col("origin"), F.col("destination"), F.col("properties"), F.struct(*details).alias("details"),
            ).alias("details"),
        ).alias("body"),
        F.col("id"),
    )


def envelope_json(df: DataFrame, pretty: bool = False) -> Column:
    options = {"ignoreNullFields": "false"}
    if pretty:
        options["pretty"] = "true"
    return F.to_json(envelope_struct(df), options)


def float_token(json_text: Column, path: str, parsed: Column) -> Column:
    """True where the JSON token at ``path`` is written as a float.

    The parsed type tells strings apart, the token text tells ``0`` from ``0.0``.
    An integer that no 64-bit type can hold counts as a float too.
    """
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    text = F.get_json_object(json_text, path)
    whole = F.try_variant_get(parsed, path, "decimal(38,0)")
    too_long = (F.length(text) > 18) & ~whole.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))
    number = kind.rlike("^(DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(number & (text.rlike("[.eE]") | F.coalesce(too_long, F.lit(True))), F.lit(False))
