"""Row shapes of the sinks: JSON lines, topic messages, gauges, line protocol, tables, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.fields import json_get
from pulseframe.functions.paths import topic_fanout
from pulseframe.model import STRING_CONTENTS, GatewayConfig, envelope_json
from pulseframe.operators.routing import is_typed, typed_values


def json_lines(df: DataFrame, pretty: bool = False) -> DataFrame:
    return df.select(envelope_json(df, pretty).alias("value"))


def topic_messages(df: DataFrame, cfg: GatewayConfig, mode: str | None = None) -> DataFrame:
    """(topic, value) messages for a bus; rename ``topic`` to ``key`` for Kafka."""
    written = df.select("destination", envelope_json(df).alias("value"))
    return topic_fanout(written, cfg, mode).select("topic", "value")


def mqtt_messages(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    return df.select(F.lit(f"{cfg.platform}/{cfg.aggregate_key}").alias("topic"), envelope_json(df).alias("value"))


def multi_topic(df: DataFrame, topics: Sequence[str], mode: str = "broadcast") -> DataFrame:
    """Messages to several topics: each record to all of them, or (``balance``) to just one."""
    names = F.array(*[F.lit(t) for t in topics])
    value = envelope_json(df).alias("value")
    if mode == "broadcast":
        return df.select(value).select(F.explode(names).alias("topic"), "value")
    pick = F.pmod(F.xxhash64("id"), F.lit(len(topics))).cast("int")
    return df.select(F.get(names, pick).alias("topic"), value)


def statsd_gauges(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """Latest float per key as ``platform.key:value|g``."""
    latest = df.where(F.col("data_float").isNotNull()).groupBy("topic").agg(
        F.max_by("data_float", F.struct("event_ns", "id")).alias("v")
    )
    return latest.select(F.concat(F.lit(cfg.platform + "."), F.col("topic"), F.lit(":"), F.col("v").cast("string"), F.lit("|g")).alias("value"))


def _escape_key(text: Column) -> Column:
    return F.regexp_replace(text, "([,= ])", r"\\$1")


def _escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def influx_lines(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """Line protocol, one point per record that has a clock and a host."""
    host = json_get(F.col("properties"), "zabbix_host_name")
    content = F.col("content_type")
    typed = typed_values(F.col("data"), content)
    field = (
        F.when(content == 0, F.concat(F.lit(",data="), typed["data_float"].cast("string")))
        .when(content == 3, F.concat(F.lit(",data="), typed["data_int"].cast("string"), F.lit("i")))
        .when(content.isin(*STRING_CONTENTS), F.concat(F.lit(',data="'), _escape_text(typed["data_str"]), F.lit('"')))
        .otherwise("")
    )
    ready = df.where(F.col("event_ns").isNotNull() & host.isNotNull())
    tags = F.concat(
        F.lit(",platform="), _escape_key(F.lit(cfg.platform)), F.lit(",source="), _escape_key(F.lit(cfg.source)),
        F.lit(",zabbix_host="), _escape_key(host),
    )
    return ready.select(F.concat(
        F.regexp_replace("topic", "([, ])", r"\\$1"), tags, F.lit(" zabbix_type="), content.cast("string"), F.lit("i"),
        F.coalesce(field, F.lit("")), F.lit(" "), F.col("event_ns").cast("string"),
    ).alias("value"))


def table_rows(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """Rows of the analytical table; a typed column that does not apply holds 0 or ''.

    The common ``event_ts`` stands in for the clock, so logs and scrapes are kept too.
    """
    typed = typed_values(F.col("data"), F.col("content_type"))
    props = F.col("properties")
    return df.where(is_typed(F.col("content_type")) & F.col("event_ts").isNotNull()).select(
        F.date_trunc("second", "event_ts").alias("ts"), F.col("topic").alias("key"), F.lit(cfg.source).alias("source"),
        F.coalesce(json_get(props, "zabbix_host_name"), F.col("origin")).alias("zabbix_host"),
        F.coalesce(json_get(props, "zabbix_item"), F.lit("")).alias("zabbix_item"),
        F.col("content_type").cast("tinyint").alias("data_type"),
        F.coalesce(typed["data_int"], F.lit(0)).alias("data_int"),
        F.coalesce(typed["data_float"], F.lit(0.0)).alias("data_float"),
        F.coalesce(typed["data_str"], F.lit("")).alias("data_str"),
    )


def write_table(df: DataFrame, cfg: GatewayConfig, path: str, mode: str = "append") -> None:
    """Parquet sorted by key within each file, so that row groups can be skipped by key."""
    table_rows(df, cfg).sortWithinPartitions("key", "ts").write.mode(mode).parquet(path)


def dropped_counts(df: DataFrame) -> DataFrame:
    """How many records a table or line sink leaves out, and why."""
    return df.agg(
        F.count("*").alias("records"), F.count_if(F.col("event_ts").isNull()).alias("without_time"),
        F.count_if(~F.coalesce(is_typed(F.col("content_type")), F.lit(False))).alias("without_type"),
    )


def sender_payloads(df: DataFrame, batch: int = 1) -> DataFrame:
    """``{request, data: [{host, key, value}]}`` payloads of up to ``batch`` records each.

    Chunks are cut from the Arrow batches of each partition, without a shuffle.
    """
    item = json_get(F.col("properties"), "zabbix_item")
    ready = df.where(F.col("origin").isNotNull() & item.isNotNull() & F.col("data").isNotNull())
    entry = F.struct(F.col("origin").alias("host"), item.alias("key"), F.col("data").alias("value"))
    request = F.lit("sender data").alias("request")
    if batch <= 1:
        return ready.select(F.to_json(F.struct(request, F.array(entry).alias("data"))).alias("value"))
    text = F.concat(
        F.lit('{"host":'), F.to_json(F.col("origin").cast("variant")), F.lit(',"key":'), F.to_json(item.cast("variant")),
        F.lit(',"value":'), F.to_json("data"), F.lit("}"),
    )

    def chunk(batches):
        import pandas as pd

        for rows in batches:
            parts = rows["entry"].tolist()
            yield pd.DataFrame({"value": [
                '{"request":"sender data","data":[' + ",".join(parts[i:i + batch]) + "]}" for i in range(0, len(parts), batch)
            ]})

    return ready.select(text.alias("entry")).mapInPandas(chunk, "value string")
