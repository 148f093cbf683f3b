"""Test tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.fields import epoch_micros
from pulseframe.model import GatewayConfig, telemetry

CFG = GatewayConfig()
SERIES = ["event_type"]
ORDER = ["ts", "event_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str = "ts") -> Column:
    return epoch_micros(F.col(column))


def event_telemetry(spark: SparkSession, folder: str, cfg: GatewayConfig = CFG, raw: DataFrame | None = None) -> DataFrame:
    """Events as telemetry: views and purchases are floats, clicks integers, errors log lines, signups of no typed kind."""
    events = table(spark, folder, "events") if raw is None else raw
    kind = F.col("event_type")
    content = F.when(kind == "error", 2).when(kind == "click", 3).when(kind == "signup", 10).otherwise(0)
    data = (
        F.when(kind == "error", F.concat(F.lit("failure of user "), F.col("user_id"), F.lit(" "), F.col("props")).cast("variant"))
        .when(kind == "click", F.floor("value").cast("bigint").cast("variant"))
        .otherwise(F.col("value").cast("variant"))
    )
    host = F.concat(F.lit("host "), F.col("user_id"))
    props = F.to_variant_object(F.struct(
        F.floor(micros() / 1_000_000).alias("zabbix_clock"), (F.pmod(micros(), F.lit(1_000_000)) * 1000).alias("zabbix_ns"),
        host.alias("zabbix_host_name"), F.concat(kind, F.lit("[total]")).alias("zabbix_item"),
    ))
    return telemetry(
        events, cfg, id=F.col("event_id").cast("string"), origin=host, destination=F.concat(F.lit("/"), kind),
        content_type=content, data=data, properties=props, event_ns=micros() * 1000,
        data_float=F.when(kind.isin("view", "purchase"), F.col("value")),
    )


def path_sum(values):
    """Sum of an array's values times their places, in which each value and its place count."""
    at_place = F.transform(values, lambda x, i: x * (i + 1))
    return F.round(F.aggregate(at_place, F.lit(0.0), lambda total, x: total + x), 6)
