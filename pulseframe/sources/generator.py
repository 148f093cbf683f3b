"""Telemetry made by a user's own column expressions, one row per tick."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import GatewayConfig, stable_id, telemetry


def generate(ticks: DataFrame, cfg: GatewayConfig, metrics: Mapping[str, Column], tick: str, ns: Column) -> DataFrame:
    """A row per tick and metric. ``metrics`` maps a metric name to the column computing its value.

    ``ticks`` may be a table, ``spark.range`` or a ``rate`` stream.
    """
    built = F.array(*[F.struct(F.lit(n).alias("item"), c.cast("double").alias("value")) for n, c in metrics.items()])
    rows = ticks.select("*", ns.cast("bigint").alias("__ns"), F.explode(built).alias("__m"))
    item = F.col("__m.item")
    props = F.to_variant_object(F.struct(item.alias("itemname"), F.floor(F.col("__ns") / 1_000_000).alias("timestamp")))
    return telemetry(
        rows, cfg,
        id=stable_id(F.lit(cfg.source), item, F.col(tick)),
        origin=F.lit(cfg.source),
        destination=F.concat(F.lit(f"/{cfg.topic_root}/generated_metric/{cfg.platform}/"), item),
        content_type=F.lit(0), data=F.col("__m.value"), data_float=F.col("__m.value"), properties=props,
        event_ns=F.col("__ns"), message_type="generated_telemetry",
    )
