"""Raw monitoring history (item values) as telemetry rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.fields import epoch_nanos, json_get
from pulseframe.functions.paths import item_key_path
from pulseframe.model import TAGS, GatewayConfig, float_token, stable_id, telemetry, topic_key


def lookup_items(facts: DataFrame, items: DataFrame, on: str = "itemid") -> DataFrame:
    """Facts with the key of their item; a fact without a known item is dropped.

    No broadcast hint: Spark broadcasts the item table while its size allows and
    otherwise sort-merges, where AQE splits the partitions of a hot item.
    """
    return facts.join(items, on, "inner")


class RefreshedTable:
    """A dimension table that a long stream reads again once its reading is too old.

    Call it within ``foreachBatch``: new files are listed anew after ``seconds``.
    """

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 3600):
        self._read, self._seconds = read, seconds
        self._table, self._at = None, 0.0

    def __call__(self) -> DataFrame:
        now = time.monotonic()
        if self._table is None or now - self._at >= self._seconds:
            self._table, self._at = self._read(), now
        return self._table


def parse_history(df: DataFrame, value: str = "value") -> DataFrame:
    """Item history as JSON texts in the columns that ``history_to_telemetry`` takes; a text that is no JSON is dropped.

    ``is_float`` follows the rule for envelopes: the value's token is written as a float.
    """
    parsed = df.withColumn("__v", F.try_parse_json(F.col(value))).where(F.col("__v").isNotNull())
    v = F.col("__v")
    return parsed.select(
        json_get(v, "itemid", kind="bigint").alias("itemid"),
        F.struct(json_get(v, "host", "host").alias("host"), json_get(v, "host", "name").alias("name")).alias("host"),
        json_get(v, "clock", kind="bigint").alias("clock"), json_get(v, "ns", kind="bigint").alias("ns"),
        json_get(v, "type", kind="int").alias("type"), json_get(v, "name").alias("name"),
        F.from_json(F.get_json_object(value, "$.tags"), TAGS).alias("tags"),
        json_get(v, "value", kind="variant").alias("value"), float_token(F.col(value), "$.value", v).alias("is_float"),
    )


def history_to_telemetry(raw: DataFrame, items: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """``raw`` has itemid, host{host,name}, clock, ns, type, name, tags, value (VARIANT) and is_float."""
    # Keys are converted once per item and not once per fact.
    known = items.withColumn("__path", item_key_path(F.col("key_"))).where(F.col("__path").isNotNull())
    keyed = lookup_items(raw.where(F.col("itemid").isNotNull()), known)
    path = F.col("__path")
    full = topic_key(path, cfg)
    props = F.to_variant_object(F.struct(
        F.col("clock").alias("zabbix_clock"), F.col("ns").alias("zabbix_ns"),
        F.col("host.name").alias("zabbix_host_name"), F.col("itemid").alias("zabbix_itemid"),
        F.col("key_").alias("zabbix_item"), path.alias("topic_item"), F.col("name"), F.col("tags"),
    ))
    return telemetry(
        keyed, cfg,
        id=stable_id(F.col("host.host"), F.col("itemid"), F.col("clock"), F.col("ns")),
        origin=F.col("host.host"), destination=full, content_type=F.col("type"), data=F.col("value"),
        data_float=F.when(F.col("is_float"), F.try_variant_get(F.col("value"), "$", "double")),
        properties=props, event_ns=epoch_nanos(F.col("clock"), F.col("ns")),
    )
