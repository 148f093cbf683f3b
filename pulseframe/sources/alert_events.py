"""Problem and recovery events as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.fields import json_get
from pulseframe.model import HOSTS, TAGS

_INTEGER = r"^-?\d+$"


def parse_alert_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Typed alert events of JSON texts. A ``value`` that is not an integer token becomes NULL."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(value))).where(F.col("__v").isNotNull())
    v = F.col("__v")

    def integer(name: str):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        text = F.get_json_object(F.col(value), f"$.{name}")
        return F.when((kind == "BIGINT") & text.rlike(_INTEGER), json_get(v, name, kind="bigint"))

    return parsed.select(
        json_get(v, "clock", kind="bigint").alias("clock"), json_get(v, "ns", kind="bigint").alias("ns"),
        integer("value").alias("value"), integer("eventid").alias("eventid"), integer("p_eventid").alias("p_eventid"),
        json_get(v, "name").alias("name"), json_get(v, "severity", kind="int").alias("severity"),
        F.from_json(F.get_json_object(value, "$.hosts"), HOSTS).alias("hosts"),
        F.from_json(F.get_json_object(value, "$.groups"), "array<string>").alias("groups"),
        F.from_json(F.get_json_object(value, "$.tags"), TAGS).alias("tags"),
    )
