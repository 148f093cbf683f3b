"""Item keys and topic paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import GatewayConfig, topic_key

# The characters an item key token, a separator and a quoted token may have.
_TOKEN = r'"*[0-9a-zA-Z./_-]+"*'
_WELL_FORMED = r'^(?:[, \t\n\f\[]|"*+[0-9a-zA-Z./_-]++"*+)*+$'


def _unquoted(text: Column) -> Column:
    return F.when(text.rlike('^"[^"]*"$'), F.substring(text, F.lit(2), F.length(text) - 2))


def item_key_path(key: Column) -> Column:
    """``name[param,"param"]`` as ``/name/param/param``; NULL for a key that is not well formed.

    Empty parameters vanish, nothing after the first ``]`` counts, and a slash
    inside a token is kept apart from path slashes as a backslash.
    """
    plain = F.when(key.startswith('"'), _unquoted(key)).otherwise(key)
    head = F.substring_index(plain, "]", 1)
    tokens = F.transform(F.regexp_extract_all(head, F.lit(f"({_TOKEN})"), F.lit(1)), lambda t: F.replace(t, F.lit("/"), F.lit("\\")))
    clean = F.transform(tokens, lambda t: F.when(t.startswith('"'), _unquoted(t)).otherwise(t))
    parts = F.transform(F.filter(clean, lambda t: t.isNotNull()), lambda t: F.concat(F.lit("/"), t))
    return F.when(head.rlike(_WELL_FORMED), F.array_join(parts, ""))


def topic_fanout(df: DataFrame, cfg: GatewayConfig, mode: str | None = None, destination: str = "destination") -> DataFrame:
    """One row per topic a record goes to: ``aggregate``, ``split`` or ``both``."""
    if mode is None:
        mode = "aggregate" if cfg.aggregate else "both" if cfg.aggregate_and_split else "split"
    item = topic_key(F.col(destination), cfg)
    aggregate = F.lit(cfg.aggregate_topic)
    if mode == "aggregate":
        return df.withColumn("topic", aggregate)
    rows = df.where(F.col(destination).isNotNull())
    if mode == "split":
        return rows.withColumn("topic", item)
    if mode == "both":
        return rows.drop("topic").select("*", F.explode(F.array(item, aggregate)).alias("topic"))
    raise ValueError(f"unknown topic mode {mode!r}")
