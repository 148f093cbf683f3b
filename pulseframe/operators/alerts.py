"""Pairing of alert openings with their resolutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.fields import epoch_nanos
from pulseframe.model import INT_CONTENT, GatewayConfig, stable_id, telemetry
from pulseframe.operators.scale import BLOCK_ROWS, HOT_ROWS, over_series


def _known(events: DataFrame) -> DataFrame:
    """Openings and resolutions with the problem they are about; other rows go."""
    opens, closes = F.col("value") == 1, F.col("value") == 0
    problem = F.when(opens, F.col("eventid")).when(closes, F.col("p_eventid"))
    return events.withColumn("problem", problem).where(F.col("problem").isNotNull())


def alert_history(
    events: DataFrame, order: Sequence[str], hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every opening and resolution with ``state`` and the ``alert_id`` shared by a pair.

    A problem is open exactly if the row before it in its history is an opening,
    so one row of look-back decides whether a resolution matches. ``state`` is
    open, closed or orphan; an opening seen again replaces the earlier one.
    """
    names = [f"open_{c}" for c in order]

    def compute(rows: DataFrame, part: list[str]) -> DataFrame:
        history = Window.partitionBy(*part).orderBy(*order)
        before = F.lag(F.struct("value", *order)).over(history)
        return rows.withColumn("__before", before)

    seen = over_series(_known(events), ["problem"], order, 1, compute, hot_rows, block_rows)
    is_open = F.col("value") == 1
    matched = ~is_open & (F.col("__before.value") == 1)
    opened = {n: F.when(is_open, F.col(c)).when(matched, F.col(f"__before.{c}")) for n, c in zip(names, order)}
    return seen.withColumns({
        "state": F.when(is_open, "open").when(matched, "closed").otherwise("orphan"), **opened,
    }).withColumn(
        "alert_id", F.when(F.col("state") != "orphan", stable_id(F.col("problem"), *[F.col(n) for n in names]))
    ).drop("__before")


def alert_pairs(events: DataFrame, order: Sequence[str], **limits) -> DataFrame:
    """What is emitted: all openings and the resolutions that match one."""
    return alert_history(events, order, **limits).where(F.col("state") != "orphan")


def alerts_orphan(events: DataFrame, order: Sequence[str], **limits) -> DataFrame:
    """Resolutions of problems that were not open."""
    return alert_history(events, order, **limits).where(F.col("state") == "orphan")


def alerts_open(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Problems whose latest row is an opening; one aggregate with map-side combine."""
    known = _known(events)
    rest = [c for c in known.columns if c != "problem"]
    last = known.groupBy("problem").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.where(F.col("last.value") == 1).select("problem", "last.*")


def alerts_to_telemetry(pairs: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """``event`` records of emitted openings and resolutions."""
    props = F.to_variant_object(F.struct(
        F.col("clock").alias("zabbix_clock"), F.col("ns").alias("zabbix_ns"), F.col("hosts").alias("zabbix_host_name"),
        F.col("eventid").alias("zabbix_eventid"), F.col("name"), F.col("tags"), F.col("groups"),
    ))
    return telemetry(
        pairs, cfg, id=F.col("alert_id"), origin=F.lit(cfg.source), destination=F.lit("/" + cfg.events_key),
        content_type=F.lit(INT_CONTENT), data=F.col("value"), properties=props,
        event_ns=epoch_nanos(F.col("clock"), F.col("ns")), message_type="event",
    )
