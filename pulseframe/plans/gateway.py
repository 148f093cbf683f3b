"""The whole gateway as one plan: route, filter, transform, enrich, and hand to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.model import GatewayConfig
from pulseframe.operators.anomaly import anomaly_column
from pulseframe.operators.bayes import LogCategories, text_payload
from pulseframe.operators.breakout import breakout_column
from pulseframe.operators.markov import forecast_column
from pulseframe.operators.rolling import STATISTICS, enrich_series
from pulseframe.operators.routing import Predicate, Transformation, route
from pulseframe.operators.scale import BLOCK_ROWS, HOT_ROWS

ORDER = ["event_ns", "id"]


def analyse(
    df: DataFrame, cfg: GatewayConfig, per_record: bool = False, hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``analytical_data`` to float records; other records pass unchanged.

    ``per_record`` also adds the Markov forecast, anomalies and breakouts of the
    buffer at every record, which costs a Python pass over 128 values a record.
    """
    floats = df.where(F.col("data_float").isNotNull())
    others = df.where(F.col("data_float").isNull())
    done = enrich_series(floats, ["topic"], ORDER, "data_float", hot_rows, block_rows, buffer=per_record)
    fields = ["n_of_samples", "statistical_oscillator", "tsf_next", *STATISTICS[1:]]
    if per_record:
        done = done.withColumns({
            "markov_chain_forecast": forecast_column(F.col("buffer")),
            "anomalies": anomaly_column(F.col("buffer"), cfg.anomalies_window),
            "breakouts": breakout_column(F.col("buffer"), cfg.anomalies_window),
        })
        fields += ["markov_chain_forecast", "anomalies", "breakouts"]
    done = done.select(*df.columns, F.struct(*fields).alias("analytical_data"))
    return done.unionByName(others, allowMissingColumns=True)


def categorise_logs(df: DataFrame, model: LogCategories) -> DataFrame:
    """Adds ``analytical_data.category`` to string records; records without data are dropped."""
    rows = df.where(F.col("data").isNotNull()).withColumn("__text", text_payload(F.col("data")))
    return model.categorize(rows, "__text").drop("__text").withColumn(
        "analytical_data", F.when(F.col("category").isNotNull(), F.struct("category"))
    ).drop("category")


def gateway(
    df: DataFrame, cfg: GatewayConfig, predicate: Predicate | None = None, transformation: Transformation | None = None,
    model: LogCategories | None = None, per_record: bool = False,
) -> DataFrame:
    """Telemetry rows as they leave the gateway.

    With a script (predicate or transformation) every record is filtered and
    transformed and then analysed; logs are only categorised without one.
    """
    if cfg.discard:
        return df.limit(0)
    if cfg.scripted:
        rows = df if predicate is None else df.where(predicate)
        rows = rows if transformation is None else rows.transform(transformation)
        return analyse(rows, cfg, per_record) if cfg.analysis else rows
    routed = route(df, cfg)
    parts = []
    if cfg.logs_analysis:
        if model is None:
            raise ValueError("log analysis needs a trained model")
        parts.append(categorise_logs(routed.where(F.col("branch") == "logs_analysis").drop("branch"), model))
    rest = routed.where(F.col("branch") != "logs_analysis").drop("branch")
    parts.append(analyse(rest, cfg, per_record) if cfg.analysis else rest)
    merged = parts[0]
    for part in parts[1:]:
        merged = _union_analytical(merged, part)
    return merged


def _union_analytical(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of rows whose ``analytical_data`` differ in their fields."""
    fields: dict[str, object] = {}
    for df in (a, b):
        if "analytical_data" in df.columns:
            for f in df.schema["analytical_data"].dataType.fields:
                fields.setdefault(f.name, f.dataType)

    def widen(df: DataFrame) -> DataFrame:
        if not fields:
            return df
        have = set(df.schema["analytical_data"].dataType.fieldNames()) if "analytical_data" in df.columns else set()
        widened = F.struct(*[
            (F.col(f"analytical_data.{n}") if n in have else F.lit(None).cast(t)).alias(n) for n, t in fields.items()
        ])
        known = F.col("analytical_data").isNotNull() if have else F.lit(False)
        return df.withColumn("analytical_data", F.when(known, widened))

    return widen(a).unionByName(widen(b), allowMissingColumns=True)
