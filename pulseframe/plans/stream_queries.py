"""Streaming queries run over the files that are there, each checked against the batch SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pulseframe.functions.fields import epoch_micros
from pulseframe.plans.ingest_queries import INGEST_SQL, item_dimension, raw_envelopes
from pulseframe.model import LOG_CONTENT
from pulseframe.operators.bayes import train
from pulseframe.plans.series_queries import ALERT_PAIRS_SQL, NEWEST, ROLLING_SQL, ROUNDED, _round
from pulseframe.plans.tables import CFG, event_telemetry, micros, path_sum, table
from pulseframe.sinks.shapes import table_rows
from pulseframe.sources.envelope import parse_envelopes
from pulseframe.sources.history import RefreshedTable, lookup_items
from pulseframe.sources.training import labelled
from pulseframe.session import scratch_path
from pulseframe.streaming.jobs import (
    alert_stream, analyse_stream, batch_sink, current_state, read_table_stream, rolling_stream, run_gateway_stream, run_once, run_to_table,
    value_stream,
)


FILES = 8
#: Rows of a file, and so of a micro-batch, at the most.
FILE_ROWS = 4_000_000


def _land(rows, order, path, file_rows=FILE_ROWS):
    """Rows as files that follow each other in time, as a stream finds them: ``FILES``, and more for a large table.

    All slices are cut out at once, each by a few tasks, and then land one by one.
    """
    spark = rows.sparkSession
    files = max(FILES, -(-rows.count() // file_rows))
    shares = [i / files for i in range(1, files)]
    bounds = sorted(set(rows.agg(F.percentile_approx(order, shares, 100 * files)).first()[0] or []))
    if not bounds:
        rows.coalesce(1).write.mode("append").parquet(path)
        return
    number = reduce(lambda a, b: a + b, [(F.col(order) >= low).cast("int") for low in bounds])
    cut = scratch_path(spark, "slices")
    sliced = rows.where(F.col(order).isNotNull()).withColumn("__slice", number)
    sliced.repartitionByRange(4 * (len(bounds) + 1), order).write.partitionBy("__slice").parquet(cut)
    for (found,) in sorted(spark.read.parquet(cut).select("__slice").distinct().collect()):
        spark.read.schema(rows.schema).parquet(f"{cut}/__slice={found}").coalesce(1).write.mode("append").parquet(path)


def _stream(spark, d, name, order):
    """A table as a stream of one file per micro-batch, so that state is carried from batch to batch."""
    rows, path = table(spark, d, name), scratch_path(spark, name)
    _land(rows, order, path)
    return read_table_stream(spark, path, "*.parquet", rows.schema, files_per_batch=1)


def _events(spark, d):
    rows, path = table(spark, d, "events").withColumn("at", micros()), scratch_path(spark, "events")
    _land(rows, "at", path)
    return read_table_stream(spark, path, "*.parquet", rows.schema, files_per_batch=1)


def stream_rolling_stats(spark, d):
    keyed = _events(spark, d).select(F.col("event_type").alias("key"), "event_id", "at", "value")
    done = run_once(rolling_stream(keyed), "rolling")
    return done.select("event_id", F.col("key").alias("event_type"), "n_of_samples", *[_round(c, n) for c, n in ROUNDED.items()])


def stream_metric_last(spark, d):
    keyed = _events(spark, d).select(F.col("event_type").alias("key"), "event_id", "at", F.col("props").alias("value"))
    base = scratch_path(spark, "values")
    run_to_table(value_stream(keyed), f"{base}/table", f"{base}/checkpoint")
    return current_state(spark, f"{base}/checkpoint").select("key", "last", F.size("sample").cast("bigint").alias("samples"))


def stream_alert_pairs(spark, d):
    kind = F.col("event_type")
    keyed = _events(spark, d).where(kind.isin("error", "signup")).select(
        F.col("user_id").alias("problem"), "at", F.col("event_id").alias("eventid"), F.when(kind == "error", 1).otherwise(0).cast("bigint").alias("value")
    )
    done = run_once(alert_stream(keyed), "alerts")
    return done.select("problem", F.col("eventid").alias("event_id"), "state", F.col("open_eventid").alias("open_event_id"))


def stream_item_lookup(spark, d):
    """Facts of each micro-batch joined with an item table that is read again every hour."""
    base = scratch_path(spark, "lookup")
    facts = _stream(spark, d, "lineitem", "l_orderkey").select(F.col("l_partkey").alias("itemid"), "l_orderkey", "l_quantity")
    items = RefreshedTable(lambda: item_dimension(spark, d), 3600)
    query = run_gateway_stream(
        facts, lambda batch: lookup_items(batch, items()), batch_sink(f"{base}/out"), f"{base}/checkpoint"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("key_").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


def stream_gateway(spark, d):
    """Envelope texts land as files, and a job parses them and appends typed rows to a table."""
    base = scratch_path(spark, "gateway")
    raw_envelopes(spark, d).select("value").repartition(FILES).write.text(f"{base}/in")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{base}/in")
    query = run_gateway_stream(
        lines, lambda batch: table_rows(parse_envelopes(batch, CFG), CFG),
        batch_sink(f"{base}/out"), f"{base}/checkpoint",
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("key", "zabbix_host", F.timestamp_seconds(F.unix_seconds("ts")).alias("at"), "data_float").select(
        "key", "zabbix_host", F.floor(epoch_micros(F.col("at")) / 1_000_000).alias("clock"), "data_float"
    )


def stream_gateway_analysis(spark, d):
    """Telemetry in several micro-batches: floats with all attributes, logs with a category, the rest as it is."""
    base = scratch_path(spark, "analysis")
    plain = ["id", "topic", "content_type", "event_ns", "data_float"]
    by_user = event_telemetry(spark, d).withColumn("topic", F.concat("topic", F.lit("/"), "origin"))
    rows = by_user.select(*plain, F.to_json("data").alias("data"))
    _land(rows, "event_ns", f"{base}/in")
    model = train(labelled(table(spark, d, "conversations"), "role", "text"))
    stream = read_table_stream(spark, f"{base}/in", "*.parquet", rows.schema, files_per_batch=1)

    def categorise(batch):
        text = F.when(F.col("content_type") == LOG_CONTENT, F.from_json(F.concat(F.lit('{"t":'), F.col("data"), F.lit("}")), "t string")["t"])
        return model.categorize(batch.withColumn("__text", text), "__text").drop("__text")

    query = run_gateway_stream(analyse_stream(stream, CFG), categorise, batch_sink(f"{base}/out"), f"{base}/checkpoint")
    query.awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select(
        F.col("id").cast("bigint").alias("id"), "content_type", F.col("n_of_samples").alias("n"), F.round("mean", 9).alias("mean"),
        F.size("markov_chain_forecast").cast("bigint").alias("steps"), path_sum(F.col("markov_chain_forecast")).alias("path_sum"),
        F.col("category").isNotNull().alias("categorised"),
    )


def stream_planted_analysis(spark, d):
    """Series of 128 events of all types in several micro-batches: arrays of anomalies and breakouts as they are known.

    Even series have a weekly season with one spike, odd ones one change of level. The last series may be shorter.
    """
    base, cfg = scratch_path(spark, "planted"), CFG
    series, p = F.floor(F.col("event_id") / 128), F.col("event_id") % 128
    season = p % 7 * 10.0 + F.when(p == 40 + series % 20, 50.0).otherwise(0.0)
    level = F.when(p >= 64, 10.0 + series % 3).otherwise(0.0)
    value = F.when(series % 2 == 0, season).otherwise(level) + (F.col("event_id") * 37 % 11) / 100
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), series.cast("string").alias("topic"), F.col("event_id").alias("event_ns"), value.alias("data_float")
    )
    _land(rows, "event_ns", f"{base}/in")
    stream = read_table_stream(spark, f"{base}/in", "*.parquet", rows.schema, files_per_batch=1)
    done = run_to_table(analyse_stream(stream, cfg), f"{base}/out", f"{base}/checkpoint")
    whole, even = F.col("id") % 128 == 127, F.floor(F.col("id") / 128) % 2 == 0
    met = F.when(whole & even, F.col("anomalies")).when(whole, F.col("breakouts"))
    return done.select(
        "id", F.col("n_of_samples").alias("n"), F.size(F.when(whole, met)).cast("bigint").alias("found"), F.round(met[0], 6).alias("first_found"),
        path_sum(F.col("markov_chain_forecast")).alias("path_sum"),
    )


QUERIES = {
    "stream_gateway_analysis": (
        stream_gateway_analysis,
        """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS content_type,
                  CASE WHEN f THEN count(*) OVER w END AS n, CASE WHEN f THEN round(avg(value) OVER w, 9) END AS mean,
                  CASE WHEN f THEN least(8, count(*) OVER w) END AS steps,
                  CASE WHEN f THEN round(list_sum(list_transform((list(value) OVER w)[1:8], lambda x, i: x * i)), 6) END AS path_sum,
                  event_type = 'error' AS categorised
           FROM (SELECT *, event_type IN ('view', 'purchase') AS f FROM events)
           WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)""",
    ),
    "stream_planted_analysis": (
        stream_planted_analysis,
        """SELECT event_id AS id, p + 1 AS n, CASE WHEN p = 127 THEN 1 END AS found,
                  CASE WHEN p = 127 THEN round(max(CASE WHEN p = hit THEN value END) OVER s, 6) END AS first_found,
                  round(list_sum(list_transform((list(value) OVER s)[1:8], lambda x, i: x * i)), 6) AS path_sum
           FROM (SELECT *, CASE WHEN series % 2 = 0 THEN 40 + series % 20 ELSE 64 END AS hit,
                        (CASE WHEN series % 2 = 0 THEN p % 7 * 10.0 + CASE WHEN p = 40 + series % 20 THEN 50.0 ELSE 0.0 END
                              WHEN p >= 64 THEN 10.0 + series % 3 ELSE 0.0 END)::DOUBLE + (event_id * 37 % 11)::DOUBLE / 100 AS value
                 FROM (SELECT event_id, event_id // 128 AS series, event_id % 128 AS p FROM events))
           WINDOW s AS (PARTITION BY series ORDER BY p)""",
    ),
    "stream_rolling_stats": (stream_rolling_stats, ROLLING_SQL),
    "stream_metric_last": (
        stream_metric_last,
        f"""SELECT event_type AS key, arg_max(props, ts) AS "last", least(128, count(*)) AS samples FROM {NEWEST} GROUP BY event_type""",
    ),
    "stream_alert_pairs": (stream_alert_pairs, ALERT_PAIRS_SQL),
    "stream_item_lookup": (
        stream_item_lookup,
        """SELECT lower(p_type) || '["x' || p_size || '",,' || CASE WHEN p_size > 45 THEN p_brand ELSE replace(p_brand, '#', '/') END || ']' AS key_,
                  count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    ),
    "stream_gateway": (
        stream_gateway,
        f"""SELECT topic AS key, origin AS zabbix_host, event_ns // 1000000000 AS clock, number AS data_float FROM ({INGEST_SQL})""",
    ),
}
