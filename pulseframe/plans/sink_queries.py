"""Sink shapes and whole gateway runs, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.model import GatewayConfig
from pulseframe.operators.alerts import alert_pairs, alerts_to_telemetry
from pulseframe.operators.bayes import train
from pulseframe.plans.gateway import gateway
from pulseframe.plans.series_queries import ALERT_ORDER, ALERT_PAIRS_SQL, alert_events
from pulseframe.plans.tables import CFG, event_telemetry, path_sum, table
from pulseframe.session import scratch_path
from pulseframe.sinks.shapes import (
    dropped_counts, influx_lines, json_lines, mqtt_messages, multi_topic, sender_payloads, statsd_gauges, table_rows,
    topic_messages, write_table,
)
from pulseframe.sources.training import labelled

PREFIX = CFG.topic_prefix
ENVELOPE_SQL = f"""
    SELECT *, '{{"headers":{{"messageType":"telemetry","route":"local","streamName":"local","cultureCode":null,"version":"v2",' ||
        '"encryptionAlgorithm":null,"compressionAlgorithm":null}},"body":{{"details":{{"origin":"' || host || '","destination":"/' || event_type ||
        '","properties":{{"zabbix_clock":' || clock || ',"zabbix_host_name":"' || host || '","zabbix_item":"' || event_type || '[total]"' ||
        ',"zabbix_ns":' || ns || '}},"details":{{"detailType":"","contentType":' || content || ',"data":' || data || '}}}}}},"id":"' || event_id || '"}}' AS value,
        '{PREFIX}/' || event_type AS topic
    FROM (SELECT event_id, event_type, user_id, "value" AS x, ts, epoch_us(ts) // 1000000 AS clock, epoch_us(ts) % 1000000 * 1000 AS ns, 'host ' || user_id AS host,
              CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS content,
              CASE event_type WHEN 'error' THEN '"' || 'failure of user ' || user_id || ' ' || replace(props, '"', '\\"') || '"'
                   WHEN 'click' THEN floor("value")::BIGINT::VARCHAR ELSE "value"::VARCHAR END AS data,
              'failure of user ' || user_id || ' ' || props AS message FROM events)"""


def sink_json(spark, d):
    return json_lines(event_telemetry(spark, d))


def sink_topic_messages(spark, d):
    return topic_messages(event_telemetry(spark, d), CFG, "both")


def sink_mqtt(spark, d):
    return mqtt_messages(event_telemetry(spark, d), CFG)


def sink_multi_topic(spark, d):
    sent = multi_topic(event_telemetry(spark, d), ["a", "b", "c"])
    return sent.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("characters"))


def sink_multi_topic_balance(spark, d):
    """Each record goes to exactly one of the topics."""
    sent = multi_topic(event_telemetry(spark, d), ["a", "b", "c"], "balance")
    return sent.agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"), F.count_if(F.col("topic").isNull()).alias("lost"))


def sink_statsd(spark, d):
    return statsd_gauges(event_telemetry(spark, d), CFG)


def sink_influx_lines(spark, d):
    return influx_lines(event_telemetry(spark, d), CFG)


def sink_table(spark, d):
    rows = table_rows(event_telemetry(spark, d), CFG)
    return rows.withColumn("ts", F.unix_seconds("ts")).withColumn("data_type", F.col("data_type").cast("int"))


def sink_table_written(spark, d):
    """Written as Parquet in the shared folder and read back with a filter on the key."""
    path = scratch_path(spark, "table")
    write_table(event_telemetry(spark, d), CFG, path)
    return spark.read.parquet(path).where(F.col("key") == f"{PREFIX}/view").select("key", "zabbix_host", "data_float")


def sink_dropped(spark, d):
    return dropped_counts(event_telemetry(spark, d))


def sink_zabbix_payload(spark, d):
    return sender_payloads(event_telemetry(spark, d))


def gateway_analysis(spark, d):
    """Float records enriched; all others pass unchanged."""
    done = gateway(event_telemetry(spark, d), GatewayConfig(analysis=True))
    a = F.col("analytical_data")
    return done.select(
        F.col("id").cast("bigint").alias("id"), "content_type", a["n_of_samples"].alias("n"), F.round(a["mean"], 9).alias("mean"),
        F.round(a["tsf_next"], 5).alias("tsf_next"),
    )


def gateway_logs(spark, d):
    """Log records get a category learned from ``conversations`` roles, floats their statistics."""
    model = train(labelled(table(spark, d, "conversations"), "role", "text"))
    docs = table(spark, d, "documents").select(
        (-F.col("doc_id") - 1).alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit(0).cast("bigint").alias("user_id"), F.lit("error").alias("event_type"), F.lit(0.0).alias("value"), F.col("text").alias("props"),
    )
    rows = event_telemetry(spark, d, raw=docs).unionByName(event_telemetry(spark, d))
    done = gateway(rows, GatewayConfig(analysis=True, logs_analysis=True), model=model)
    a = F.col("analytical_data")
    return done.groupBy("content_type").agg(
        F.count("*").alias("n"), F.count(a["category"]).alias("with_category"), F.count(a["n_of_samples"]).alias("with_statistics")
    )


def gateway_scripted(spark, d):
    cfg = GatewayConfig(scripted=True)
    done = gateway(event_telemetry(spark, d), cfg, "content_type = 0", lambda df: df.withColumn("origin", F.lit("changed")))
    return done.groupBy("origin", "topic").agg(F.count("*").alias("n"))


def gateway_full_record(spark, d):
    """Every record with all fourteen attributes, forecasts, anomalies and breakouts of its buffer included."""
    rows = event_telemetry(spark, d).withColumn("topic", F.concat("topic", F.lit("/"), "origin"))
    done = gateway(rows, GatewayConfig(analysis=True), per_record=True)
    a = F.col("analytical_data")
    return done.select(
        F.col("id").cast("bigint").alias("id"), a["n_of_samples"].alias("n"), F.round(a["mean"], 9).alias("mean"),
        F.size(a["markov_chain_forecast"]).cast("bigint").alias("steps"), path_sum(a["markov_chain_forecast"]).alias("path_sum"),
    )


def alert_envelopes(spark, d):
    events = alert_events(spark, d).withColumns({
        "name": F.lit("SLA"), "hosts": F.lit(None).cast("array<struct<host:string,name:string>>"),
        "tags": F.lit(None).cast("array<struct<tag:string,value:string>>"), "groups": F.array(F.lit("Linux servers")),
    })
    rows = alerts_to_telemetry(alert_pairs(events, ALERT_ORDER), CFG)
    return rows.groupBy("id", "message_type", "destination", "content_type").agg(
        F.count("*").alias("rows"), F.sum(F.try_variant_get("data", "$", "bigint")).alias("opens")
    ).groupBy("message_type", "destination", "content_type", "rows", "opens").agg(F.count("*").alias("alerts"))


FRAME = "(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)"
LINE = " + ".join(f"{1 / 8 + 4.5 * (i - 4.5) / 42!r} * lag(value, {8 - i}) OVER s" for i in range(1, 9))
QUERIES = {
    "sink_json": (sink_json, f"SELECT value FROM ({ENVELOPE_SQL})"),
    "sink_topic_messages": (
        sink_topic_messages,
        f"SELECT topic, value FROM ({ENVELOPE_SQL}) UNION ALL SELECT '{PREFIX}/aggregation', value FROM ({ENVELOPE_SQL})",
    ),
    "sink_mqtt": (sink_mqtt, f"SELECT 'local/aggregation' AS topic, value FROM ({ENVELOPE_SQL})"),
    "sink_multi_topic": (
        sink_multi_topic,
        f"""SELECT t AS topic, count(*) AS n, sum(length(value))::BIGINT AS characters
            FROM ({ENVELOPE_SQL}), (VALUES ('a'), ('b'), ('c')) v(t) GROUP BY t""",
    ),
    "sink_multi_topic_balance": (sink_multi_topic_balance, "SELECT count(*) AS n, 3::BIGINT AS topics, 0::BIGINT AS lost FROM events"),
    "sink_statsd": (
        sink_statsd,
        f"""SELECT 'local.{PREFIX}/' || event_type || ':' || arg_max(value, ts) || '|g' AS value
            FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type""",
    ),
    "sink_influx_lines": (
        sink_influx_lines,
        f"""SELECT topic || ',platform=local,source={CFG.source},zabbix_host=host\\ ' || user_id || ' zabbix_type=' || content || 'i' ||
                   CASE content WHEN 0 THEN ',data=' || data WHEN 3 THEN ',data=' || data || 'i' WHEN 2 THEN ',data=' || data ELSE '' END ||
                   ' ' || (clock * 1000000000 + ns) AS value FROM ({ENVELOPE_SQL})""",
    ),
    "sink_table": (
        sink_table,
        f"""SELECT clock AS ts, topic AS key, '{CFG.source}' AS source, host AS zabbix_host, event_type || '[total]' AS zabbix_item,
                   content AS data_type, CASE content WHEN 3 THEN floor(x)::BIGINT ELSE 0 END AS data_int,
                   CASE content WHEN 0 THEN x ELSE 0 END AS data_float, CASE content WHEN 2 THEN message ELSE '' END AS data_str
            FROM ({ENVELOPE_SQL}) WHERE content <> 10""",
    ),
    "sink_table_written": (
        sink_table_written, f"SELECT topic AS key, host AS zabbix_host, x AS data_float FROM ({ENVELOPE_SQL}) WHERE event_type = 'view'"
    ),
    "sink_dropped": (
        sink_dropped, "SELECT count(*) AS records, 0::BIGINT AS without_time, count(*) FILTER (event_type = 'signup') AS without_type FROM events"
    ),
    "sink_zabbix_payload": (
        sink_zabbix_payload,
        f"""SELECT '{{"request":"sender data","data":[{{"host":"' || host || '","key":"' || event_type || '[total]","value":' || data || '}}]}}' AS value
            FROM ({ENVELOPE_SQL})""",
    ),
    "gateway_analysis": (
        gateway_analysis,
        f"""SELECT event_id AS id, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS content_type,
                   CASE WHEN f THEN n END AS n, CASE WHEN f THEN mean END AS mean, CASE WHEN f THEN tsf END AS tsf_next FROM (
                SELECT *, event_type IN ('view', 'purchase') AS f, count(*) OVER {FRAME} AS n, round(avg(value) OVER {FRAME}, 9) AS mean,
                       round(CASE WHEN row_number() OVER s < 8 THEN value ELSE {LINE} END, 5) AS tsf
                FROM events WINDOW s AS (PARTITION BY event_type ORDER BY ts, event_id))""",
    ),
    "gateway_logs": (
        gateway_logs,
        """SELECT content AS content_type, count(*) AS n, CASE content WHEN 2 THEN count(*) ELSE 0 END AS with_category,
                  CASE content WHEN 0 THEN count(*) ELSE 0 END AS with_statistics FROM (
               SELECT CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS content FROM events
               UNION ALL SELECT 2 FROM documents) GROUP BY content""",
    ),
    "gateway_scripted": (
        gateway_scripted,
        f"""SELECT 'changed' AS origin, '{PREFIX}/' || event_type AS topic, count(*) AS n
            FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type""",
    ),
    "gateway_full_record": (
        gateway_full_record,
        """SELECT event_id AS id, CASE WHEN f THEN count(*) OVER w END AS n, CASE WHEN f THEN round(avg(value) OVER w, 9) END AS mean,
                  CASE WHEN f THEN least(8, count(*) OVER w) END AS steps,
                  CASE WHEN f THEN round(list_sum(list_transform((list(value) OVER w)[1:8], lambda x, i: x * i)), 6) END AS path_sum
           FROM (SELECT *, event_type IN ('view', 'purchase') AS f FROM events)
           WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)""",
    ),
    "alert_envelopes": (
        alert_envelopes,
        f"""SELECT 'event' AS message_type, '/events' AS destination, 3 AS content_type, rows, opens, count(*) AS alerts FROM (
                SELECT open_event_id, count(*) AS rows, count(*) FILTER (state = 'open') AS opens FROM ({ALERT_PAIRS_SQL}) GROUP BY open_event_id)
            GROUP BY ALL""",
    ),
}
