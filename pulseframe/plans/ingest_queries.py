"""Ingest, routing and projection queries, each with its SQL check.

Raw texts are written from the tables inside the query and then parsed back, so
the original columns serve as the check.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from pulseframe.functions.fields import (
    epoch_nanos, float_to_int, fractional_seconds, int_to_float, json_get, metric_record, metric_to_json,
    metrics_from_json, nanos_part, time_window,
)
from pulseframe.functions.paths import item_key_path, topic_fanout
from pulseframe.model import GatewayConfig, internal_telemetry
from pulseframe.operators.attempts import accepted, rejects, try_filter, try_transform
from pulseframe.operators.routing import is_typed, keep, merge_enrichment, merge_maps, route, transform_record, typed_values
from pulseframe.plans.tables import CFG, event_telemetry, micros, table
from pulseframe.session import scratch_path
from pulseframe.sources.envelope import parse_envelopes, split_payloads, subscribe, union_sources
from pulseframe.sources.generator import generate
from pulseframe.sources.alert_events import parse_alert_events
from pulseframe.sources.history import history_to_telemetry, lookup_items, parse_history
from pulseframe.sources.prometheus import prometheus_samples, prometheus_to_telemetry
from pulseframe.sources.syslog import parse_syslog, severity_counts, syslog_to_telemetry
from pulseframe.sources.training import labelled, parse_sections

PREFIX = CFG.topic_prefix


def raw_envelopes(spark, d):
    """Envelope texts of events; errors are no objects and signups have no destination."""
    kind = F.col("event_type")
    data = F.when(kind == "click", F.floor("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    target = F.when(kind == "signup", "").otherwise(F.concat(F.lit('"destination":"/'), kind, F.lit('",')))
    text = F.concat(
        F.lit('{"headers":{"messageType":"telemetry","route":"local","streamName":"local","version":"v2"},'),
        F.lit('"body":{"details":{"origin":"host'), F.col("user_id"), F.lit('",'), target,
        F.lit('"properties":{"zabbix_clock":'), F.floor(micros() / 1_000_000), F.lit(',"zabbix_ns":'),
        F.pmod(micros(), F.lit(1_000_000)) * 1000, F.lit("},"),
        F.lit('"details":{"detailType":"","contentType":0,"data":'), data, F.lit('}}},"id":"'), F.col("event_id"), F.lit('"}'),
    )
    broken = F.concat(F.lit("["), F.col("event_id"), F.lit("]"))
    return table(spark, d, "events").select("event_id", "ts", F.when(kind == "error", broken).otherwise(text).alias("value"))


def ingest_envelope(spark, d):
    return parse_envelopes(raw_envelopes(spark, d), CFG).select(
        F.col("id").cast("bigint").alias("id"), "origin", "destination", "topic", "message_type", "content_type",
        F.try_variant_get("data", "$", "double").alias("number"), "data_float", "event_ns",
    )


INGEST_SQL = f"""
    SELECT event_id AS id, 'host' || user_id AS origin, '/' || event_type AS destination,
           '{PREFIX}/' || event_type AS topic, 'telemetry' AS message_type, 0 AS content_type,
           CASE WHEN event_type = 'click' THEN floor(value) ELSE value END AS number,
           CASE WHEN event_type <> 'click' THEN value END AS data_float, epoch_us(ts) * 1000 AS event_ns
    FROM events WHERE event_type IN ('view', 'purchase', 'click')"""


def split_payload(spark, d):
    """Payloads of the values of one user and hour, one after another in a single text."""
    raw = raw_envelopes(spark, d).withColumn("payload_id", F.floor(F.col("event_id") / 4)).groupBy("payload_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"]), " ").alias("value")
    )
    return parse_envelopes(split_payloads(raw), CFG).select(
        F.col("id").cast("bigint").alias("id"), "destination", "data_float", "event_ns"
    )


def json_path_get(spark, d):
    doc = F.parse_json(F.concat(F.lit('{"a":{"b":'), F.col("props"), F.lit("}}")))
    return table(spark, d, "events").select(
        "event_id", json_get(doc, "a", "b", "k", kind="bigint").alias("k"), json_get(doc, "a", "x").alias("missing"),
    )


def item_dimension(spark, d):
    """Item keys of parts; sizes above 45 keep a character that no key may have."""
    brand = F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("/")))
    key = F.concat(F.lower("p_type"), F.lit('["x'), F.col("p_size"), F.lit('",,'), brand, F.lit("]"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), key.alias("key_"))


PATH_SQL = r"""CASE WHEN p_size <= 45 THEN '/' || lower(p_type) || '/x' || p_size || '/' || replace(p_brand, '#', '\') END"""


def item_key_paths(spark, d):
    return item_dimension(spark, d).select("itemid", "key_", item_key_path(F.col("key_")).alias("path"))


def item_lookup(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid"), "l_orderkey", "l_linenumber", "l_quantity")
    return lookup_items(facts, item_dimension(spark, d))


def zabbix_history(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("itemid"),
        F.struct(F.concat(F.lit("host"), F.col("l_suppkey")).alias("host"), F.concat(F.lit("name"), F.col("l_suppkey")).alias("name")).alias("host"),
        (F.lit(1_700_000_000) + F.col("l_orderkey")).alias("clock"), F.col("l_linenumber").cast("bigint").alias("ns"),
        F.lit(0).alias("type"), F.lit("quantity").alias("name"), F.lit(None).cast("array<struct<tag:string,value:string>>").alias("tags"),
        F.col("l_quantity").cast("variant").alias("value"), F.lit(True).alias("is_float"),
    )
    return history_to_telemetry(raw, item_dimension(spark, d), CFG).select(
        "origin", "destination", "content_type", "data_float", "event_ns",
        json_get(F.col("properties"), "zabbix_itemid", kind="bigint").alias("itemid"),
        json_get(F.col("properties"), "zabbix_host_name").alias("host_name"),
    )


def scrapes(spark, d):
    """One exposition text per event: a counter, a labelled gauge, an untyped sample and a histogram."""
    text = F.concat(
        F.lit("# HELP hits_total Hits of a "), F.col("event_type"), F.lit("\n# TYPE hits_total counter\nhits_total{user=\""),
        F.col("user_id"), F.lit('",kind="'), F.col("event_type"), F.lit('"} '), F.col("event_id"), F.lit(" "),
        F.floor(micros() / 1000), F.lit("\n# TYPE level gauge\nlevel "), F.col("value"),
        F.lit("\nplain "), F.col("user_id"), F.lit('\n# TYPE lat histogram\nlat_bucket{le="0.5"} 3\nlat_sum 4\nlat_count 5\n'),
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("scrape_id"), text.alias("text"), F.lit(7).cast("bigint").alias("scraped_ms")
    )


def prom_samples(spark, d):
    return prometheus_samples(scrapes(spark, d)).select(
        "scrape_id", "metric", "kind", "description", "value", "timestamp_ms", F.try_element_at("labels", F.lit("kind")).alias("label_kind")
    )


def prom_by_type(spark, d):
    return prometheus_samples(scrapes(spark, d)).groupBy("kind", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


def prom_telemetry(spark, d):
    rows = prometheus_to_telemetry(prometheus_samples(scrapes(spark, d)), CFG, label_keys=True)
    return rows.select("destination", "content_type", "data_float", "event_ns")


PROM_SQL = """
    SELECT event_id AS scrape_id, 'hits_total' AS metric, 'counter' AS kind, 'Hits of a ' || event_type AS description,
           event_id::DOUBLE AS value, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS label_kind, user_id FROM events
    UNION ALL SELECT event_id, 'level', 'gauge', 'N/A', value, 7, NULL, user_id FROM events
    UNION ALL SELECT event_id, 'plain', 'untyped', 'N/A', user_id::DOUBLE, 7, NULL, user_id FROM events"""


def syslog_lines(spark, d):
    """A line form per event type; the priority comes from user and event."""
    kind, ts = F.col("event_type"), F.col("ts")
    pri = F.concat(F.lit("<"), F.pmod("user_id", F.lit(24)) * 8 + F.pmod("event_id", F.lit(8)), F.lit(">"))
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    day = F.concat(F.date_format(ts, "MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss"))
    asl = F.concat(
        F.lit("       120 [Time "), F.floor(micros() / 1_000_000), F.lit("] [TimeNanoSec "), F.pmod(micros(), F.lit(1_000_000)) * 1000,
        F.lit("] [Host host"), F.col("user_id"), F.lit("] [Sender su] [PID "), F.col("event_id"),
        F.lit("] [Level 3] [Facility local3] [Message "), F.col("props"), F.lit("]"),
    )
    line = (
        F.when(kind == "view", F.concat(pri, F.lit("1 "), iso, F.lit(" host"), F.col("user_id"), F.lit(" app "), F.col("event_id"), F.lit(" ID7 - "), F.col("props")))
        .when(kind == "purchase", F.concat(pri, F.lit("1 "), iso, F.lit(" - - - - - "), F.col("props")))
        .when(kind == "click", F.concat(pri, day, F.lit(" host"), F.col("user_id"), F.lit(" su: "), F.col("props")))
        .when(kind == "signup", asl).otherwise(F.concat(F.lit("no priority "), F.col("event_id")))
    )
    return table(spark, d, "events").select("event_id", line.alias("line"))


def syslog_parse(spark, d):
    return parse_syslog(syslog_lines(spark, d), 2024).select(
        "event_id", "format", "facility", "severity", "version", "event_ns", "hostname", "appname", "procid", "msgid", "msg"
    )


def syslog_rejected(spark, d):
    return parse_syslog(syslog_lines(spark, d), 2024).where("format = 'rejected'").select("event_id", "line")


def syslog_severity_counts(spark, d):
    return severity_counts(parse_syslog(syslog_lines(spark, d), 2024))


def syslog_envelope(spark, d):
    props = lambda n, kind="string": json_get(F.col("properties"), n, kind=kind).alias(n)
    return syslog_to_telemetry(parse_syslog(syslog_lines(spark, d), 2024), CFG).select(
        "origin", "destination", "content_type", F.try_variant_get("data", "$", "string").alias("message"),
        props("timestamp", "bigint"), props("zabbix_item"), props("syslog_facility", "int"), props("syslog_severity", "int"),
        props("syslog_version", "int"), props("syslog_appname"), props("syslog_procid"),
    )


SYSLOG_SQL = """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN 'rfc3164' WHEN 'signup' THEN 'asl' WHEN 'error' THEN 'rejected' ELSE 'rfc5424' END AS format,
           CASE event_type WHEN 'signup' THEN 19 WHEN 'error' THEN NULL ELSE user_id % 24 END::INTEGER AS facility,
           CASE event_type WHEN 'signup' THEN 3 WHEN 'error' THEN NULL ELSE event_id % 8 END::INTEGER AS severity,
           CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 0 WHEN 'signup' THEN 0 ELSE 1 END AS version,
           CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN epoch_us(ts) // 1000000 * 1000000000
                ELSE epoch_us(ts) * 1000 END AS event_ns,
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'host' || user_id END AS hostname,
           CASE event_type WHEN 'view' THEN 'app' WHEN 'signup' THEN 'su' END AS appname,
           CASE WHEN event_type IN ('view', 'signup') THEN event_id::VARCHAR END AS procid,
           CASE WHEN event_type = 'view' THEN 'ID7' END AS msgid,
           CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'su: ' || props ELSE props END AS msg
    FROM events"""


def topic_subscribe(spark, d):
    return subscribe(event_telemetry(spark, d), CFG, "click").select(
        F.col("id").cast("bigint").alias("id"), "topic", F.try_variant_get("data", "$", "bigint").alias("data")
    )


def generate_telemetry(spark, d):
    """A constant and a value computed from the tick, one tick per event."""
    ticks = table(spark, d, "events")
    made = generate(ticks, CFG, {"pi": F.lit(3.14), "wave": F.col("event_id") * 0.5}, "event_id", micros() * 1000)
    return made.select("message_type", "origin", "destination", "data_float", "event_ns")


def union_of_sources(spark, d):
    events = event_telemetry(spark, d).select("id", "topic", "origin", "event_ns")
    prom = prometheus_to_telemetry(prometheus_samples(scrapes(spark, d)), CFG).select("topic", "origin", "event_ns", F.lit("prom").alias("via"))
    return union_sources(events, prom).groupBy("via", "topic").agg(F.count("*").alias("n"), F.count("id").alias("with_id"))


def nb_training_set(spark, d):
    return labelled(table(spark, d, "documents"), "lang", "text").groupBy("label").agg(
        F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters")
    )


def topic_fanout_all(spark, d):
    rows = event_telemetry(spark, d).select("id", "destination")
    fanned = [topic_fanout(rows, CFG, m).select(F.lit(m).alias("mode"), "id", "topic") for m in ("aggregate", "split", "both")]
    return fanned[0].unionByName(fanned[1]).unionByName(fanned[2]).groupBy("mode", "topic").agg(F.count("id").alias("n"))


def filter_predicate(spark, d):
    return keep(event_telemetry(spark, d), "data_float > 20 and content_type = 0").select("id", "data_float")


def transform_records(spark, d):
    def change(df):
        return df.withColumns({"origin": F.upper("origin"), "data_float": F.col("data_float") * 2}).withColumn("added", F.lit("here"))

    return transform_record(event_telemetry(spark, d), change).select("id", "origin", "data_float", "added")


def _attempted(spark, done, name):
    """Rows taken and rejected per error, from a table that is written once."""
    path = scratch_path(spark, name)
    done.write.parquet(path)
    stored = spark.read.parquet(path)
    taken = accepted(stored).select("event_id", F.col("value"), F.lit(None).cast("string").alias("error"))
    return taken.unionByName(rejects(stored).select("event_id", "value", F.substring_index("error", ":", 1).alias("error")))


def filter_errors(spark, d):
    """A user's predicate that divides by a value, which is below one for some events."""
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    done = try_filter(events, lambda f: pd.Series([u % int(v) == 0 for u, v in zip(f["user_id"], f["value"], strict=True)]), ["user_id", "value"])
    return _attempted(spark, done, "filtered")


def transform_errors(spark, d):
    """A user's change that reads JSON, and refuses what is beyond a limit."""
    def change(frame):
        k = frame["props"].map(lambda p: json.loads(p)["k"])
        if (k > 98).any():
            raise OverflowError("more than a share can be")
        return pd.DataFrame({"value": frame["value"] * k})

    done = try_transform(table(spark, d, "events").select("event_id", "value", "props"), change, ["value", "props"], {"value": "double"})
    return _attempted(spark, done, "changed")


def merged_enrichment(spark, d):
    rows = merge_enrichment(event_telemetry(spark, d), category=F.lit("a"), rank=F.col("content_type"))
    rows = merge_enrichment(rows, category=F.concat(F.lit("b"), F.col("content_type")), extra=F.lit(1))
    merged = merge_maps(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.col("id")))
    return rows.withColumn("m", merged).select("id", "analytical_data.*", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y"))


def deep_merge(spark, d):
    """A nested struct patched in one field keeps its others."""
    rows = merge_enrichment(event_telemetry(spark, d), log=F.struct(F.lit("a").alias("x"), F.col("id").alias("y")), n=F.lit(1))
    rows = merge_enrichment(rows, log=F.struct(F.upper("origin").alias("x"), F.lit(2).alias("z")))
    a = F.col("analytical_data")
    return rows.select("id", a["log"]["x"].alias("x"), a["log"]["y"].alias("y"), a["log"]["z"].alias("z"), a["n"].alias("n"))


def history_json(spark, d):
    """Item history as raw JSON text: quantities with and without a fraction, and a text."""
    kind = F.col("l_linenumber") % 3
    value = F.when(kind == 0, F.col("l_quantity").cast("string")).when(kind == 1, F.col("l_quantity").cast("bigint").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"'))
    )
    text = F.concat(
        F.lit('{"itemid":'), F.col("l_partkey"), F.lit(',"host":{"host":"h'), F.col("l_suppkey"), F.lit('","name":"n'), F.col("l_suppkey"),
        F.lit('"},"clock":'), F.lit(1_700_000_000) + F.col("l_orderkey"), F.lit(',"ns":'), F.col("l_linenumber"),
        F.lit(',"type":0,"name":"quantity","tags":[{"tag":"a","value":"b"}],"value":'), value, F.lit("}"),
    )
    rows = parse_history(table(spark, d, "lineitem").select(text.alias("value")))
    return rows.select(
        "itemid", F.col("host.host").alias("host"), F.col("host.name").alias("host_name"), "clock", "ns", "type", "name",
        F.get("tags", F.lit(0))["value"].alias("tag"), "is_float", F.try_variant_get("value", "$", "string").alias("value"),
    )


def alert_json(spark, d):
    """Problem events as JSON text; every third value is a string, which is no valid one."""
    kind = F.col("event_type")
    value = F.when(kind == "error", 1).otherwise(0).cast("string")
    text = F.concat(
        F.lit('{"clock":'), F.floor(micros() / 1_000_000), F.lit(',"ns":'), F.pmod(micros(), F.lit(1_000_000)) * 1000,
        F.lit(',"value":'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value),
        F.lit(',"eventid":'), F.col("event_id"), F.lit(',"name":"'), kind, F.lit('","severity":'), F.col("user_id") % 5,
        F.lit(',"hosts":[{"host":"h","name":"n'), F.col("user_id"), F.lit('"}],"groups":["g"],"tags":[]}'),
    )
    rows = parse_alert_events(table(spark, d, "events").select(text.alias("value")))
    return rows.select(
        "clock", "ns", F.col("value").alias("state"), "eventid", "name", "severity", F.get("hosts", F.lit(0))["name"].alias("host_name"),
        F.get("groups", F.lit(0)).alias("group_name"),
    )


def training_sections(spark, d):
    """Training texts with one ``label: [ ... ]`` section each, parsed back to labelled lines."""
    docs = table(spark, d, "documents").where("lang is not null").select(
        F.concat(F.lit("  "), F.col("lang"), F.lit(": [\n    sample "), F.col("doc_id"), F.lit("\n\n    again "), F.col("doc_id"), F.lit("\n  ]\n")).alias("value")
    )
    return parse_sections(docs)


def elapsed_records(spark, d):
    """Records about a job's stages: the number of rows and the time span of each, for every stage."""
    spans = table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), (F.max(micros()) - F.min(micros())).alias("took"), F.max(micros()).alias("at")
    )
    rows = internal_telemetry(
        spans, CFG, F.concat(F.lit("/elapsed/"), F.col("event_type")), F.col("event_type"), F.lit(0),
        F.col("took").cast("double") / 1_000_000, F.col("at") * 1000,
    )
    return rows.select("topic", "content_type", "data_float", "event_ns", json_get(F.col("properties"), "name").alias("name"))


def prom_labels(spark, d):
    """Label values with quotes, backslashes and line feeds in them."""
    text = F.concat(
        F.lit('# HELP level a\\nb\nlevel{path="C:\\\\x'), F.col("event_id"), F.lit('",say="\\"hi\\"\\n"} 1\n')
    )
    rows = table(spark, d, "events").select(F.col("event_id").alias("scrape_id"), text.alias("text"), F.lit(7).cast("bigint").alias("scraped_ms"))
    return prometheus_samples(rows).select("scrape_id", "description", F.col("labels")["path"].alias("path"), F.col("labels")["say"].alias("say"))


def typed_rows(spark, d):
    rows = event_telemetry(spark, d).where(is_typed(F.col("content_type")))
    return rows.select("id", "content_type", *[c.alias(n) for n, c in typed_values(F.col("data"), F.col("content_type")).items()])


def route_branches(spark, d):
    rows = event_telemetry(spark, d)
    setups = {
        "plain": GatewayConfig(), "analysis": GatewayConfig(analysis=True), "both": GatewayConfig(analysis=True, logs_analysis=True),
        "scripted": GatewayConfig(analysis=True, logs_analysis=True, scripted=True), "none": GatewayConfig(discard=True),
    }
    counted = None
    for name, cfg in setups.items():
        part = route(rows, cfg).groupBy("branch").agg(F.count("*").alias("n")).withColumn("setup", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    return counted


def text_predicates(spark, d):
    t = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), t, F.lit(" "))).alias("trimmed"), F.lower("p_type").alias("lowered"),
        F.upper(t).alias("uppered"), t.startswith("red").alias("starts"), t.endswith("ring").alias("ends"),
        t.contains("ll").alias("has"), t.rlike("^[a-m]+ ").alias("fits"),
    )


def conversions(spark, d):
    signed = F.when(F.col("event_type") == "click", -F.col("value")).otherwise(F.col("value"))
    ns = micros() * 1000
    window = time_window(F.floor(micros() / 1_000_000), 300)
    return table(spark, d, "events").select(
        "event_id", float_to_int(signed).alias("cut"), int_to_float(F.col("user_id")).alias("widened"),
        F.round(fractional_seconds(ns) + 5e-7, 4).alias("seconds"), nanos_part(ns).alias("nanos"),
        epoch_nanos(F.floor(micros() / 1_000_000), nanos_part(ns)).alias("ns"), window["s"].alias("s"), window["e"].alias("e"),
    )


def metric_json(spark, d):
    key = F.concat(F.lit("/app/"), F.col("event_type"))
    record = metric_record(key, F.col("value").cast("string"), micros() * 1000, F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.lit("host"))
    written = table(spark, d, "events").select("event_id", metric_to_json(record).alias("json"))
    return metrics_from_json(written, "json").select(
        "event_id", "key", F.col("value").cast("double").alias("value"), "timestamp", "skey", "platform", "src",
        F.col("tags")["user"].alias("user"),
    )


QUERIES = {
    "ingest_envelope": (ingest_envelope, INGEST_SQL),
    "split_payload": (split_payload, f"SELECT id, destination, data_float, event_ns FROM ({INGEST_SQL})"),
    "json_path_get": (
        json_path_get, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events"
    ),
    "item_key_path": (
        item_key_paths,
        f"""SELECT p_partkey AS itemid, lower(p_type) || '["x' || p_size || '",,' ||
                   CASE WHEN p_size > 45 THEN p_brand ELSE replace(p_brand, '#', '/') END || ']' AS key_, {PATH_SQL} AS path FROM part""",
    ),
    "item_lookup": (
        item_lookup,
        """SELECT l_partkey AS itemid, l_orderkey, l_linenumber, l_quantity, lower(p_type) || '["x' || p_size || '",,' ||
                  CASE WHEN p_size > 45 THEN p_brand ELSE replace(p_brand, '#', '/') END || ']' AS key_
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "zabbix_history": (
        zabbix_history,
        f"""SELECT 'host' || l_suppkey AS origin, '{PREFIX}' || path AS destination, 0 AS content_type, l_quantity AS data_float,
                   (1700000000 + l_orderkey) * 1000000000 + l_linenumber AS event_ns, l_partkey AS itemid, 'name' || l_suppkey AS host_name
            FROM lineitem JOIN (SELECT p_partkey, {PATH_SQL} AS path FROM part) ON l_partkey = p_partkey WHERE path IS NOT NULL""",
    ),
    "prom_samples": (prom_samples, f"SELECT * EXCLUDE (user_id) FROM ({PROM_SQL})"),
    "prom_by_type": (prom_by_type, f"SELECT kind, metric, count(*) AS n, round(sum(value), 4) AS total FROM ({PROM_SQL}) GROUP BY ALL"),
    "prom_telemetry": (
        prom_telemetry,
        f"""SELECT '/{CFG.prometheus_prefix}/' || metric ||
                   CASE WHEN kind = 'counter' THEN '/kind=' || label_kind || '/user=' || user_id ELSE '' END AS destination,
                   0 AS content_type, value AS data_float, timestamp_ms * 1000000 AS event_ns FROM ({PROM_SQL})""",
    ),
    "syslog_parse": (syslog_parse, SYSLOG_SQL),
    "syslog_rejected": (
        syslog_rejected, "SELECT event_id, 'no priority ' || event_id AS line FROM events WHERE event_type = 'error'"
    ),
    "syslog_severity_counts": (
        syslog_severity_counts, f"SELECT hostname, severity, count(*) AS n FROM ({SYSLOG_SQL}) WHERE format <> 'rejected' GROUP BY ALL"
    ),
    "syslog_envelope": (
        syslog_envelope,
        f"""SELECT coalesce(hostname, '{CFG.source}') AS origin, '{CFG.syslog_destination}' AS destination, 2 AS content_type,
                   msg AS message, event_ns AS timestamp, 'log[{CFG.syslog_file}]' AS zabbix_item, facility AS syslog_facility,
                   severity AS syslog_severity, version AS syslog_version, coalesce(appname, 'unknown') AS syslog_appname,
                   coalesce(procid, 'unknown') AS syslog_procid FROM ({SYSLOG_SQL}) WHERE format <> 'rejected'""",
    ),
    "topic_subscribe": (
        topic_subscribe,
        f"SELECT event_id AS id, '{PREFIX}/click' AS topic, floor(value)::BIGINT AS data FROM events WHERE event_type = 'click'",
    ),
    "generate_telemetry": (
        generate_telemetry,
        f"""SELECT 'generated_telemetry' AS message_type, '{CFG.source}' AS origin,
                   '/{CFG.topic_root}/generated_metric/{CFG.platform}/' || item AS destination,
                   CASE item WHEN 'pi' THEN 3.14::DOUBLE ELSE event_id * 0.5::DOUBLE END AS data_float, epoch_us(ts) * 1000 AS event_ns
            FROM events, (VALUES ('pi'), ('wave')) m(item)""",
    ),
    "union_sources": (
        union_of_sources,
        f"""SELECT NULL AS via, '{PREFIX}/' || event_type AS topic, count(*) AS n, count(*) AS with_id FROM events GROUP BY event_type
            UNION ALL SELECT 'prom', '{PREFIX}/{CFG.prometheus_prefix}/' || metric, count(*), 0 FROM ({PROM_SQL}) GROUP BY metric""",
    ),
    "nb_training_set": (
        nb_training_set,
        "SELECT lang AS label, count(*) AS texts, sum(length(text))::BIGINT AS characters FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang",
    ),
    "topic_fanout": (
        topic_fanout_all,
        f"""WITH t AS (SELECT '{PREFIX}/' || event_type AS item FROM events), a AS (SELECT '{PREFIX}/aggregation' AS agg FROM events)
            SELECT mode, topic, count(*) AS n FROM (
                SELECT 'aggregate' AS mode, agg AS topic FROM a UNION ALL SELECT 'both', agg FROM a
                UNION ALL SELECT 'split', item FROM t UNION ALL SELECT 'both', item FROM t) GROUP BY ALL""",
    ),
    "filter_predicate": (
        filter_predicate,
        "SELECT event_id::VARCHAR AS id, value AS data_float FROM events WHERE event_type IN ('view', 'purchase') AND value > 20",
    ),
    "transform_record": (
        transform_records,
        """SELECT event_id::VARCHAR AS id, 'HOST ' || user_id AS origin,
                  CASE WHEN event_type IN ('view', 'purchase') THEN value * 2 END AS data_float, 'here' AS added FROM events""",
    ),
    "filter_errors": (
        filter_errors,
        """SELECT event_id, value, CASE WHEN value < 1 THEN 'ZeroDivisionError' END AS error FROM events
           WHERE value < 1 OR user_id % floor(value)::BIGINT = 0""",
    ),
    "transform_errors": (
        transform_errors,
        """SELECT event_id, CASE WHEN k > 98 THEN value ELSE value * k END AS value, CASE WHEN k > 98 THEN 'OverflowError' END AS error
           FROM (SELECT event_id, value, (props->>'k')::BIGINT AS k FROM events)""",
    ),
    "deep_merge": (
        deep_merge,
        "SELECT event_id::VARCHAR AS id, 'HOST ' || user_id AS x, event_id::VARCHAR AS y, 2 AS z, 1 AS n FROM events",
    ),
    "history_json": (
        history_json,
        """SELECT l_partkey AS itemid, 'h' || l_suppkey AS host, 'n' || l_suppkey AS host_name, 1700000000 + l_orderkey AS clock,
                  l_linenumber::BIGINT AS ns, 0 AS type, 'quantity' AS name, 'b' AS tag, l_linenumber % 3 = 0 AS is_float,
                  CASE l_linenumber % 3 WHEN 2 THEN l_returnflag ELSE l_quantity::BIGINT::VARCHAR END AS value FROM lineitem""",
    ),
    "alert_json": (
        alert_json,
        """SELECT epoch_us(ts) // 1000000 AS clock, (epoch_us(ts) % 1000000) * 1000 AS ns,
                  CASE WHEN event_id % 3 <> 0 THEN CASE event_type WHEN 'error' THEN 1 ELSE 0 END END::BIGINT AS state, event_id AS eventid,
                  event_type AS name, (user_id % 5)::INTEGER AS severity, 'n' || user_id AS host_name, 'g' AS group_name FROM events""",
    ),
    "training_sections": (
        training_sections,
        """SELECT lang AS label, unnest(['sample ' || doc_id, 'again ' || doc_id]) AS text FROM documents WHERE lang IS NOT NULL""",
    ),
    "elapsed_records": (
        elapsed_records,
        f"""SELECT '{PREFIX}/elapsed/' || event_type AS topic, 0 AS content_type, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0 AS data_float,
                   max(epoch_us(ts)) * 1000 AS event_ns, event_type AS name FROM events GROUP BY event_type""",
    ),
    "prom_labels": (
        prom_labels,
        r"""SELECT event_id AS scrape_id, 'a' || chr(10) || 'b' AS description, 'C:\x' || event_id AS path, '"hi"' || chr(10) AS say FROM events""".replace("\\\\", "\\"),
    ),
    "merge_enrichment": (
        merged_enrichment,
        """SELECT event_id::VARCHAR AS id, 'b' || c AS category, c AS rank, 1 AS extra, '1' AS x, event_id::VARCHAR AS y
           FROM (SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS c FROM events)""",
    ),
    "typed_rows": (
        typed_rows,
        """SELECT event_id::VARCHAR AS id, c AS content_type, CASE c WHEN 3 THEN floor(value)::BIGINT END AS data_int,
                  CASE c WHEN 0 THEN value END AS data_float,
                  CASE c WHEN 2 THEN 'failure of user ' || user_id || ' ' || props END AS data_str
           FROM (SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 10 ELSE 0 END AS c FROM events) WHERE c <> 10""",
    ),
    "route_branches": (
        route_branches,
        """SELECT setup, CASE setup WHEN 'plain' THEN 'out' WHEN 'analysis' THEN 'analysis' WHEN 'scripted' THEN 'filter' WHEN 'none' THEN 'none'
                  ELSE CASE event_type WHEN 'error' THEN 'logs_analysis' ELSE 'analysis' END END AS branch, count(*) AS n
           FROM events, (VALUES ('plain'), ('analysis'), ('both'), ('scripted'), ('none')) s(setup) GROUP BY ALL""",
    ),
    "text_predicates": (
        text_predicates,
        """SELECT p_partkey, p_name AS trimmed, lower(p_type) AS lowered, upper(p_name) AS uppered, starts_with(p_name, 'red') AS starts,
                  ends_with(p_name, 'ring') AS ends, contains(p_name, 'll') AS has, regexp_matches(p_name, '^[a-m]+ ') AS fits FROM part""",
    ),
    "conversions": (
        conversions,
        """SELECT event_id, trunc(CASE WHEN event_type = 'click' THEN -value ELSE value END)::BIGINT AS cut, user_id::DOUBLE AS widened,
                  round(epoch_us(ts) / 1e6 + 5e-7, 4) AS seconds, epoch_us(ts) % 1000000 * 1000 AS nanos, epoch_us(ts) * 1000 AS ns,
                  epoch_us(ts) // 1000000 - 150 AS s, epoch_us(ts) // 1000000 + 150 AS e FROM events""",
    ),
    "metric_json": (
        metric_json,
        """SELECT event_id, '/app/' || event_type AS key, value, (epoch_us(ts) * 1000)::DOUBLE AS timestamp, event_type AS skey,
                  'local' AS platform, 'host' AS src, user_id::VARCHAR AS "user" FROM events""",
    ),
}
