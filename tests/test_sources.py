"""Envelopes, item keys, history, Prometheus text, syslog lines, training sets and alert events."""

import json

import pytest
from pyspark.sql import functions as F

from pulseframe.functions.paths import item_key_path, topic_fanout
from pulseframe.model import GatewayConfig, envelope_json, internal_telemetry
from pulseframe.sources.alert_events import parse_alert_events
from pulseframe.sources.envelope import monitor, parse_envelopes, read_lines, split_payloads, subscribe, union_sources
from pulseframe.sources.generator import generate
from pulseframe.sources.history import RefreshedTable, history_to_telemetry
from pulseframe.sources.prometheus import prometheus_samples, prometheus_to_telemetry, read_scrapes
from pulseframe.sources.syslog import FACILITIES, parse_syslog, rejected, severity_counts, syslog_to_telemetry
from pulseframe.sources.training import parse_sections, training_files
from pulseframe.streaming.jobs import run_to_table

CFG = GatewayConfig()


def envelope(data, destination="/system.cpu.util/steal"):
    return (
        '{"headers":{"messageType":"telemetry","route":"local","streamName":"local","version":"v2"},"body":{"details":'
        f'{{"destination":"{destination}","origin":"server","details":{{"contentType":0,"data":{data},"detailType":""}},'
        '"properties":{"zabbix_clock":1717181406,"zabbix_ns":423164304}}},"id":"x1"}'
    )


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("token,number", [
    ("0", None), ("0.0", 0.0), ("1.50", 1.5), ("1e3", 1000.0), ('"1.5"', None), ("18446744073709551615", None), ("null", None),
    ("-7", None), ("18446744073709551616", 18446744073709551616.0), ("123456789012345678901234567890", 123456789012345678901234567890.0),
    ("true", None), ("-9223372036854775808", None),
])
def test_only_float_tokens_are_analysed(spark, token, number):
    row = parse_envelopes(texts(spark, envelope(token)), CFG).first()
    assert row.data_float == number and row.topic == "telemetry/metric/v2/local/system.cpu.util/steal"
    assert row.event_ns == 1717181406423164304 and row.content_type == 0


def test_broken_envelopes_are_dropped(spark):
    assert parse_envelopes(texts(spark, "[1]", "nonsense", "{}", '{"body":1}', envelope("1.5")), CFG).count() == 1


def test_payload_of_several_values(spark):
    df = spark.createDataFrame([(1, '{"a":1} {"a":2}{"a":3}\n'), (2, '{"a":4} oops {"a":5}'), (3, "")], "payload_id bigint, value string")
    rows = split_payloads(df).orderBy("payload_id", "seq").collect()
    assert [(r.payload_id, r.seq, json.loads(r.value)["a"]) for r in rows] == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 4)]


def test_envelope_survives_a_round_trip(spark):
    rows = parse_envelopes(texts(spark, envelope("1.5")), CFG)
    again = parse_envelopes(rows.select(envelope_json(rows).alias("value")), CFG)
    keys = [c for c in rows.columns if c not in ("properties", "data")]
    assert rows.select(keys).first() == again.select(keys).first()


def test_full_topic_is_not_prefixed_again(spark):
    rows = parse_envelopes(texts(spark, envelope("1.5", CFG.topic_prefix + "/cpu"), envelope("2.5", "/cpu")), CFG)
    assert {r.topic for r in rows.collect()} == {CFG.topic_prefix + "/cpu"}
    assert subscribe(rows, CFG, "cpu").count() == 2 and subscribe(rows, CFG).count() == 0


@pytest.mark.parametrize("key,path", [
    ("agent.ping", "/agent.ping"), ("system.cpu.util[,steal]", "/system.cpu.util/steal"),
    ('net.if.in["enp0s3",dropped]', "/net.if.in/enp0s3/dropped"), ("vfs.fs.size[/,used]", "/vfs.fs.size/\\/used"),
    ("proc.num[,,run]", "/proc.num/run"), ("log[{$X}]", None), ('"quoted.key"', "/quoted.key"), ("a[b] {junk}", "/a/b"),
    ("a" * 5000 + "{", None),
])
def test_item_key_paths(spark, key, path):
    assert spark.createDataFrame([(key,)], "k string").select(item_key_path(F.col("k")).alias("p")).first().p == path


@pytest.mark.parametrize("mode,rows", [("aggregate", 1), ("split", 1), ("both", 2)])
def test_fanout(spark, mode, rows):
    df = spark.createDataFrame([("/a",)], "destination string")
    assert topic_fanout(df, CFG, mode).count() == rows
    assert topic_fanout(df, GatewayConfig(aggregate=True)).first().topic == CFG.aggregate_topic


def test_history(spark):
    raw = spark.createDataFrame(
        [(1, ("h", "n"), 10, 5, 0, "cpu", None, "2.5", True), (2, ("h", "n"), 10, 5, 0, "cpu", None, "3", False), (3, ("h", "n"), 1, 1, 0, "x", None, "1", False)],
        "itemid bigint, host struct<host:string,name:string>, clock bigint, ns bigint, type int, name string, tags array<struct<tag:string,value:string>>, v string, is_float boolean",
    ).withColumn("value", F.parse_json("v"))
    items = spark.createDataFrame([(1, "system.cpu.util[,steal]"), (2, "log[{$X}]")], "itemid bigint, key_ string")
    rows = history_to_telemetry(raw, items, CFG).collect()
    assert len(rows) == 1 and rows[0].destination == "telemetry/metric/v2/local/system.cpu.util/steal"
    assert rows[0].event_ns == 10_000_000_005 and rows[0].data_float == 2.5 and rows[0].origin == "h"


def test_dimension_is_read_again():
    seen = []
    fresh = RefreshedTable(lambda: seen.append(1) or len(seen), 0)
    kept = RefreshedTable(lambda: seen.append(1) or len(seen), 60)
    assert (fresh(), fresh()) == (1, 2) and kept() == kept() == 3


EXPOSITION = """# HELP http_requests_total Total requests
# TYPE http_requests_total counter
http_requests_total{code="200",path="a b"} 1027 1395066363000
temp_c 21.5
# TYPE lat histogram
lat_bucket{le="0.5"} 3
lat_sum 9
lat_count 3
# TYPE odd gauge
odd{a="1",a="2"} +Inf
nan_value NaN
broken
"""


def test_prometheus(spark):
    df = spark.createDataFrame([(1, EXPOSITION, 5)], "scrape_id bigint, text string, scraped_ms bigint")
    rows = {r.metric: r for r in prometheus_samples(df).collect()}
    assert sorted(rows) == ["http_requests_total", "nan_value", "odd", "temp_c"]
    hits = rows["http_requests_total"]
    assert (hits.kind, hits.value, hits.timestamp_ms, hits.description) == ("counter", 1027.0, 1395066363000, "Total requests")
    assert hits.labels == {"code": "200", "path": "a b"} and rows["odd"].labels == {"a": "2"}
    assert rows["temp_c"].description == "N/A" and rows["temp_c"].timestamp_ms == 5
    sent = {r.destination: r for r in prometheus_to_telemetry(prometheus_samples(df), CFG).collect()}
    assert sent["/telemetry/prometheus_metric/v2/local/odd"].content_type == 10
    assert sent["/telemetry/prometheus_metric/v2/local/temp_c"].data_float == 21.5


def test_scrapes_landed_as_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(EXPOSITION)
    (tmp_path / "in" / "b.txt").write_text("temp_c 3\n")
    read = prometheus_samples(read_scrapes(spark, str(tmp_path / "in")))
    assert sorted(r.value for r in read.where("metric = 'temp_c'").collect()) == [3.0, 21.5]
    assert read.where("timestamp_ms > 1600000000000").count() > 0
    stream = prometheus_to_telemetry(prometheus_samples(read_scrapes(spark, str(tmp_path / "in"), streaming=True)), CFG)
    done = run_to_table(stream.select("topic", "data_float"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert done.count() == read.count()


def test_monitor_tails_one_topic(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([envelope("1.5", "/cpu"), envelope("2.5", "/mem")]))
    query = monitor(parse_envelopes(read_lines(spark, str(tmp_path), streaming=True), CFG), CFG, "cpu", "memory")
    query.processAllAvailable()
    query.stop()
    assert [r.topic for r in spark.table("monitor").collect()] == [CFG.topic_prefix + "/cpu"]


LINES = [
    "<34>1 2024-01-02T03:04:05Z host1 app 123 ID47 - hello world",
    "<34>1 2024-01-02T03:04:05+01:00 - - - - - x",
    "<13>Jan  2 03:04:05 host2 su: failed",
    "<999999>1 2024-01-02T03:04:05Z a b c d - x",
    "no priority",
    '<34>1 2024-01-02T03:04:05Z h a 1 m [id@1 k="v"] with data',
    "       100 [Time 5] [TimeNanoSec 7] [Host h3] [Level 3] [Facility mail] [Message out of disk]",
    "       100 [Time 5] [Host h4]",
    "<34>1 yesterday h a 1 m - x",
    "<34>2 2024-01-02T03:04:05Z h a 1 m - x",
]


def test_syslog(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, line string")
    parsed = parse_syslog(df, 2024)
    r = {x.n: x for x in parsed.collect()}
    a = r[0]
    assert (a.facility, a.severity, a.version, a.hostname, a.appname, a.procid, a.msgid, a.msg) == (4, 2, 1, "host1", "app", "123", "ID47", "hello world")
    assert a.event_ns == 1704164645 * 10**9
    assert (r[1].hostname, r[1].msgid, r[1].msg, r[1].event_ns) == (None, None, "x", 1704161045 * 10**9)
    b = r[2]
    assert (b.facility, b.severity, b.version, b.hostname, b.msg) == (1, 5, 0, "host2", "su: failed")
    assert b.event_ns == 1704164645 * 10**9
    assert r[5].msg == " with data"
    c = r[6]
    assert (c.facility, c.severity, c.hostname, c.msg, c.event_ns) == (2, 3, "h3", "out of disk", 5_000_000_007)
    assert (r[7].facility, r[7].severity) == (1, 7)
    assert {n for n, x in r.items() if x.format == "rejected"} == {3, 4, 8, 9} and rejected(parsed).count() == 4
    assert {tuple(x) for x in severity_counts(parsed).collect()} >= {("host1", 2, 1), ("h4", 7, 1)}
    sent = {x.id: x for x in syslog_to_telemetry(parsed, CFG).collect()}
    assert sent["ID47"].origin == "host1" and sent["ID47"].content_type == 2 and len(sent) == 6
    assert FACILITIES["local7"] == 23


def test_training_sections(spark, tmp_path):
    text = "{\n  linux: [\n    Jun 14 combo sshd[1]: failure; x=[1]\n    another line\n  ]\n  ssh: [\n    Dec 10 sshd\n  ]\n  other: 5\n}\n"
    want = {("linux", "Jun 14 combo sshd[1]: failure; x=[1]"), ("linux", "another line"), ("ssh", "Dec 10 sshd")}
    assert {tuple(r) for r in parse_sections(texts(spark, text)).collect()} == want
    (tmp_path / "set.hjson").write_text(text)
    assert {tuple(r) for r in training_files(spark, str(tmp_path)).collect()} == want


def test_alert_events(spark):
    rows = parse_alert_events(texts(
        spark, '{"clock":1,"ns":2,"value":1,"eventid":51,"name":"SLA","severity":4,"hosts":[{"host":"h","name":"n"}],"groups":["g"],"tags":[{"tag":"a","value":"b"}]}',
        '{"value":"1","eventid":1}', '{"value":1.0,"eventid":2}', "oops",
    )).collect()
    assert len(rows) == 3 and (rows[0].value, rows[0].eventid, rows[0].hosts[0].host, rows[0].groups) == (1, 51, "h", ["g"])
    assert rows[1].value is None and rows[2].value is None


def test_generator_over_ticks(spark):
    rows = generate(spark.range(3), CFG, {"pi": F.lit(3.14), "n": F.col("id")}, "id", F.col("id") * 1000)
    assert rows.count() == 6 and rows.select("id").distinct().count() == 6


def test_union_and_internal_records(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert union_sources(a, b).columns == ["x", "y"]
    timing = internal_telemetry(spark.range(1), CFG, F.lit("/elapsed"), F.lit("batch"), F.lit(3), F.lit(0.5), F.lit(1_500_000_000))
    assert timing.first().data_float == 0.5 and timing.first().topic.endswith("/elapsed")
