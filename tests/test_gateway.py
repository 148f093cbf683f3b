"""Sinks, whole gateway runs and streams over several micro-batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.model import GatewayConfig, stable_id, telemetry
from pulseframe.operators import bayes, rolling
from pulseframe.plans.gateway import gateway
from pulseframe.sinks import shapes
from pulseframe.streaming import jobs

CFG = GatewayConfig()


def records(spark, rows):
    """(id, destination, content type, JSON data, float or None, ns)"""
    df = spark.createDataFrame(rows, "rid string, d string, c int, j string, f double, ns bigint")
    props = F.to_variant_object(F.struct(F.lit("my host").alias("zabbix_host_name"), F.lit("item[a]").alias("zabbix_item")))
    return telemetry(df, CFG, id=F.col("rid"), destination=F.col("d"), content_type=F.col("c"), data=F.parse_json("j"),
                     data_float=F.col("f"), origin=F.lit("server"), properties=props, event_ns=F.col("ns"))


ROWS = [
    ("1", "/a b", 0, "1.5", 1.5, 10**9), ("2", "/a b", 0, "2.5", 2.5, 2 * 10**9), ("3", "/n", 3, "7", None, 10**9),
    ("4", "/t", 2, '"say \\"hi\\""', None, 10**9), ("5", "/o", 10, "null", None, 10**9), ("6", "/x", 0, "3.5", 3.5, None),
]


def test_influx_lines(spark):
    lines = sorted(r.value for r in shapes.influx_lines(records(spark, ROWS), CFG).collect())
    tags = ",platform=local,source=localhost,zabbix_host=my\\ host zabbix_type="
    assert f"telemetry/metric/v2/local/a\\ b{tags}0i,data=1.5 1000000000" in lines
    assert f"telemetry/metric/v2/local/n{tags}3i,data=7i 1000000000" in lines
    assert f'telemetry/metric/v2/local/t{tags}2i,data="say \\"hi\\"" 1000000000' in lines
    assert f"telemetry/metric/v2/local/o{tags}10i 1000000000" in lines and len(lines) == 5


def test_gauges_take_the_latest(spark):
    lines = {r.value for r in shapes.statsd_gauges(records(spark, ROWS), CFG).collect()}
    assert "local.telemetry/metric/v2/local/a b:2.5|g" in lines and len(lines) == 2


def test_table_rows(spark):
    rows = {(r.key.rsplit("/", 1)[1], r.data_float): r for r in shapes.table_rows(records(spark, ROWS), CFG).collect()}
    assert len(rows) == 4 and rows["n", 0.0].data_int == 7 and rows["t", 0.0].data_str == 'say "hi"'
    assert rows["a b", 1.5].data_str == "" and rows["a b", 1.5].zabbix_item == "item[a]"
    counts = shapes.dropped_counts(records(spark, ROWS)).first()
    assert tuple(counts) == (6, 1, 1)


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_sender_payloads(spark, batch):
    sent = [json.loads(r.value) for r in shapes.sender_payloads(records(spark, ROWS), batch).collect()]
    entries = [e for p in sent for e in p["data"]]
    assert len(entries) == 6 and all(p["request"] == "sender data" and len(p["data"]) <= batch for p in sent)
    assert {"host": "server", "key": "item[a]", "value": 1.5} in entries


def test_json_lines_pretty(spark):
    pretty = shapes.json_lines(records(spark, ROWS[:1]), pretty=True).first().value
    assert "\n" in pretty and json.loads(pretty)["body"]["details"]["details"]["data"] == 1.5


def test_balance_keeps_each_record_once(spark):
    sent = shapes.multi_topic(records(spark, [(str(i), "/a", 0, "1.5", 1.5, i) for i in range(60)]), ["a", "b"], "balance")
    assert sent.count() == 60 and sent.select("topic").distinct().count() == 2


def test_gateway_with_analysis_and_logs(spark):
    model = bayes.train(spark.createDataFrame([("chat", "say hi"), ("disk", "no space left")], "label string, text string"))
    done = {r.id: r for r in gateway(records(spark, ROWS), GatewayConfig(analysis=True, logs_analysis=True), model=model).collect()}
    assert len(done) == 6 and done["4"].analytical_data.category == "chat"
    assert done["2"].analytical_data["mean"] == 2.0 and done["2"].analytical_data.category is None
    assert done["3"].analytical_data is None


def test_gateway_scripted_and_discarding(spark):
    rows = records(spark, ROWS)
    done = gateway(rows, GatewayConfig(scripted=True, analysis=True), "data_float > 2", lambda d: d.withColumn("data_float", F.col("data_float") * 10))
    assert {r.analytical_data["maximum"] for r in done.collect()} == {25.0, 35.0}
    assert gateway(rows, GatewayConfig(discard=True)).count() == 0
    with pytest.raises(ValueError):
        gateway(rows, GatewayConfig(logs_analysis=True))


def test_ids_are_stable(spark):
    df = spark.range(5).select(stable_id(F.lit("a"), F.col("id")).alias("i"))
    assert df.collect() == df.collect() and df.distinct().count() == 5


@pytest.fixture
def landed(spark, tmp_path):
    """Events of three keys, one with most rows, landed as eight files in event order."""
    dice = random.Random(3)
    rows = [("hot" if i % 5 else f"k{i % 2}", i, i // 2, dice.choice([0.0, dice.uniform(-1, 9), dice.uniform(1, 9)])) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, event_id bigint, at bigint, value double")
    for n in range(8):
        df.where(F.col("event_id").between(n * 100, n * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def test_rolling_stream_equals_batch(spark, landed):
    df, folder = landed
    stream = jobs.read_table_stream(spark, folder, "*.parquet", df.schema, files_per_batch=1)
    got = {r.event_id: r for r in jobs.run_once(jobs.rolling_stream(stream), "t").collect()}
    want = rolling.enrich_series(df, ["key"], ["at", "event_id"], "value").collect()
    assert len(got) == 800
    for w in want:
        for c in [*rolling.STATISTICS, "tsf_next", "statistical_oscillator"]:
            assert (w[c] is None) == (got[w.event_id][c] is None), c
            assert w[c] is None or got[w.event_id][c] == pytest.approx(w[c], rel=1e-6, abs=1e-6)


def test_value_stream_keeps_the_last_128(spark, landed):
    df, folder = landed
    stream = jobs.read_table_stream(spark, folder, "*.parquet", df.schema, files_per_batch=3)
    keyed = stream.select("key", "event_id", "at", F.col("event_id").cast("string").alias("value"))
    rows = {r.key: r for r in jobs.latest_state(jobs.run_once(jobs.value_stream(keyed), "t")).collect()}
    assert rows["hot"].last == "799" and len(rows["hot"].sample) == 128 and rows["hot"].sample[-2] == "798"


def test_state_of_a_value_stream_can_be_queried(spark, landed, tmp_path):
    df, folder = landed
    stream = jobs.read_table_stream(spark, folder, "*.parquet", df.schema, files_per_batch=3)
    keyed = stream.select("key", "event_id", "at", F.col("event_id").cast("string").alias("value"))
    jobs.run_to_table(jobs.value_stream(keyed), str(tmp_path / "out"), str(tmp_path / "check"))
    rows = {r.key: r for r in jobs.current_state(spark, str(tmp_path / "check")).collect()}
    assert rows["hot"].last == "799" and len(rows["hot"].sample) == 128 and len(rows) == 3


def test_gateway_stream_with_timings(spark, landed, tmp_path):
    df, folder = landed
    rows = []
    timings = jobs.StageTimings(rows.append, "/elapsed")
    spark.streams.addListener(timings)
    stream = jobs.read_table_stream(spark, folder, "*.parquet", df.schema, files_per_batch=4)
    out = str(tmp_path / "out")
    query = jobs.run_gateway_stream(
        stream, lambda b: b.where("key = 'hot'"), jobs.batch_sink(out), str(tmp_path / "c")
    )
    query.awaitTermination()
    assert spark.read.parquet(out).count() == df.where("key = 'hot'").count()
    import time

    for _ in range(50):
        if sum(r[4] for r in rows) >= 800:
            break
        time.sleep(0.2)
    spark.streams.removeListener(timings)
    assert spark.createDataFrame(rows, jobs.TIMING).agg(F.sum("records")).first()[0] == 800


def test_repeated_batch_is_written_once(spark, tmp_path):
    sink, out = jobs.batch_sink(str(tmp_path / "out")), str(tmp_path / "out")
    for number in (0, 1, 1):
        sink(spark.range(10), number)
    assert spark.read.parquet(out).count() == 20


def test_observed_counts(spark):
    seen, facts = jobs.observed(records(spark, ROWS), "in")
    seen.write.format("noop").mode("overwrite").save()
    assert facts.get["records"] == 6
