"""Series, catalog, forecast and suppression queries over ``events``, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions.fields import error_band
from pulseframe.operators import alerts, anomaly, breakout, dedup, joins, markov, rolling, snapshot
from pulseframe.plans.tables import ORDER, SERIES, micros, table

FRAME = "PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW"
ROUNDED = {
    "std_dev": 6, "minimum": 6, "maximum": 6, "mean": 9, "geometric_mean": 6, "harmonic_mean": 6,
    "quadratic_mean": 6, "variance": 5,
}


# Added before rounding on both sides: keeps exact halves, which engines round differently, off the edge.
OFF_EDGE = {"variance": 1.2345e-8, "statistical_oscillator": 1.2345e-8}


def _round(name: str, digits: int):
    return F.round(F.col(name) + OFF_EDGE[name] if name in OFF_EDGE else F.col(name), digits).alias(name)


def _rounded():
    return [F.col("n_of_samples").cast("bigint").alias("n_of_samples"), *[_round(c, d) for c, d in ROUNDED.items()]]


def _statistics_sql(over: str) -> str:
    """The statistics of ``value`` over a frame, or of a group where ``over`` is empty."""
    return f"""
        count(value) {over} AS n_of_samples,
        round(stddev_samp(value) {over}, 6) AS std_dev,
        round(min(value) {over}, 6) AS minimum, round(max(value) {over}, 6) AS maximum,
        round(avg(value) {over}, 9) AS mean,
        round(CASE WHEN min(value) {over} > 0 THEN exp(avg(CASE WHEN value > 0 THEN ln(value) END) {over})
                   WHEN min(value) {over} = 0 THEN 0.0 END, 6) AS geometric_mean,
        round(CASE WHEN min(value) {over} > 0 THEN 1 / avg(CASE WHEN value > 0 THEN 1 / value END) {over}
                   WHEN min(value) {over} = 0 THEN 0.0 END, 6) AS harmonic_mean,
        round(sqrt(avg(value * value) {over}), 6) AS quadratic_mean,
        round(var_samp(value) {over} + 1.2345e-8, 5) AS variance"""


ROLLING_SQL = f"SELECT event_id, event_type, {_statistics_sql(f'OVER ({FRAME})')} FROM events"
NEWEST = """(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)"""
LINE = " + ".join(f"{1 / 8 + 4.5 * (i - 4.5) / 42!r} * lag(value, {8 - i}) OVER s" for i in range(1, 9))
FORECAST_SQL = f"""
    SELECT event_id, event_type, value, CASE WHEN row_number() OVER s < 8 THEN value ELSE {LINE} END AS tsf,
           row_number() OVER s AS rn
    FROM events WINDOW s AS (PARTITION BY event_type ORDER BY ts, event_id)"""


def rolling_stats(spark, d):
    return rolling.rolling_stats(table(spark, d, "events"), SERIES, ORDER, "value").select("event_id", "event_type", *_rounded())


def rolling_stats_split(spark, d):
    """Every series is treated as too long for one task."""
    done = rolling.rolling_stats(table(spark, d, "events"), SERIES, ORDER, "value", hot_rows=100, block_rows=4096)
    return done.select("event_id", "event_type", *_rounded())


def rolling_stats_per_user(spark, d):
    done = rolling.rolling_stats(table(spark, d, "events"), ["event_type", "user_id"], ORDER, "value")
    return done.select("event_id", "event_type", *_rounded())


def enrich_events(spark, d):
    done = rolling.enrich_series(table(spark, d, "events"), SERIES, ORDER, "value")
    return done.select(
        "event_id", "event_type", *_rounded(), F.round("tsf_next", 5).alias("tsf_next"),
        _round("statistical_oscillator", 4),
    )


def series_snapshot(spark, d):
    return snapshot.series_snapshot(table(spark, d, "events"), SERIES, ORDER, "value").select("event_type", *_rounded())


def sma(spark, d):
    done = rolling.moving_average(table(spark, d, "events"), SERIES, ORDER, "value", 10)
    return done.select("event_id", "event_type", F.round("sma", 9).alias("sma"))


def tsf_forecast(spark, d):
    done = rolling.forecast(table(spark, d, "events"), SERIES, ORDER, "value")
    return done.select("event_id", "event_type", F.round("tsf_next", 5).alias("tsf_next"))


def forecast_oscillator(spark, d):
    done = rolling.forecast(table(spark, d, "events"), SERIES, ORDER, "value")
    return done.select("event_id", "event_type", _round("statistical_oscillator", 4))


def series_consistency(spark, d):
    done = rolling.consistency(table(spark, d, "events"), ["event_type", "user_id"], ORDER, "value", limit=20.0)
    return done.select("event_id", F.round("std_dev", 6).alias("std_dev"), "consistent")


def metric_catalog(spark, d):
    events = table(spark, d, "events").select(F.concat(F.lit("/"), "event_type", F.lit("/"), "user_id").alias("topic"))
    return snapshot.metric_catalog(events)


def metric_last(spark, d):
    return snapshot.last_value(table(spark, d, "events"), SERIES, ORDER, "props")


def metric_sample(spark, d):
    recent = snapshot.recent_sample(table(spark, d, "events"), SERIES, ORDER, "value")
    return recent.select("event_type", F.posexplode("sample").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


def sampler_arrays(spark, d):
    arrays = snapshot.sampler_arrays(table(spark, d, "events"), SERIES, ORDER, "value")
    return arrays.select("event_type", "len", F.posexplode("values").alias("pos", "v")).select(
        "event_type", F.col("len").cast("bigint").alias("len"), F.col("pos").cast("bigint").alias("pos"),
        micros("v.timestamp").alias("at"), F.col("v.value").alias("value"),
    )


def series_time_span(spark, d):
    return snapshot.observed_span(table(spark, d, "events"), ["event_type", "user_id"], ORDER, micros() / 1_000_000)


def dedup_timestamp(spark, d):
    minutes = table(spark, d, "events").withColumn("minute", F.floor(micros() / 3_600_000_000))
    return dedup.unique_timestamps(minutes, SERIES, "minute", ["ts", "event_id"]).select("event_type", "minute", "event_id", "value")


def dedup_tolerance(spark, d):
    kept = dedup.tolerance_dedup(table(spark, d, "events"), ["event_type", "user_id"], ORDER, "value", 0.4)
    return kept.select("event_id", "event_type", "user_id", "value")


def dedup_tolerance_split(spark, d):
    """The same over long series cut into blocks; the last 128 kept values count."""
    kept = dedup.tolerance_dedup(
        table(spark, d, "events").select(*SERIES, *ORDER, "value"), SERIES, ORDER, "value", 0.4, hot_rows=100, block_rows=4096
    )
    return kept.select("event_id", "event_type", "value")


def dedup_similarity(spark, d):
    kept = dedup.similarity_dedup(table(spark, d, "events"), ["event_type", "user_id"], ORDER, "props", 2)
    return kept.select("event_id", "event_type", "user_id", "props")


def dedup_similarity_split(spark, d):
    """Long series of texts cut into blocks: values that are two edits from all of the last 128 kept ones."""
    rows = table(spark, d, "events").select(*SERIES, *ORDER, F.concat("props", F.lit(" "), F.col("value").cast("int").cast("string")).alias("props"))
    kept = dedup.similarity_dedup(rows, SERIES, ORDER, "props", 2, hot_rows=100, block_rows=4096)
    return kept.select("event_id", "event_type", "props")


def _fold_sql(series: str, columns: str, refuse: str) -> str:
    """A sequential rule as a recursion over the position within each series."""
    keys = series.split(", ")
    same = " AND ".join(f"n.{k} = f.{k}" for k in keys)
    return f"""
    WITH RECURSIVE n AS (
        SELECT *, row_number() OVER (PARTITION BY {series} ORDER BY ts, event_id) AS pos FROM events
    ), f AS (
        SELECT pos, {series}, event_id, value, props, true AS kept, [value] AS held, [props] AS texts FROM n WHERE pos = 1
        UNION ALL
        SELECT n.pos, {", ".join(f"n.{k}" for k in keys)}, n.event_id, n.value, n.props, NOT ({refuse}),
               CASE WHEN {refuse} THEN f.held ELSE list_slice(list_append(f.held, n.value), -128, -1) END,
               CASE WHEN {refuse} THEN f.texts ELSE list_slice(list_append(f.texts, n.props), -128, -1) END
        FROM f JOIN n ON {same} AND n.pos = f.pos + 1
    )
    SELECT {columns} FROM f WHERE kept"""


IN_BAND = "len(list_filter(f.held, lambda h: n.value BETWEEN h - h * 0.4 / 2 AND h + h * 0.4 / 2)) > 0"
SIMILAR = "len(list_filter(f.texts, lambda h: levenshtein(n.props, h) < 2)) > 0"


def markov_transitions(spark, d):
    counted = markov.transitions(table(spark, d, "events"), SERIES, ORDER, "value", states=2, step=25.0)
    return counted.select(
        "event_type", F.col("state")[0].alias("s1"), F.col("state")[1].alias("s2"), "next", "n"
    )


def markov_forecast(spark, d):
    found = markov.markov_forecast(table(spark, d, "events"), SERIES, ORDER, "value")
    steps = found.select("event_type", F.posexplode("forecast").alias("step", "value"))
    return steps.withColumn("step", F.col("step").cast("bigint"))


def markov_generated(spark, d):
    """Four ways on from the newest values of each series, eight steps each."""
    return markov.generated(table(spark, d, "events"), SERIES, ORDER, "value", states=2, paths=4, seed=7, step=25.0)


def anomalies(spark, d):
    found = anomaly.anomalies(table(spark, d, "events"), SERIES, ORDER, "value")
    return found.select("event_type", F.posexplode_outer("anomalies").alias("pos", "value"))


def _planted(spark, d, value):
    """Series of 128 consecutive events each, with values of a known shape and a small jitter."""
    events = table(spark, d, "events")
    jitter = (F.col("event_id") * 37 % 11) / 100
    rows = events.select(
        F.floor(F.col("event_id") / 128).alias("series"), (F.col("event_id") % 128).alias("p"), "event_id", jitter.alias("jitter")
    )
    whole = events.agg(F.floor((F.max("event_id") + 1) / 128).alias("n"))
    return rows.where(F.col("series") < whole.scalar()).withColumn("value", value + F.col("jitter"))


def anomalies_planted(spark, d):
    """A weekly season with one spike in each series: the spike is found and nothing else."""
    spike = F.when(F.col("p") == 40 + F.col("series") % 20, 50.0).otherwise(0.0)
    found = anomaly.anomalies(_planted(spark, d, F.col("p") % 7 * 10.0 + spike), ["series"], ["event_id"], "value")
    return found.select("series", F.explode("anomalies").alias("value")).withColumn("value", F.round("value", 6))


def anomalies_drifting(spark, d):
    """A season whose shape changes from cycle to cycle, with one value out of place: it is found and nothing else."""
    p = F.col("p")
    rising, falling = F.when(p % 7 == 3, 10 + p * 0.5).otherwise(0.0), F.when(p % 7 == 5, 80 - p * 0.5).otherwise(0.0)
    odd = F.when(p == 59, 40.0).otherwise(0.0)
    found = anomaly.anomalies(_planted(spark, d, rising + falling + odd), ["series"], ["event_id"], "value", span=7)
    return found.select("series", F.explode("anomalies").alias("value")).withColumn("value", F.round("value", 6))


def breakouts_multiple(spark, d):
    """Three changes of level in each series: the first value of each new level is found and nothing else."""
    p = F.col("p")
    level = F.when(p >= 96, 15.0).when(p >= 64, 5.0 - F.col("series") % 2).when(p >= 32, 10.0 + F.col("series") % 3).otherwise(0.0)
    found = breakout.breakouts(_planted(spark, d, level), ["series"], ["event_id"], "value")
    return found.select("series", F.explode("breakouts").alias("value")).withColumn("value", F.round("value", 6))


def breakouts_planted(spark, d):
    """One change of level in the middle of each series: the first value of the new level is found and nothing else."""
    level = F.when(F.col("p") >= 64, 10.0 + F.col("series") % 3).otherwise(0.0)
    found = breakout.breakouts(_planted(spark, d, level), ["series"], ["event_id"], "value")
    return found.select("series", F.explode("breakouts").alias("value")).withColumn("value", F.round("value", 6))


def anomalies_mad(spark, d):
    found = anomaly.anomalies_mad(table(spark, d, "events"), SERIES, ORDER, "value")
    return found.select("event_type", "value", F.round("score", 5).alias("score"))


def breakouts(spark, d):
    found = breakout.breakouts(table(spark, d, "events"), SERIES, ORDER, "value")
    return found.select("event_type", F.posexplode_outer("breakouts").alias("pos", "value"))


def around_window(spark, d):
    events = table(spark, d, "events").withColumn("at", micros())
    anchors = events.where("event_type = 'error'").select("user_id", "event_id", "at")
    found = joins.around_window(anchors, events, ["user_id"], "event_id", "at", "value", 12 * 3_600_000_000)
    return found.select("user_id", "event_id", "events", F.round("total", 4).alias("total"))


def interval_agg(spark, d):
    band = error_band(F.col("value"), 0.1)
    found = joins.interval_aggregates(table(spark, d, "events"), ["event_type", "user_id"], band["lo"], band["hi"])
    numbers = [c for c in found.columns if c not in ("event_type", "user_id", "n")]
    return found.select("event_type", "user_id", "n", *[F.round(c, 5).alias(c) for c in numbers])


def alert_events(spark, d):
    """Errors open the problem of their user and event hour; the signups of a user resolve it."""
    kind = F.col("event_type")
    return table(spark, d, "events").where(kind.isin("error", "signup")).select(
        F.floor(micros() / 1_000_000).alias("clock"), (F.pmod(micros(), F.lit(1_000_000)) * 1000).alias("ns"),
        F.when(kind == "error", 1).otherwise(0).cast("bigint").alias("value"),
        F.when(kind == "error", F.col("user_id")).otherwise(F.col("event_id")).alias("eventid"),
        F.when(kind == "signup", F.col("user_id")).alias("p_eventid"), "event_id",
    )


ALERT_ORDER = ["clock", "ns", "event_id"]
ALERT_BASE = """
    WITH h AS (
        SELECT user_id AS problem, event_id, event_type,
               lag(event_type) OVER p AS before_type, lag(event_id) OVER p AS before_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type IN ('error', 'signup') WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)
    )"""


def alert_pairs(spark, d):
    return alerts.alert_pairs(alert_events(spark, d), ALERT_ORDER).select("problem", "event_id", "state", "open_event_id")


def alert_pairs_split(spark, d):
    """Every problem is treated as too long for one task."""
    pairs = alerts.alert_pairs(alert_events(spark, d), ALERT_ORDER, hot_rows=5, block_rows=2048)
    return pairs.select("problem", "event_id", "state", "open_event_id")


def alerts_open(spark, d):
    return alerts.alerts_open(alert_events(spark, d), ALERT_ORDER).select("problem", "event_id")


def alerts_orphan(spark, d):
    return alerts.alerts_orphan(alert_events(spark, d), ALERT_ORDER).select("problem", "event_id")


ALERT_PAIRS_SQL = ALERT_BASE + """
    SELECT problem, event_id, CASE WHEN event_type = 'error' THEN 'open' ELSE 'closed' END AS state,
           CASE WHEN event_type = 'error' THEN event_id ELSE before_id END AS open_event_id
    FROM h WHERE event_type = 'error' OR before_type = 'error'"""

QUERIES = {
    "rolling_stats": (rolling_stats, ROLLING_SQL),
    "rolling_stats_split": (rolling_stats_split, ROLLING_SQL),
    "rolling_stats_per_user": (
        rolling_stats_per_user,
        f"""SELECT event_id, event_type, {_statistics_sql(f'OVER ({FRAME.replace("event_type", "event_type, user_id", 1)})')}
            FROM events""",
    ),
    "enrich_events": (
        enrich_events,
        f"""WITH f AS ({FORECAST_SQL})
        SELECT r.*, round(f.tsf, 5) AS tsf_next,
               round(CASE WHEN rn <= 8 THEN value ELSE 100 * (value - before) / nullif(value, 0) END + 1.2345e-8, 4) AS statistical_oscillator
        FROM ({ROLLING_SQL}) r JOIN (
            SELECT *, lag(tsf) OVER (PARTITION BY event_type ORDER BY rn) AS before FROM f) f USING (event_id)""",
    ),
    "series_snapshot": (
        series_snapshot, f"SELECT event_type, {_statistics_sql('')} FROM {NEWEST} WHERE rn <= 128 GROUP BY event_type"
    ),
    "sma": (
        sma,
        """SELECT event_id, event_type, round(CASE WHEN count(value) OVER w = 10 THEN avg(value) OVER w END, 9) AS sma
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ),
    "tsf_forecast": (tsf_forecast, f"SELECT event_id, event_type, round(tsf, 5) AS tsf_next FROM ({FORECAST_SQL})"),
    "forecast_oscillator": (
        forecast_oscillator,
        f"""SELECT event_id, event_type, round(CASE WHEN rn <= 8 THEN value
                   ELSE 100 * (value - before) / nullif(value, 0) END + 1.2345e-8, 4) AS statistical_oscillator
            FROM (SELECT *, lag(tsf) OVER (PARTITION BY event_type ORDER BY rn) AS before FROM ({FORECAST_SQL}))""",
    ),
    "series_consistency": (
        series_consistency,
        f"""SELECT event_id, round(s, 6) AS std_dev, coalesce(s <= 20.0, false) AS consistent FROM (
            SELECT event_id, stddev_samp(value) OVER ({FRAME.replace("event_type", "event_type, user_id", 1)}) AS s FROM events)""",
    ),
    "metric_catalog": (metric_catalog, "SELECT DISTINCT '/' || event_type || '/' || user_id AS topic FROM events ORDER BY 1"),
    "metric_last": (metric_last, f'SELECT event_type, props AS "last" FROM {NEWEST} WHERE rn = 1'),
    "metric_sample": (
        metric_sample,
        f"""SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) - 1 AS pos, value
            FROM {NEWEST} WHERE rn <= 128""",
    ),
    "sampler_arrays": (
        sampler_arrays,
        f"""SELECT event_type, count(*) OVER (PARTITION BY event_type) AS len,
                   row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) - 1 AS pos, epoch_us(ts) AS at, value
            FROM {NEWEST} WHERE rn <= 128""",
    ),
    "series_time_span": (
        series_time_span,
        """SELECT event_type, user_id, n AS samples, CASE WHEN ok THEN lo END AS s, CASE WHEN ok THEN hi END AS e,
                  CASE WHEN ok THEN hi - lo END AS elapsed
           FROM (SELECT *, n > 2 AND lo <> hi AS ok FROM (
               SELECT event_type, user_id, count(*) AS n, min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi
               FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
               WHERE rn <= 128 GROUP BY ALL))""",
    ),
    "dedup_timestamp": (
        dedup_timestamp,
        """SELECT event_type, minute, event_id, value FROM (
               SELECT *, epoch_us(ts) // 3600000000 AS minute,
                      row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS rn
               FROM events) WHERE rn = 1""",
    ),
    "dedup_tolerance": (dedup_tolerance, _fold_sql("event_type, user_id", "event_id, event_type, user_id, value", IN_BAND)),
    "dedup_tolerance_split": (dedup_tolerance_split, _fold_sql("event_type", "event_id, event_type, value", IN_BAND)),
    "dedup_similarity_split": (
        dedup_similarity_split,
        _fold_sql("event_type", "event_id, event_type, props", SIMILAR).replace(
            "FROM events\n", "FROM (SELECT * REPLACE (props || ' ' || trunc(value)::BIGINT AS props) FROM events)\n", 1),
    ),
    "dedup_similarity": (dedup_similarity, _fold_sql("event_type, user_id", "event_id, event_type, user_id, props", SIMILAR)),
    "markov_transitions": (
        markov_transitions,
        """SELECT event_type, s1, s2, "next", count(*) AS n FROM (
               SELECT event_type, lag(q, 2) OVER s AS s1, lag(q, 1) OVER s AS s2, q AS "next" FROM (
                   SELECT *, floor(value / 25.0) * 25.0 AS q FROM events)
               WINDOW s AS (PARTITION BY event_type ORDER BY ts, event_id))
           WHERE s1 IS NOT NULL GROUP BY ALL""",
    ),
    "markov_generated": (
        markov_generated,
        """WITH RECURSIVE r AS (
               SELECT event_type, lag(q, 2) OVER s AS s1, lag(q) OVER s AS s2, q,
                      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
               FROM (SELECT *, floor(value / 25.0) * 25.0 AS q FROM events)
               WINDOW s AS (PARTITION BY event_type ORDER BY ts, event_id)),
           c AS (
               SELECT *, sum(n) OVER (PARTITION BY event_type, s1, s2 ORDER BY q) AS upto, sum(n) OVER (PARTITION BY event_type, s1, s2) AS total
               FROM (SELECT event_type, s1, s2, q, count(*) AS n FROM r WHERE s1 IS NOT NULL GROUP BY ALL)),
           p AS (
               SELECT event_type, path, 0 AS step, s2 AS s1, q AS s2 FROM r, range(4) t(path) WHERE rn = 1
               UNION ALL
               SELECT p.event_type, path, step + 1, p.s2, c.q FROM p JOIN c USING (event_type, s1, s2)
               WHERE step < 8 AND ('0x' || left(md5(concat_ws('|', 7, p.event_type, path, step + 1)), 8))::BIGINT % total >= upto - n
                 AND ('0x' || left(md5(concat_ws('|', 7, p.event_type, path, step + 1)), 8))::BIGINT % total < upto)
           SELECT event_type, path, step::BIGINT AS step, s2 AS value FROM p WHERE step > 0""",
    ),
    # From its start, a chain of order 8 can only repeat the first 8 values: each of its states was seen once.
    "markov_forecast": (
        markov_forecast,
        f"""SELECT event_type, step, value FROM (
                SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) - 1 AS step, value
                FROM {NEWEST} WHERE rn <= 128) WHERE step < 8""",
    ),
    "anomalies": (anomalies, None),
    "anomalies_planted": (
        anomalies_planted,
        """SELECT series, round(p % 7 * 10.0 + 50.0 + event_id * 37 % 11 / 100, 6)::DOUBLE AS value FROM (
               SELECT event_id // 128 AS series, event_id % 128 AS p, event_id FROM events)
           WHERE p = 40 + series % 20 AND series < (SELECT (max(event_id) + 1) // 128 FROM events)""",
    ),
    "anomalies_drifting": (
        anomalies_drifting,
        """SELECT series, round(10.0 + p * 0.5 + 40.0 + event_id * 37 % 11 / 100, 6)::DOUBLE AS value FROM (
               SELECT event_id // 128 AS series, event_id % 128 AS p, event_id FROM events)
           WHERE p = 59 AND series < (SELECT (max(event_id) + 1) // 128 FROM events)""",
    ),
    "breakouts_multiple": (
        breakouts_multiple,
        """SELECT series, round(CASE p WHEN 32 THEN 10.0 + series % 3 WHEN 64 THEN 5.0 - series % 2 ELSE 15.0 END
                                + event_id * 37 % 11 / 100, 6)::DOUBLE AS value FROM (
               SELECT event_id // 128 AS series, event_id % 128 AS p, event_id FROM events)
           WHERE p IN (32, 64, 96) AND series < (SELECT (max(event_id) + 1) // 128 FROM events)""",
    ),
    "breakouts_planted": (
        breakouts_planted,
        """SELECT series, round(10.0 + series % 3 + event_id * 37 % 11 / 100, 6)::DOUBLE AS value FROM (
               SELECT event_id // 128 AS series, event_id % 128 AS p, event_id FROM events)
           WHERE p = 64 AND series < (SELECT (max(event_id) + 1) // 128 FROM events)""",
    ),
    "anomalies_mad": (
        anomalies_mad,
        f"""WITH r AS (SELECT event_type, value FROM {NEWEST} WHERE rn <= 128),
            m AS (SELECT event_type, median(value) AS m FROM r GROUP BY event_type),
            s AS (SELECT event_type, median(abs(value - m)) AS d FROM r JOIN m USING (event_type) GROUP BY event_type)
            SELECT event_type, value, round(abs(value - m) / (d * 1.4826), 5) AS score
            FROM r JOIN m USING (event_type) JOIN s USING (event_type) WHERE abs(value - m) / (d * 1.4826) > 3.5""",
    ),
    "breakouts": (breakouts, None),
    "around_window": (
        around_window,
        """SELECT a.user_id, a.event_id, count(*) AS events, round(sum(e.value), 4) AS total
           FROM events a JOIN events e ON a.user_id = e.user_id
            AND abs(epoch_us(e.ts) - epoch_us(a.ts)) <= 21600000000
           WHERE a.event_type = 'error' GROUP BY a.user_id, a.event_id""",
    ),
    "interval_agg": (
        interval_agg,
        """SELECT event_type, user_id, count(*) AS n, round(min(lo), 5) AS hull_lo, round(max(hi), 5) AS hull_hi,
                  round(CASE WHEN max(lo) <= min(hi) THEN max(lo) END, 5) AS common_lo,
                  round(CASE WHEN max(lo) <= min(hi) THEN min(hi) END, 5) AS common_hi,
                  round(sum(lo), 5) AS sum_lo, round(sum(hi), 5) AS sum_hi,
                  round(max(hi) - min(lo), 5) AS width, round((min(lo) + max(hi)) / 2, 5) AS midpoint
           FROM (SELECT *, value - value * 0.1 / 2 AS lo, value + value * 0.1 / 2 AS hi FROM events) GROUP BY ALL""",
    ),
    "alert_pairs": (alert_pairs, ALERT_PAIRS_SQL),
    "alert_pairs_split": (alert_pairs_split, ALERT_PAIRS_SQL),
    "alerts_open": (alerts_open, ALERT_BASE + "SELECT problem, event_id FROM h WHERE rn = 1 AND event_type = 'error'"),
    "alerts_orphan": (
        alerts_orphan,
        ALERT_BASE + "SELECT problem, event_id FROM h WHERE event_type = 'signup' AND before_type IS DISTINCT FROM 'error'",
    ),
}
