"""Streaming jobs: keyed state, file-driven runs and batch timings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulseframe.model import FORECAST_PERIOD, SERIES_LENGTH, GatewayConfig
from pulseframe.operators.anomaly import anomaly_marks
from pulseframe.operators.breakout import break_marks
from pulseframe.operators.frames import padded
from pulseframe.operators.markov import forecast_column
from pulseframe.operators.rolling import STATISTICS, _line_weights
from pulseframe.session import STATE_STORE_PROVIDER, scratch_path

ROLLING_OUTPUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("n_of_samples", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in STATISTICS[1:]],
    T.StructField("tsf_next", T.DoubleType()), T.StructField("statistical_oscillator", T.DoubleType()),
])
LAST_OUTPUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("last", T.StringType()), T.StructField("sample", T.ArrayType(T.StringType())),
])
ALERT_OUTPUT = T.StructType([
    T.StructField("problem", T.LongType()), T.StructField("at", T.LongType()), T.StructField("eventid", T.LongType()),
    T.StructField("state", T.StringType()), T.StructField("open_eventid", T.LongType()),
])
#: Buckets of keys; each has one state and is one call a micro-batch.
BUCKETS = 256


def _frame_statistics(frames: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each row of values, NaN where there is none."""
    parts = []
    for at in range(0, len(frames), 4096):
        w = frames[at:at + 4096]
        n = np.count_nonzero(~np.isnan(w), axis=1)
        mean, low = np.nansum(w, axis=1) / n, np.nanmin(w, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = np.where(n > 1, np.nansum((w - mean[:, None]) ** 2, axis=1) / (n - 1), np.nan)
            geometric = np.exp(np.nansum(np.log(w), axis=1) / n)
            harmonic = n / np.nansum(1 / w, axis=1)
        unusual = np.where(low == 0, 0.0, np.nan)
        parts.append(np.column_stack([
            n, np.sqrt(variance), low, np.nanmax(w, axis=1), mean, np.where(low > 0, geometric, unusual),
            np.where(low > 0, harmonic, unusual), np.sqrt(np.nansum(w * w, axis=1) / n), variance,
        ]))
    return dict(zip(STATISTICS, np.vstack(parts).T))


def _statistics_of(values: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """Statistics of the last 128 values at each position from ``first`` on."""
    ahead = np.concatenate([np.full(SERIES_LENGTH - 1, np.nan), values])
    return _frame_statistics(np.lib.stride_tricks.sliding_window_view(ahead, SERIES_LENGTH)[first:])


def _line_ahead_of(values: np.ndarray) -> np.ndarray:
    """Line forecast made at each position, NaN before there are enough values."""
    out = np.full(len(values), np.nan)
    if len(values) >= FORECAST_PERIOD:
        frames = np.lib.stride_tricks.sliding_window_view(values, FORECAST_PERIOD)
        out[FORECAST_PERIOD - 1:] = frames @ np.array(_line_weights(FORECAST_PERIOD)[::-1])
    return out


class _Keyed(StatefulProcessor):
    """One value of state per key; the rows of a micro-batch are taken in event order.

    The source's rate limit bounds a micro-batch and with it the rows sorted here.
    """

    STATE: T.StructType
    TTL_MS: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.STATE, self.TTL_MS)

    def close(self) -> None:
        pass

    def _rows(self, batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
        return pd.concat(list(batches)).sort_values(order, kind="stable")


class RollingState(_Keyed):
    """The last 128 values of a key, from which all statistics and forecasts follow."""

    STATE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))])

    def handleInputRows(self, key, rows, timerValues):
        held = np.array(self.state.get()[0] if self.state.exists() else [], dtype=float)
        taken = self._rows(rows, ["at", "event_id"])
        fresh = taken["value"].to_numpy(dtype=float)
        values, first = np.concatenate([held, fresh]), len(held)
        ahead = _line_ahead_of(values)
        before = np.concatenate([[np.nan], ahead[:-1]])[first:]
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.where(fresh == 0, np.nan, 100.0 * (fresh - before) / fresh)
        stats = _statistics_of(values, first)
        out = pd.DataFrame({
            "key": key[0], "event_id": taken["event_id"].to_numpy(), **stats,
            "tsf_next": np.where(np.isnan(ahead[first:]), fresh, ahead[first:]),
            "statistical_oscillator": np.where(np.isnan(before), fresh, error),
        })
        out["n_of_samples"] = out["n_of_samples"].astype("int64")
        self.state.update((values[-SERIES_LENGTH:].tolist(),))
        yield out[ROLLING_OUTPUT.names]


ANALYSIS = T.StructType([
    T.StructField("n_of_samples", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in STATISTICS[1:]],
    T.StructField("tsf_next", T.DoubleType()), T.StructField("statistical_oscillator", T.DoubleType()),
    *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("markov_chain_forecast", "anomalies", "breakouts")],
])


class BufferState(_Keyed):
    """Every record of a bucket of keys as it is, with the last 128 values of its key up to it.

    A call of Python and its state take milliseconds whatever they hold, so keys share them by their hash. The state has the
    keys, how many values of each are held, and these values one key after the other.
    """

    STATE = T.StructType([
        T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ])

    def __init__(self, key: str, value: str, order: list[str], columns: list[str]) -> None:
        self.key, self.value, self.order, self.columns = key, value, order, columns

    def handleInputRows(self, key, rows, timerValues):
        held = {}
        if self.state.exists():
            keys, lengths, values = self.state.get()
            held = dict(zip(keys, np.split(np.array(values, dtype=float), np.cumsum(lengths)[:-1])))
        taken = self._rows(rows, [self.key, *self.order])[self.columns]
        buffers = []
        for at, of_key in taken.groupby(self.key, sort=False, dropna=False)[self.value]:
            name = None if pd.isna(at) else at
            before = held.get(name, np.empty(0))
            values = np.concatenate([before, of_key.to_numpy(dtype=float)])
            held[name] = values[-SERIES_LENGTH:]
            buffers += [values[max(0, end - SERIES_LENGTH):end] for end in range(len(before) + 1, len(values) + 1)]
        self.state.update((list(held), [len(v) for v in held.values()], np.concatenate(list(held.values())).tolist()))
        for low in range(0, len(taken), HANDED):
            part = taken.iloc[low:low + HANDED]
            yield part.assign(**{BUFFER: buffers[low:low + HANDED]})


BUFFER = "__buffer"
#: Records that are handed on at once, with their buffers.
HANDED = 10_000


def _attributes(window: int, column):
    """The attributes of ``ANALYSIS`` but the Markov forecast, from arrays of at most 128 values, oldest first.

    The records of all keys in an Arrow batch are handled together.
    """
    fields = [f for f in ANALYSIS.fields if f.name != "markov_chain_forecast"]
    weights = np.array(_line_weights(FORECAST_PERIOD)[::-1])

    def line(frames: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Line forecast from the values before each end, NaN where there are too few."""
        places = ends[:, None] + np.arange(-FORECAST_PERIOD, 0)
        if frames.shape[1] < FORECAST_PERIOD:
            return np.full(len(frames), np.nan)
        met = np.take_along_axis(frames, np.maximum(places, 0), axis=1) @ weights
        return np.where(ends >= FORECAST_PERIOD, met, np.nan)

    @F.pandas_udf(T.StructType(fields))
    def attributes(buffers: pd.Series) -> pd.DataFrame:
        frames, lengths = padded(list(buffers))
        if not len(frames):
            return pd.DataFrame({f.name: [] for f in fields})
        newest = frames[np.arange(len(frames)), lengths - 1]
        ahead, before = line(frames, lengths), line(frames, lengths - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.where(newest == 0, np.nan, 100.0 * (newest - before) / newest)
        out = pd.DataFrame({
            **_frame_statistics(frames), "tsf_next": np.where(np.isnan(ahead), newest, ahead),
            "statistical_oscillator": np.where(np.isnan(before), newest, error),
        })
        out["n_of_samples"] = out["n_of_samples"].astype("int64")
        for name, marks in (("anomalies", anomaly_marks(frames, lengths, window)), ("breakouts", break_marks(frames, lengths, window))):
            out[name] = pd.Series([f[m] for f, m in zip(frames, marks)], dtype=object)
        return out[[f.name for f in fields]]

    return attributes(column)


class ValueState(_Keyed):
    """The last 128 values of a key, of any JSON type, as texts."""

    STATE = T.StructType([T.StructField("values", T.ArrayType(T.StringType()))])

    def handleInputRows(self, key, rows, timerValues):
        values = list(self.state.get()[0]) if self.state.exists() else []
        taken = self._rows(rows, ["at", "event_id"])
        values = [*values, *taken["value"].tolist()][-SERIES_LENGTH:]
        self.state.update((values,))
        newest = taken.iloc[-1]
        yield pd.DataFrame([[key[0], newest["at"], newest["event_id"], values[-1], values]], columns=LAST_OUTPUT.names)


class AlertState(_Keyed):
    """Which problems of a bucket are open, and since which event.

    A call of Python and its state take milliseconds whatever they hold, so problems share them by their hash. The rows of all
    problems of the bucket are handled at once: a problem is open exactly if the row before it is an opening.
    """

    STATE = T.StructType([T.StructField("problems", T.ArrayType(T.LongType())), T.StructField("eventids", T.ArrayType(T.LongType()))])

    def handleInputRows(self, key, rows, timerValues):
        opened = dict(zip(*self.state.get())) if self.state.exists() else {}
        taken = self._rows(rows, ["problem", "at", "eventid"]).reset_index(drop=True)
        eventid, is_open = taken["eventid"].astype("Int64"), (taken["value"] == 1).to_numpy()
        first = taken["problem"].ne(taken["problem"].shift()).to_numpy()
        before, was_open = eventid.shift(), np.concatenate([[False], is_open[:-1]])
        own = taken["problem"][first].tolist()
        was_open[first] = [p in opened for p in own]
        before[first] = pd.array([opened.pop(p, None) for p in own], dtype="Int64")
        out = taken.assign(state=np.where(is_open, "open", "closed"), open_eventid=eventid.where(is_open, before))
        last = is_open & np.concatenate([first[1:], [True]])
        opened.update(zip(taken["problem"][last].tolist(), eventid[last].astype(object).where(eventid[last].notna(), None)))
        if opened:
            self.state.update((list(opened), [e if e is None else int(e) for e in opened.values()]))
        else:
            self.state.clear()
        yield out.loc[is_open | was_open, ALERT_OUTPUT.names]


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, output: T.StructType) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE_PROVIDER)
    return df.groupBy(key).transformWithStateInPandas(processor, output, outputMode="Append", timeMode="None")


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def rolling_stream(df: DataFrame) -> DataFrame:
    """Statistics and forecasts of a stream (key, event_id, at, value)."""
    return _stateful(df.where("value is not null"), "key", RollingState(), ROLLING_OUTPUT)


def analyse_stream(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """A stream of telemetry with the attributes of ``ANALYSIS`` on its float records; others pass with none.

    ``df`` has topic, event_ns, id, data_float and further columns of plain types (a VARIANT cannot pass through Python:
    carry it as JSON text). The state has the last 128 values per topic; within a micro-batch, records count in event order.
    """
    floats = df.where(F.col("data_float").isNotNull()).withColumn("__bucket", _bucket("topic"))
    output = T.StructType([*df.schema.fields, T.StructField(BUFFER, T.ArrayType(T.DoubleType()))])
    held = _stateful(floats, "__bucket", BufferState("topic", "data_float", ["event_ns", "id"], df.columns), output)
    done = held.withColumn("__found", _attributes(cfg.anomalies_window, F.col(BUFFER))).select(
        *df.columns, *[
            (forecast_column(F.col(BUFFER)) if f.name == "markov_chain_forecast" else F.col("__found")[f.name]).alias(f.name)
            for f in ANALYSIS.fields
        ]
    )
    rest = df.where(F.col("data_float").isNull())
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ANALYSIS.fields]
    return done.unionByName(rest.select(*df.columns, *nothing))


def value_stream(df: DataFrame) -> DataFrame:
    """Last value and recent sample per key and micro-batch of a stream (key, event_id, at, value text)."""
    return _stateful(df, "key", ValueState(), LAST_OUTPUT)


def alert_stream(df: DataFrame) -> DataFrame:
    """Emitted openings and matched resolutions of a stream (problem, at, eventid, value)."""
    known = df.where("problem is not null and value in (0, 1)").withColumn("__bucket", _bucket("problem"))
    return _stateful(known, "__bucket", AlertState(), ALERT_OUTPUT)


def latest_state(updates: DataFrame) -> DataFrame:
    """Current answer per key from the updates of all micro-batches."""
    rest = F.struct("last", "sample")
    return updates.groupBy("key").agg(F.max_by(rest, F.struct("at", "event_id")).alias("s")).select("key", "s.*")


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, last, sample) straight from the state of a ``value_stream`` job, for catalog and sample queries."""
    rows = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    values = F.col("value.values")
    return rows.select(F.col("key.key").alias("key"), F.element_at(values, -1).alias("last"), values.alias("sample"))


def read_table_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as a stream. The files per micro-batch bound what the task of one key has to hold."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all input that is there now into Parquet, and read the result back."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_once(stream: DataFrame, label: str) -> DataFrame:
    base = scratch_path(stream.sparkSession, label)
    return run_to_table(stream, f"{base}/table", f"{base}/checkpoint")


def run_gateway_stream(
    stream: DataFrame, stages: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str,
    interval: str | None = None,
):
    """A continuous job: every micro-batch passes the stages and goes to one sink.

    The sink gets the number of the batch, which is the same when a batch is repeated after a failure: a sink that replaces
    what it wrote under that number, as ``batch_sink`` does, writes everything once. Without an interval the job handles
    what is there and stops. Within a batch all
    batch operators may be used; state across batches needs the keyed streams.
    """
    def handle(batch: DataFrame, number: int) -> None:
        # Stages may read their input several times; without this, each time would run the keyed state again.
        held = batch.persist()
        try:
            sink(stages(held), number)
        finally:
            held.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Parquet in one folder per batch (column ``batch`` on reading), which a repeated batch replaces."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


TIMING = "destination string, name string, batch bigint, elapsed double, records bigint"


class StageTimings(StreamingQueryListener):
    """Hands the duration of each micro-batch to ``emit``, as a row of ``TIMING``; nothing is kept here."""

    def __init__(self, emit: Callable[[tuple], None], destination: str = "/elapsed"):
        self.emit, self.destination = emit, destination

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.emit((self.destination, p.name or "", p.batchId, float(p.durationMs.get("triggerExecution", 0)) / 1000, p.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass



def observed(df: DataFrame, stage: str) -> tuple[DataFrame, object]:
    """The same rows, with their number and time span observed while they pass."""
    from pyspark.sql import Observation

    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("records"), F.min("event_ns").alias("from_ns"), F.max("event_ns").alias("to_ns")), seen
