"""State of streams that ends: values, lists and timers of transformWithState.

Every key has a due time, by event time: some delay after its task ended, or so many hours after anything was heard of it. The timer
of that time clears its state, so what a stream keeps follows the keys that are alive, not those that have been. Rows of a key
are taken a batch at a time, without a loop over rows. Times are microseconds inside, whatever the session's time zone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("completed", "failed", "cancelled")
HOUR = 3_600_000


class _Timed(StatefulProcessor):
    """Keeps one value a key, and one timer."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.state + ", due long")

    def read(self) -> list:
        return list(self.value.get()) if self.value.exists() else []

    def write(self, row: Sequence, due: int, timers) -> None:
        """A new value, and the timer moved to `due` (milliseconds, past the watermark)."""
        due = max(int(due), timers.getCurrentWatermarkInMs() + 1)
        before = self.read()
        if before and before[-1] != due:
            self.handle.deleteTimer(before[-1])
        if not before or before[-1] != due:
            self.handle.registerTimer(due)
        self.value.update((*row, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.read()
        if row and row[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
            yield from self.over(key, row)

    def over(self, key, row) -> Iterator[pd.DataFrame]:
        """What a key gives out when its time is over."""
        return iter(())

    def close(self) -> None:
        pass


class Task(_Timed):
    """The latest update of a task, when it began and how it ended."""

    state = "started long, last long, ended long, status string, outcome string, payload string"

    def __init__(self, delay_ms: int, idle_ms: int, lost: bool):
        self.delay, self.idle, self.lost = delay_ms, idle_ms, lost

    def row(self, key, values) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *values)], columns=["key", "started", "last", "ended", "status", "outcome", "payload"]).astype({"ended": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "payload"], kind="stable", na_position="first")
        before = self.read()[:-1]
        started, last, ended, status, outcome, payload = before or (None, None, None, None, None, None)
        us = pdf["us"].to_numpy()
        started = int(us[0]) if started is None else min(started, int(us[0]))
        new = pdf.iloc[-1]
        if last is None or (int(new["us"]), new["payload"] or "") > (last, payload or ""):
            last, status, payload = int(new["us"]), new["status"], new["payload"]
        over = pdf[pdf["status"].isin(ENDED)]
        if len(over) and (ended is None or int(over["us"].iloc[-1]) >= ended):
            ended, outcome = int(over["us"].iloc[-1]), over["status"].iloc[-1]
        after = [started, last, ended, status, outcome, payload]
        # an ended task waits for updates that come late, and then goes
        self.write(after, last // 1000 + (self.delay if ended is not None else self.idle), timerValues)
        if after != before:  # repeated updates change nothing
            yield self.row(key, after)

    def over(self, key, row) -> Iterator[pd.DataFrame]:
        if self.lost and row[2] is None:
            yield self.row(key, [*row[:3], "lost", *row[4:-1]])


class Average(_Timed):
    """Exponential moving average; a batch is a weighted sum of its values and the average before."""

    state = "ema double, n long"

    def __init__(self, alpha: float, idle_ms: int):
        self.alpha, self.idle = alpha, idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("us", kind="stable")
        x, before = pdf["value"].to_numpy(np.float64), self.read()
        keep = (1 - self.alpha) ** np.arange(len(x) - 1, -1, -1.0)
        weights = self.alpha * keep
        if before:
            ema, n = before[0] * (1 - self.alpha) ** len(x) + float(weights @ x), before[1] + len(x)
        else:
            weights[0] = keep[0]  # the first value stands for all before it
            ema, n = float(weights @ x), len(x)
        self.write((ema, n), int(pdf["us"].iloc[-1]) // 1000 + self.idle, timerValues)
        yield pd.DataFrame({"key": [key[0]], "ema": [ema], "n": [n]})


class Last(_Timed):
    """The last items of a key by their time, as a list."""

    state = "n long"

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getListState("items", "us long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame(list(self.items.get()) if self.items.exists() else [], columns=["us", "value"])
        pdf = pd.concat([x[["us", "value"]] for x in (before, *rows) if len(x)]).sort_values("us", kind="stable").tail(self.size)
        us, values = pdf["us"].astype("int64").tolist(), pdf["value"].astype("float64").tolist()
        self.items.put(list(zip(us, values, strict=True)))
        self.write((len(us),), us[-1] // 1000 + self.idle, timerValues)
        yield pd.DataFrame({"key": [key[0]], "n": [len(us)], "oldest": [us[0]], "newest": [us[-1]], "values": [values]})

    def over(self, key, row) -> Iterator[pd.DataFrame]:
        self.items.clear()
        return iter(())


def _ms(delay: str) -> int:
    return int(pd.Timedelta(delay).total_seconds() * 1000)


def _run(rows: DataFrame, processor: StatefulProcessor, out: StructType) -> DataFrame:
    """State with timers needs the RocksDB store, which the session is told to use."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.groupBy("key").transformWithStateInPandas(processor, out, "Update", "EventTime")


def tasks(updates: DataFrame, task: str, ts: str, status: str | None, fields: Sequence[str], delay: str, idle_hours: float, lost: bool = False) -> DataFrame:
    """A stream of a row for each task whenever what is known of it changes: key, started, last, ended (microseconds), status, outcome,
    payload (`fields` as JSON). Updates of one time: the last by payload."""
    state = F.col(status).cast("string") if status else F.lit(None).cast("string")
    payload = F.to_json(F.struct(*fields)) if fields else F.lit("")
    rows = updates.select(F.col(task).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), state.alias("status"), payload.alias("payload"))
    out = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("started long, last long, ended long, status string, outcome string, payload string").fields])
    return _run(rows.withWatermark("ts", delay), Task(_ms(delay), int(idle_hours * HOUR), lost), out)


def averages(values: DataFrame, alpha: float, delay: str, idle_hours: float) -> DataFrame:
    """key, ema, n of a stream (key, ts, value), whenever a key has new values. Values that aren't there are left out."""
    rows = values.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value")).where("value is not null")
    out = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("ema double, n long").fields])
    return _run(rows.withWatermark("ts", delay), Average(alpha, int(idle_hours * HOUR)), out)


def last_items(values: DataFrame, size: int = 1440, delay: str = "2 hours", idle_hours: float = 24.0) -> DataFrame:
    """The last `size` values of each key of a stream (key, ts, value) by ts, whenever it has new ones: key, n, oldest, newest,
    values (oldest first). A key not heard of for so many hours is forgotten. Values that aren't there are left out."""
    rows = values.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value")).where("value is not null and us is not null")
    out = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("n long, oldest long, newest long, values array<double>").fields])
    got = _run(rows.withWatermark("ts", delay), Last(size, int(idle_hours * HOUR)), out)
    return got.select("key", "n", F.timestamp_micros("oldest").alias("oldest"), F.timestamp_micros("newest").alias("newest"), "values")
