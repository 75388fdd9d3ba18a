"""Live feeds of tasks and metrics as Structured Streaming queries. Each states its watermark; the same functions run on static
tables, where the watermark has no effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.streaming import state

DELAY = "2 hours"


def counters(events: DataFrame, ts: str, kind: str, window: str = "1 hour", delay: str = DELAY, ok: str = "completed", bad: str = "failed") -> DataFrame:
    """Counts of events in tumbling windows, and the success rate of what ended (100 if nothing did)."""
    done = F.count_if(F.col(kind).isin(ok, bad))
    rows = events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col(kind) == ok).alias("ok"), F.count_if(F.col(kind) == bad).alias("bad"), done.alias("done"))
    rate = F.when(F.col("done") > 0, 100.0 * F.col("ok") / F.greatest("done", F.lit(1))).otherwise(100.0)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "ok", "bad", rate.alias("success_rate"))


def snapshots(metrics: DataFrame, ts: str = "ts", name: str = "name", value: str = "value", window: str = "60 seconds", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Mean, least, greatest and count of each metric by window: tumbling, or sliding for a rolling report."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = metrics.withWatermark(ts, delay).groupBy(w.alias("w"), name).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), name, "avg", "min", "max", "n")


def latest_status(updates: DataFrame, task: str = "task_id", ts: str = "ts", delay: str = DELAY, status: str = "status", idle_hours: float = 24.0) -> DataFrame:
    """Last update of each task; repeated updates count once. On a stream, a task's latest update whenever there is one; its state
    goes when `status` (if there is such a column) says that it ended and the delay is over, or when nothing was heard of
    it for so many hours."""
    fields = [c for c in updates.columns if c not in (task, ts)]
    if not updates.isStreaming:
        return updates.groupBy(task).agg(F.max(F.struct(ts, *fields)).alias("last")).select(task, "last.*")
    got = state.tasks(updates, task, ts, status if status in fields else None, fields, delay, idle_hours)
    kind = StructType([f for f in updates.schema.fields if f.name in fields])
    back = F.from_json("payload", kind).alias("last")
    return got.select(F.col("key").alias(task), F.timestamp_micros("last").cast(updates.schema[ts].dataType).alias(ts), back).select(task, ts, *(F.col("last")[c].alias(c) for c in fields))


def life_cycle(updates: DataFrame, task: str = "task_id", status: str = "status", ts: str = "ts", delay: str = DELAY, idle_hours: float = 24.0) -> DataFrame:
    """Start, end and duration of each task, and how it ended; on a stream, whenever one of these changes, with state that goes as
    that of latest_status()."""
    if updates.isStreaming:
        got, time = state.tasks(updates, task, ts, status, [], delay, idle_hours), updates.schema[ts].dataType
        out = got.select(F.col("key").alias(task), F.timestamp_micros("started").cast(time).alias("started"), F.timestamp_micros("ended").cast(time).alias("ended"), "outcome")
    else:
        ended = F.col(status).isin(*state.ENDED)
        out = updates.groupBy(task).agg(F.min(ts).alias("started"), F.max(F.when(ended, F.col(ts))).alias("ended"), F.max_by(status, F.when(ended, F.col(ts))).alias("outcome"))
    return out.withColumn("seconds", F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"))


def followed(updates: DataFrame, delay: str = DELAY, timeout_hours: float = 24.0) -> DataFrame:
    """A stream of (task_id, ts, status): each task's latest status with the seconds since it started, whenever it changes; `lost`
    when nothing was heard of it for so many hours. State doesn't grow with the tasks that have been."""
    got = state.tasks(updates, "task_id", "ts", "status", [], delay, timeout_hours, lost=True)
    return got.select(F.col("key").alias("task_id"), "status", F.timestamp_micros("started").alias("started"), ((F.col("last") - F.col("started")) / 1e6).alias("seconds"))


def rules() -> list[tuple[str, str, Column]]:
    return [
        ("memory", "critical", F.col("memory_percent") > 90),
        ("temperature", "warning", F.col("temperature") > 80),
        ("hit_rate", "warning", F.col("hit_rate") < 30),
        ("success_rate", "critical", F.col("success_rate") < 70),
    ]


def alerts(metrics: DataFrame, found: list[tuple[str, str, Column]] | None = None) -> DataFrame:
    """A row for each rule that a snapshot breaks. Stateless, so it runs on streams in append mode."""
    listed = F.array(*(F.when(c, F.struct(F.lit(n).alias("alert"), F.lit(s).alias("severity"))) for n, s, c in (found or rules())))
    return metrics.withColumn("a", F.explode(F.array_compact(listed))).select(*metrics.columns, "a.alert", "a.severity")


def health(metrics: DataFrame) -> DataFrame:
    """Healthy by all of hit rate over 50, success over 80 and a healthy device; status is the worst of the alerts."""
    ok = (F.col("hit_rate") > 50) & (F.col("success_rate") > 80) & (F.col("memory_percent") <= 90)
    worst = F.greatest(*(F.when(c, 2 if s == "critical" else 1).otherwise(0) for _, s, c in rules()))
    return metrics.withColumns({"healthy": ok, "status": F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), (worst + 1).cast("int"))})


def moving_averages(values: DataFrame, alpha: float = 0.1, delay: str = DELAY, timeout_hours: float = 24.0) -> DataFrame:
    """Exponential moving average of each key of a stream (key, ts, value), kept as state; a batch is taken in the order of ts.
    A key not heard of for so many hours is forgotten, and starts anew."""
    return state.averages(values, alpha, delay, timeout_hours)
