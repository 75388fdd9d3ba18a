"""State of streams: what comes out, and that state ends."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.streaming import state, tasks

T0 = datetime(2024, 1, 1)
SCHEMA = "task_id string, ts timestamp, status string, value double"


def run(spark, make, batches, name, tmp_path, schema=SCHEMA):
    """Feeds batches one by one; gives the rows of all and, of each batch, how many rows of state there are after it."""
    source, held = str(tmp_path / name), []
    spark.createDataFrame([], schema).write.parquet(f"file://{source}", mode="append")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = make(spark.readStream.schema(schema).parquet(f"file://{source}")).writeStream.outputMode("update").format("memory").queryName(name).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}", mode="append")
            q.processAllAvailable()
            held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name).collect(), held


def day(i, *rows):
    return [(k, T0 + timedelta(days=i, minutes=m), s, v) for k, m, s, v in rows]


def test_tasks_end(spark, tmp_path):
    """Each day five tasks begin and end; a later day's watermark clears them. One is never ended: it is lost after a day."""
    batches = [day(d, *((f"t{d}{i}", m, s, float(m)) for i in range(5) for m, s in ((0, "running"), (i + 1, "completed")))) for d in range(2)]
    batches[0] += day(0, ("stuck", 0, "running", 0.0), ("stuck", 5, "running", None), ("stuck", 5, "running", None))
    batches += [day(9, ("end", 0, "failed", 1.0)), day(20, ("end2", 0, "running", 1.0))]
    want = {f"t{d}{i}": 60.0 * (i + 1) for d in range(2) for i in range(5)}
    rows, held = run(spark, tasks.life_cycle, batches, "cycles", tmp_path)
    assert {r.task_id: r.seconds for r in rows if r.seconds} == want and {r.outcome for r in rows} == {"completed", "failed", None}
    assert held[0] >= 6 and held[-1] <= 3  # only the newest task and its timer are held
    rows, held = run(spark, tasks.followed, batches, "follow", tmp_path)
    assert {r.task_id for r in rows if r.status == "lost"} == {"stuck"} and {r.task_id: r.seconds for r in rows if r.status == "completed"} == want


def test_latest(spark, tmp_path):
    batches = [day(0, ("a", 0, "running", 1.0), ("a", 5, "running", None), ("b", 0, "running", 0.5)), day(0, ("a", 5, "running", None), ("b", 3, "failed", 3.0)), day(3, ("z", 0, "running", 1.0))]
    rows, held = run(spark, tasks.latest_status, batches, "latest", tmp_path)
    last = {r.task_id: (r.ts, r.status, r.value) for r in rows}
    assert last["a"] == (T0 + timedelta(minutes=5), "running", None) and last["b"] == (T0 + timedelta(minutes=3), "failed", 3.0)
    assert sum(r.task_id == "a" for r in rows) == 1 and held[-1] <= 3  # a repeated update gives nothing


def test_late_updates(spark, tmp_path):
    """An update that comes after the end, but is older, does not begin the task anew."""
    batches = [day(0, ("a", 10, "completed", 1.0)), day(0, ("a", 0, "running", 2.0)), day(0, ("a", 10, "completed", 1.0))]
    rows, held = run(spark, tasks.life_cycle, batches, "late", tmp_path)
    assert [(r.outcome, r.seconds) for r in rows] == [("completed", 0.0), ("completed", 600.0)] and held[-1] > 0


def test_averages(spark, tmp_path):
    values = [float(x * x % 17) for x in range(20)]
    batches = [day(0, *(("k", i, "x", v) for i, v in enumerate(values[:7]))), day(0, *(("k", 7 + i, "x", v) for i, v in reversed(list(enumerate(values[7:]))))), day(5, ("other", 0, "x", 1.0)), day(6, ("other", 0, "x", 1.0), ("k", 1, "x", 3.0))]
    rows, held = run(spark, lambda s: tasks.moving_averages(s.withColumnRenamed("task_id", "key")), batches, "averages2", tmp_path)
    value = values[0]
    for x in values[1:]:
        value = 0.1 * x + 0.9 * value
    mine = [r for r in rows if r.key == "k"]
    assert mine[1].ema == pytest.approx(value) and mine[1].n == 20
    assert (mine[-1].ema, mine[-1].n) == (3.0, 1)  # forgotten meanwhile


def test_last_items(spark, tmp_path):
    batches = [day(0, *(("k", i, "x", float(i)) for i in range(5))), day(0, ("k", -1, "x", -1.0), ("j", 0, "x", None)), day(0, ("k", 9, "x", 9.0), ("k", 8, "x", 8.0)), day(9, ("z", 0, "x", 1.0))]
    rows, held = run(spark, lambda s: state.last_items(s.select(F.col("task_id").alias("key"), "ts", "value"), 4), batches, "items", tmp_path)
    got = [(r["values"], r.n) for r in rows if r.key == "k"]
    assert got == [([1.0, 2.0, 3.0, 4.0], 4), ([1.0, 2.0, 3.0, 4.0], 4), ([3.0, 4.0, 8.0, 9.0], 4)]
    assert held[-1] <= 3  # of z alone
