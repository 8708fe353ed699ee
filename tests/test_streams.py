"""Streams that keep state: the watchdog's timers over restarts and late reports, and a chain drain that wakes by new rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import audit, refine
from recollect.streaming import jobs, watchdog

START = datetime(2024, 1, 1)
REPORT = "job_id long, at timestamp_ntz, seq long, status string"


def reports(n=240, seed=4):
    r = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += r.random() * 4
        rows.append((r.randrange(12), START + timedelta(minutes=round(at, 3)), i, r.choice(["running", "running", "completed", "failed"])))
    return rows


def plain_stale(rows, seconds, latest):
    """By sorting each job's reports."""
    out = []
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1], r[2]))
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            due = a[1] + timedelta(seconds=seconds)
            if a[3] == "running" and (b is None or b[1] > due) and latest > due:
                out.append((job, a[1], due))
    return sorted(out)


def stream(spark, folder):
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows, schema=REPORT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


def found(spark, sink):
    got = spark.read.option("basePath", sink).parquet(sink)
    return sorted((r.job_id, r.updated_at, r.failed_at) for r in got.select("job_id", F.col("updated_at").cast("timestamp_ntz"), F.col("failed_at").cast("timestamp_ntz")).collect())


@pytest.mark.parametrize("cuts", [(240,), (50, 90, 100)])
def test_watchdog_fails_each_stale_job_once_over_restarts(spark, tmp_path, cuts):
    rows, at = reports(), 0
    for run, n in enumerate(cuts):  # each run starts anew from the checkpoint
        part = rows[at : at + n]
        random.Random(run).shuffle(part)
        put(spark, str(tmp_path / "in"), part)
        at += n
        watchdog.watch(stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "out"), 600).awaitTermination()
    want = plain_stale(rows[:at], 600, max(r[1] for r in rows[:at]))
    assert found(spark, str(tmp_path / "out")) == want and len(want) > 5
    # a job's last report, found by the batch operator at the same clock, is among them
    last = spark.createDataFrame(rows[:at], REPORT).groupBy("job_id").agg(F.max_by(F.struct("at", "status"), F.struct("at", "seq")).alias("x"))
    now = F.lit(max(r[1] for r in rows[:at])).cast("timestamp_ntz")
    batch = refine.stale_jobs(last.select(F.col("job_id").alias("id"), F.col("x.at").alias("updated_at"), F.col("x.status").alias("status")), now, 600, 100)
    assert {(r.id, r.updated_at) for r in batch.collect()} == {(j, u) for j, u, _ in want if u == max(r[1] for r in rows[:at] if r[0] == j)}


def test_watchdog_hears_late_reports_within_the_delay(spark, tmp_path):
    minute = lambda m: START + timedelta(minutes=m)
    folder, state, sink = (str(tmp_path / x) for x in ("in", "state", "out"))
    put(spark, folder, [(1, minute(0), 1, "running"), (2, minute(0), 2, "running"), (3, minute(14), 3, "running")])
    watchdog.watch(stream(spark, folder), state, sink, 600, "5 minutes").awaitTermination()  # watermark 9: nothing is due
    put(spark, folder, [(1, minute(9.5), 4, "running"), (3, minute(30), 5, "completed")])  # 1 was heard of after all
    watchdog.watch(stream(spark, folder), state, sink, 600, "5 minutes").awaitTermination()
    put(spark, folder, [(9, minute(60), 6, "running")])
    watchdog.watch(stream(spark, folder), state, sink, 600, "5 minutes").awaitTermination()
    assert found(spark, sink) == [(1, minute(9.5), minute(19.5)), (2, minute(0), minute(10)), (3, minute(14), minute(24))]


def test_drain_wakes_by_new_rows(spark, tmp_path):
    schema = "id long, org_id long, operation string, created_at timestamp_ntz"
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, i % 3, "store", START + timedelta(seconds=i)) for i in range(40)]
    put(spark, folder, rows[:10], schema)
    drain = jobs.chain_stream(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "state"), sink, "200 milliseconds")
    try:
        for a, b in ((10, 25), (25, 40)):
            drain.processAllAvailable()
            put(spark, folder, rows[a:b], schema)
        drain.processAllAvailable()
    finally:
        drain.stop()
    chain = spark.read.option("basePath", sink).parquet(sink)
    whole = audit.hash_chain(spark.createDataFrame(rows, schema))
    assert {(r.id, bytes(r.row_hash)) for r in chain.collect()} == {(r.id, bytes(r.row_hash)) for r in whole.collect()}
    assert audit.verify(chain).isEmpty()
