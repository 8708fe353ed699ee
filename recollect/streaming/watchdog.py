"""A watchdog over a stream of job reports: a running job that isn't heard of for too long fails once, at its timeout.

State is keyed by job: the last reports that a later one doesn't cover, each with an event-time timer. A timer that fires
with nothing heard since means that the job went stale. Answers depend on event times alone, not on how reports are cut
into micro-batches or on restarts: reports may come late by the watermark's delay, and timers fire behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import _sink

#: The statuses that a timeout can end.
RUNNING = ("running",)
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watchdog(StatefulProcessor):
    """Reports (job_id, at, seq, status) to (job_id, updated_at, failed_at, error); seq orders reports of one time."""

    def __init__(self, seconds: int):
        self.wait, self.error = seconds * 1_000_000, f"watchdog: stale running >{seconds}s; row never transitioned"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long, seq long", "status string")

    def _due(self, at: int) -> int:
        """Milliseconds, rounded up, at which a report of a time in microseconds goes stale."""
        return -(-(at + self.wait) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = dict(self.open.iterator())
        reports = dict(held)
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            reports.update(((int(a), int(s)), (status,)) for a, s, status in zip(at, frame["seq"], frame["status"], strict=True))
        # a report is covered by the next one, if that comes within the wait
        order = sorted(reports)
        left = {k for k, after in zip(order, [*order[1:], None], strict=True) if after is None or after[0] - k[0] > self.wait}
        for k in held.keys() - left:
            self.open.removeKey(k)
        for k in left - held.keys():
            self.open.updateValue(k, reports[k])
        due, was = {self._due(at) for at, _ in left}, {self._due(at) for at, _ in held}
        for t in was - due:
            self.handle.deleteTimer(t)
        for t in due - was:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (at, seq), (status,) in sorted(dict(self.open.iterator()).items()):
            if self._due(at) <= fired:
                if status in RUNNING:
                    out.append((key[0], pd.Timestamp(at, unit="us"), pd.Timestamp(at + self.wait, unit="us"), self.error))
                self.open.removeKey((at, seq))
        return iter([pd.DataFrame(out, columns=["job_id", "updated_at", "failed_at", "error"])] if out else ())


@contextmanager
def _timers(spark: SparkSession):
    """The state store that keeps timers, for the queries that start inside."""
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], before)


def stale_stream(reports: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(job_id, updated_at, failed_at, error) of each time that a running job of a stream of reports (job_id, at, seq, status) goes stale."""
    kind = dict(reports.dtypes)["job_id"]
    seen = reports.select("job_id", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "status")
    schema = f"job_id {kind}, updated_at timestamp, failed_at timestamp, error string"
    return seen.withWatermark("at", delay).groupBy("job_id").transformWithStateInPandas(Watchdog(seconds), schema, "Append", "EventTime")


def watch(reports: DataFrame, checkpoint: str, sink: str, seconds: int, delay: str = "0 seconds", every: str | None = None):
    """Writes what goes stale to a sink, a folder a micro-batch; every: keep running and wake so often (else stop at the end of what is there)."""
    with _timers(reports.sparkSession):
        writer = stale_stream(reports, seconds, delay).writeStream.outputMode("append").foreachBatch(lambda b, i: _sink(b, sink, i)).option("checkpointLocation", checkpoint)
        return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
