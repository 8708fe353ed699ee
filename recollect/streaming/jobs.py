"""Streams: counter deltas in micro-batches, the audit chain, the cadence of conversations, stale jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import audit


def _sink(df: DataFrame, sink: str, batch_id: int) -> None:
    """A micro-batch's rows in a folder of its own: a batch that runs again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def counter_stream(source: DataFrame, checkpoint: str, sink: str):
    """Adds up recall counts by id in each micro-batch; the sum over the sink is the final count."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        _sink(batch.groupBy("id").agg(F.count("*").alias("n")), sink, batch_id)

    return source.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_stream(source: DataFrame, checkpoint: str, sink: str, every: str | None = None):
    """Appends each micro-batch's rows to their tenants' hash chains.

    The hashes to go on from stand in a table beside the sink: a batch reads its predecessor's and writes its own, a row a
    tenant, so that no batch reads the chain so far; a batch that runs again replaces both. every: a drain that keeps
    running and looks for new rows so often (else it stops at the end of what is there)."""

    def drain(batch: DataFrame, batch_id: int) -> None:
        heads = batch.sparkSession.read.parquet(f"{sink}-heads/{batch_id - 1}") if batch_id else None
        _sink(audit.hash_chain(batch, heads), sink, batch_id)
        chained = batch.sparkSession.read.parquet(f"{sink}/batch_id={batch_id}")
        new = chained.groupBy("org_id").agg(F.max_by("row_hash", "id").alias("row_hash"))
        if heads is not None:
            new = new.unionByName(heads.join(new.select("org_id"), "org_id", "left_anti"))
        new.write.mode("overwrite").parquet(f"{sink}-heads/{batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def cadence_stream(turns: DataFrame, cadence: int) -> DataFrame:
    """(conv_id, turn_count) each time that a conversation of a stream of turns reaches a further multiple of cadence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        new = n + sum(len(f) for f in frames)
        state.update((new,))
        due = range((n // cadence + 1) * cadence, new + 1, cadence)
        yield pd.DataFrame({"conv_id": [key[0]] * len(due), "turn_count": list(due)})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn_count long", "n long", "append", GroupStateTimeout.NoTimeout)


def run_over(spark: SparkSession, path: str, start: Callable, folder: str, columns: list[str], where: str = "true") -> DataFrame:
    """Runs a stream over a folder or file of Parquet to its end and reads what its sink holds."""
    schema = spark.read.parquet(path).schema
    directory, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(directory).filter(where).selectExpr(*columns)
    start(source, f"{folder}/state", f"{folder}/sink").awaitTermination()
    return spark.read.option("basePath", f"{folder}/sink").parquet(f"{folder}/sink")
