"""Labelled rows for the two classifiers: bounded training samples and the held-out rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int, max_bytes: int) -> DataFrame:
    """text and y of at most limit labelled rows out of the learning folds, by hashed id; texts over max_bytes aren't learnt from."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id"), folds) != held))
    # ids first, so that the texts are needed of the sampled rows alone
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    return texts.join(F.broadcast(known), texts["doc_id"] == known["id"]).orderBy("doc_id", "text").limit(2 * limit).select("text", F.col("y").cast("int").alias("y"))


def fitted(rows: DataFrame, fit: Callable):
    """What fit makes of the texts and labels of a bounded sample, in one task, so that only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True))
        model = fit([t for t, _ in got], np.array([y for _, y in got], float))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()  # one row
    return cloudpickle.loads(bytes(found[0][0])) if found else fit([], np.zeros(0))
