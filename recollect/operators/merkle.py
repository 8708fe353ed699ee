"""Merkle roots of any number of leaves a tenant, in parallel.

Leaves are sorted by range over all tasks and numbered by their partitions' counts. Blocks of SPAN neighbours, aligned to
a power of two, are then hashed to one node each, and the blocks' nodes in the same way until one is left a tenant: three
rounds are enough for 10^10 leaves, and no task holds more than SPAN nodes of a tenant at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import shared_folder

HEIGHT = 12
SPAN = 1 << HEIGHT


def merkle(leaves: list[bytes]) -> bytes:
    """Root over sorted leaves; an odd last one is paired with itself; no leaf: the hash of nothing."""
    return raised(sorted(leaves) or [hashlib.sha256(b"").digest()])[0]


def raised(level: list[bytes], height: int | None = None) -> list[bytes]:
    """The level so many levels up (none: the root's)."""
    while len(level) > 1 if height is None else height:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        height = None if height is None else height - 1
    return level


def leaves(m: DataFrame, key: str) -> DataFrame:
    """(key, node): sha256(id:content_hash:audit_hash), '-' for a missing audit hash; those, where m has them, in audit_hash."""
    audit_hash = F.when(F.coalesce(F.col("audit_hash"), F.lit("")) != "", F.col("audit_hash")).otherwise("-") if "audit_hash" in m.columns else F.lit("-")
    text = F.concat_ws(":", F.col("id").cast("string"), F.sha2(F.coalesce("content", F.lit("")), 256), audit_hash)
    return m.select(F.col(key).alias("key"), F.unhex(F.sha2(text, 256)).alias("node"))


def numbered(nodes: DataFrame) -> DataFrame:
    """(key, node) with number, from 0 in the order of nodes of each key, and total, their count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, batch.num_rows - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            null = key.is_null().to_numpy(zero_copy_only=False)
            new[1:] &= ~(null[1:] & null[:-1])
            new[0] = last is None or last[0] != key[0].as_py()
            first = np.flatnonzero(new)
            at = np.arange(batch.num_rows)
            start = np.zeros(batch.num_rows, np.int64)
            start[first] = first
            at = at - np.maximum.accumulate(start)
            at[: first[0] if len(first) else len(at)] += n
            last, n = (key[-1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([key, batch.column("node"), batch.column("part"), pa.array(at, pa.int64())], names=["key", "node", "part", "at"])

    kind = dict(nodes.dtypes)["key"]
    dealt = nodes.repartitionByRange("key", "node").sortWithinPartitions("key", "node").withColumn("part", F.spark_partition_id())
    at = f"{shared_folder(nodes.sparkSession)}/leaves-{uuid.uuid4().hex}"
    dealt.mapInArrow(count, f"key {kind}, node binary, part int, at long").write.parquet(at)  # partition numbers are kept as written
    held = nodes.sparkSession.read.parquet(at)
    by = W.partitionBy("key").orderBy("part")
    per = held.groupBy("key", "part").agg(F.count("*").alias("n"))  # a row a partition and tenant
    per = per.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy("key")))
    per = per.select(F.col("key").alias("p_key"), F.col("part").alias("p_part"), "before", "total")
    joined = held.join(per, held["key"].eqNullSafe(per["p_key"]) & (held["part"] == per["p_part"]))
    return joined.select("key", "node", (F.col("before") + F.col("at")).alias("number"), "total")


def roots(m: DataFrame, key: str) -> DataFrame:
    """(key, merkle_root, leaves) of each key's rows (id, content, audit_hash if there)."""
    kind = dict(m.dtypes)[key]
    level = numbered(leaves(m, key)).withColumn("leaves", F.col("total"))
    most = level.agg(F.max("total")).first()[0] or 0

    def up(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("number")
        total = nodes.column("total")[0].as_py()
        node = raised(nodes.column("node").to_pylist(), None if total <= SPAN else HEIGHT)
        one = nodes.slice(0, 1)
        return one.set_column(one.schema.get_field_index("node"), "node", pa.array(node, pa.binary())).set_column(one.schema.get_field_index("number"), "number", pc.divide(one.column("number"), SPAN)).set_column(one.schema.get_field_index("total"), "total", pa.array([-(-total // SPAN)], pa.int64()))

    while True:
        level = level.withColumn("block", F.expr(f"number div {SPAN}"))
        level = level.groupBy("key", "block").applyInArrow(up, f"key {kind}, node binary, number long, total long, leaves long, block long").drop("block")
        if most <= SPAN:
            return level.select(F.col("key").alias(key), F.lower(F.hex("node")).alias("merkle_root"), "leaves")
        most = -(-most // SPAN)
