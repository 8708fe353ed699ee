"""Audit log: pages, summaries, partitions, the queue and the hash chain."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The hashed fields, and the operations that a log knows.
FIELDS = ("org_id", "operation", "agent_id", "user_id", "memory_id", "memory_type", "details", "created_at")
OPERATIONS = ("store", "recall", "forget", "update", "quarantine", "pin", "unpin", "export", "gdpr_delete", "distill")


def matching(log: DataFrame, org, agent=None, user=None, operation=None, memory=None, memory_type=None, between=None) -> DataFrame:
    """Rows of a tenant under all given filters; a time range includes both its ends."""
    keep = F.col("org_id") == F.lit(org)
    for column, value in (("agent_id", agent), ("user_id", user), ("operation", operation), ("memory_id", memory), ("memory_type", memory_type)):
        if value is not None:
            keep &= F.col(column) == F.lit(value)
    if between is not None:
        keep &= F.col("created_at").between(*between)
    return log.filter(keep)


def page(log: DataFrame, number: int, size: int) -> DataFrame:
    """A page, newest first, with the total and whether a next page exists on each row."""
    size = min(size, 100)
    rows = log.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((number - 1) * size).limit(size)
    total = log.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)  # one row


def keyset(log: DataFrame, cursor: int, size: int) -> DataFrame:
    """Rows before a cursor, with the next cursor (the page's last id) where a further row exists; one more row is read to tell."""
    size = min(size, 100)
    probe = log.filter(F.col("id") < cursor).orderBy(F.col("id").desc()).limit(size + 1)
    every = W.partitionBy(F.lit(1))  # the rows of one page
    probe = probe.withColumn("rn", F.row_number().over(every.orderBy(F.col("id").desc()))).withColumn("n", F.count("*").over(every))
    last = F.min(F.when(F.col("rn") <= size, F.col("id"))).over(every)
    return probe.withColumn("next_cursor", F.when(F.col("n") > size, last)).filter(F.col("rn") <= size).drop("rn", "n")


def activity(log: DataFrame) -> DataFrame:
    """Operations of each agent, with the agent's total."""
    n = log.groupBy("org_id", "agent_id", "operation").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(W.partitionBy("org_id", "agent_id")))


def missing_months(log: DataFrame, now: Column, ahead: int) -> DataFrame:
    """Months (first days) from now on, so many ahead, that the log has no row of."""
    months = log.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(now, "MM"), F.add_months(F.trunc(now, "MM"), ahead), F.expr("interval 1 month"))).alias("month"))
    have = log.select(F.trunc(F.col("created_at").cast("date"), "MM").alias("month")).distinct()
    return months.join(have, "month", "left_anti")


def enqueue(pending: DataFrame, rows: DataFrame) -> DataFrame:
    """The queue with new rows (without id) after its last id, in the order of created_at; rows of unknown operations are refused."""
    wrong = rows.filter(~F.col("operation").isin(*OPERATIONS) | F.col("operation").isNull() | F.col("org_id").isNull())
    if not wrong.isEmpty():
        raise ValueError("audit rows need an org_id and one of the known operations")
    last = pending.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = rows.crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.row_number().over(W.orderBy("created_at", "org_id", "operation"))).drop("last")  # a call's own few rows
    return pending.unionByName(numbered, allowMissingColumns=True)


def expiries(swept: DataFrame, now: Column) -> DataFrame:
    """Audit rows of memories that a sweep has forgotten for their age."""
    return swept.select("org_id", "agent_id", F.col("id").alias("memory_id"), F.lit("forget").alias("operation"), F.to_json(F.struct(F.lit("ttl_expiry").alias("reason"))).alias("details"), now.alias("created_at"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an older snapshot that a newer one lacks or holds otherwise: an append-only log has none."""
    return before.exceptAll(after.select(*before.columns))


def canonical(row: dict) -> bytes:
    return json.dumps(row, sort_keys=True, separators=(",", ":"), default=str).encode()


def chained(row: dict, before: bytes) -> bytes:
    return hashlib.sha256(before + canonical(row)).digest()


def _plain(row: dict) -> dict:
    """The hashed fields: ids as text, details as what its JSON holds, times in ISO form."""
    text = lambda v: None if v is None else str(v)
    details = row["details"]
    return {
        "org_id": str(row["org_id"]), "operation": row["operation"], "agent_id": text(row["agent_id"]), "user_id": text(row["user_id"]),
        "memory_id": text(row["memory_id"]), "memory_type": row["memory_type"],
        "details": json.loads(details) if isinstance(details, str) and details else details or {}, "created_at": row["created_at"].isoformat(),
    }


def hash_chain(pending: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """pending with prev_hash and row_hash: each tenant's rows in order of id, every hash over the one before it.

    heads: (org_id, row_hash) of the chains so far. The fold is sequential by definition, so a tenant is one task, but its
    rows stream through it. Columns that pending lacks count as null."""
    for c in FIELDS:
        if c not in pending.columns:
            pending = pending.withColumn(c, F.lit(None).cast("string"))
    rows = pending.withColumn("head_hash", F.lit(None).cast("binary"))
    if heads is not None:
        rows = pending.join(heads.select("org_id", F.col("row_hash").alias("head_hash")), "org_id", "left")
    schema = pending.schema.simpleString().removeprefix("struct<").removesuffix(">")
    names = pending.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        org, before = object(), b""
        for batch in batches:
            prev, new = [], []
            for row in batch.to_pylist():
                if row["org_id"] != org:
                    org, before = row["org_id"], row["head_hash"] or b""
                prev.append(before or None)
                before = chained(_plain(row), before)
                new.append(before)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prev, pa.binary()), pa.array(new, pa.binary())], names=[*names, "prev_hash", "row_hash"])

    ordered = rows.repartition("org_id").sortWithinPartitions("org_id", "id").select(*names, "head_hash")
    return ordered.mapInArrow(fold, f"{schema}, prev_hash binary, row_hash binary")


def latest_hash(chain: DataFrame) -> DataFrame:
    """(org_id, row_hash) of each tenant's newest row, by created_at and then id."""
    return chain.groupBy("org_id").agg(F.max_by("row_hash", F.struct("created_at", "id")).alias("row_hash"))


def verify(chain: DataFrame) -> DataFrame:
    """(org_id, id, reason) of rows whose hash isn't that of their own fields and prev_hash ('content'), or whose prev_hash
    isn't the row_hash before them ('link'). Hashes are worked out anew, row by row, in parallel."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ok = [r["row_hash"] == chained(_plain(r), r["prev_hash"] or b"") for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("org_id"), batch.column("id"), batch.column("prev_hash"), batch.column("row_hash"), pa.array(ok, pa.bool_())], names=["org_id", "id", "prev_hash", "row_hash", "ok"])

    kinds = dict(chain.dtypes)
    told = chain.select("id", "prev_hash", "row_hash", *FIELDS).mapInArrow(again, f"org_id {kinds['org_id']}, id {kinds['id']}, prev_hash binary, row_hash binary, ok boolean")
    told = told.withColumn("want", F.lag("row_hash").over(W.partitionBy("org_id").orderBy("id")))
    link = ~F.col("want").eqNullSafe(F.col("prev_hash"))
    return told.filter(~F.col("ok") | link).select("org_id", "id", F.when(~F.col("ok"), "content").otherwise("link").alias("reason"))
