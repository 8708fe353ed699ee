"""Memory tables: scans, recall, versions and lifecycle. Every function takes DataFrames and an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import scalar as sc
from . import nearest


def scan(m: DataFrame, org, agent=None, user=None, memory_type=None, metadata: dict | None = None, between=None, as_of=None, include_deleted=False, exclude_quarantined=False, conversation=None) -> DataFrame:
    """Current (or as-of) memories of a tenant under all given filters; metadata must hold all of the given values, at any depth."""
    keep = F.col("org_id") == F.lit(org)
    for column, value in (("agent_id", agent), ("user_id", user), ("memory_type", memory_type), ("conversation_id", conversation)):
        if value is not None:
            keep &= F.col(column) == F.lit(value)
    for k, v in (metadata or {}).items():
        # texts are compared natively first; where they could be another type's (1 or "1"), and for the rest, as JSON
        if plain := isinstance(v, str) and "'" not in k:
            keep &= jsons.value_at(F.col("metadata"), k).eqNullSafe(F.lit(v))
        if not plain or jsons.is_json(v):
            keep &= jsons.contains(F.col("metadata"), {k: v})
    if between is not None:
        keep &= F.col("created_at").between(*between)
    if "valid_from" in m.columns:
        keep &= ((F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))) if as_of is not None else F.col("valid_to").isNull()
    if not include_deleted:
        keep &= F.col("deleted_at").isNull()
    if exclude_quarantined and "quarantined" in m.columns:
        keep &= ~F.col("quarantined")
    return m.filter(keep)


def recall_vector(m: DataFrame, query: Column, now: Column, k: int = 10, threshold: float = 0.0, weights=sc.WEIGHTS) -> DataFrame:
    """Nearest k by cosine first, then those of the threshold, then by fused relevance."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    near = m.filter(F.col("embedding").isNotNull()).withColumn("similarity", sc.cosine(F.col("embedding"), query)).orderBy(F.col("similarity").desc(), F.col("id").asc()).limit(k)
    score = weights[0] * F.col("similarity") + weights[1] * F.col("importance_score") + weights[2] * sc.recency(now, F.col("created_at"))
    return near.filter(F.col("similarity") >= threshold).withColumn("relevance_score", score).orderBy(F.col("relevance_score").desc(), "id")


def recall_fallback(m: DataFrame, now: Column, k: int = 10) -> DataFrame:
    top = m.orderBy(F.col("importance_score").desc(), F.col("created_at").desc(), "id").limit(k)
    return top.withColumn("relevance_score", 0.5 * F.col("importance_score") + 0.5 * sc.recency(now, F.col("created_at")))


def knn_per_query(m: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest memories of each (query_id, q) of a stated query set, without the memory of the query's own id."""
    return nearest.knn(m, queries, k)


def near_duplicate(m: DataFrame, query: Column, threshold: float = 0.95) -> DataFrame:
    near = m.filter(F.col("embedding").isNotNull()).withColumn("similarity", sc.cosine(F.col("embedding"), query)).orderBy(F.col("similarity").desc(), "id").limit(1)
    return near.filter(F.col("similarity") > threshold)


def rerank(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """Min-max normalised scores; all equal: 0.5, a single row: 1."""
    every = W.partitionBy(F.lit(1))  # the rows of one answer
    raw = rows.withColumn("raw", score).withColumn("lo", F.min("raw").over(every)).withColumn("hi", F.max("raw").over(every)).withColumn("n", F.count("*").over(every))
    new = F.when(F.col("n") == 1, 1.0).when(F.col("hi") - F.col("lo") < 1e-9, 0.5).otherwise((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return raw.withColumn("relevance_score", new).drop("raw", "lo", "hi", "n").orderBy(F.col("relevance_score").desc(), "id").limit(k)


def trace_merge(steps: DataFrame) -> DataFrame:
    """Of the steps' rows (step, id, relevance_score), each id's best and the first step that had it."""
    by = W.partitionBy("id").orderBy(F.col("relevance_score").desc(), "step")
    return steps.withColumn("rn", F.row_number().over(by)).filter("rn = 1").drop("rn")


def tier_fanout(m: DataFrame, query: Column, now: Column, tiers: list[str], k: int) -> DataFrame:
    """Nearest k of each tier, merged and cut to k by relevance."""
    x = m.filter(F.col("memory_type").isin(tiers) & F.col("embedding").isNotNull()).withColumn("similarity", sc.cosine(F.col("embedding"), query))
    x = x.withColumn("rn", F.row_number().over(W.partitionBy("memory_type").orderBy(F.col("similarity").desc(), "id"))).filter(F.col("rn") <= k).drop("rn")
    w = sc.WEIGHTS
    return x.withColumn("relevance_score", w[0] * F.col("similarity") + w[1] * F.col("importance_score") + w[2] * sc.recency(now, F.col("created_at"))).orderBy(F.col("relevance_score").desc(), "id").limit(k)


# --- versions --------------------------------------------------------------------------------------------------------


def history(m: DataFrame, memory_id) -> DataFrame:
    return m.filter(F.col("id") == memory_id).orderBy(F.col("valid_from").asc_nulls_last())


def changed_between(m: DataFrame, start: Column, end: Column, org=None) -> DataFrame:
    keep = F.col("valid_from").between(start, end)
    return m.filter(keep & (F.col("org_id") == org) if org is not None else keep).orderBy("valid_from", "id")


def memo_versions(m: DataFrame) -> DataFrame:
    by = W.partitionBy("id").orderBy("valid_from")
    return m.select(F.col("id").alias("memo_id"), F.row_number().over(by).alias("version"), "valid_from", F.lead("valid_from").over(by).alias("valid_to"))


def memo_as_of(targets: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """Each target's version that holds at a time (none: null)."""
    live = versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).groupBy("memo_id").agg(F.max("version").alias("version"))
    return targets.join(live, targets["id"] == live["memo_id"], "left").drop("memo_id")


def apply_updates(m: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Slowly changing rows: (id, importance_score, recall_count, deleted_at) updates of current rows.

    A change of deleted_at alone or of recall_count alone stays in place; any other closes the row and opens a version."""
    u = updates.select(F.col("id").alias("u_id"), *[F.col(c).alias(f"u_{c}") for c in ("importance_score", "recall_count", "deleted_at")])
    j = m.join(u, (F.col("id") == F.col("u_id")) & F.col("valid_to").isNull(), "left")
    changed = lambda c: F.col("u_id").isNotNull() & F.col(f"u_{c}").isNotNull() & ~F.col(f"u_{c}").eqNullSafe(F.col(c))
    versioned = changed("importance_score")
    kept = j.withColumn("versioned", versioned)
    rest = [c for c in m.columns if c not in ("importance_score", "recall_count", "deleted_at", "valid_from", "valid_to")]
    new = lambda c: F.coalesce(F.col(f"u_{c}"), F.col(c)).alias(c)
    place = kept.filter(~F.col("versioned")).select(*rest, "importance_score", new("recall_count"), new("deleted_at"), "valid_from", "valid_to")
    shut = kept.filter("versioned").select(*rest, "importance_score", "recall_count", "deleted_at", "valid_from", now.alias("valid_to"))
    opened = kept.filter("versioned").select(*rest, new("importance_score"), new("recall_count"), new("deleted_at"), now.alias("valid_from"), F.lit(None).cast(m.schema["valid_to"].dataType).alias("valid_to"))
    return place.unionByName(shut).unionByName(opened)


# --- lifecycle -------------------------------------------------------------------------------------------------------


def ttl_sweep(m: DataFrame, now: Column) -> DataFrame:
    return m.filter((F.col("ttl_expires_at") < now) & F.col("deleted_at").isNull()).withColumn("deleted_at", now)


def retention_evictions(m: DataFrame, cap: int) -> DataFrame:
    """Unpinned memories over the cap of (org, agent, type), least important and oldest first; pinned ones count too."""
    group = W.partitionBy("org_id", "agent_id", "memory_type")
    order = W.partitionBy("org_id", "agent_id", "memory_type", "pinned").orderBy("importance_score", "created_at", "id")
    live = m.filter(F.col("deleted_at").isNull()).withColumn("excess", F.count("*").over(group) - cap).withColumn("rn", F.row_number().over(order))
    return live.filter(~F.col("pinned") & (F.col("rn") <= F.col("excess"))).drop("excess", "rn")


def decay(m: DataFrame, now: Column, rate: float = 0.05, floor: float = 0.0, curve: str = "exponential") -> DataFrame:
    live = m.filter(F.col("deleted_at").isNull() & ~F.col("pinned") & (F.col("importance_score") > floor))
    days = sc.days_between(now, F.coalesce("last_recalled_at", "created_at"))
    return live.withColumn("new_score", F.round(sc.decayed(F.col("importance_score"), days, rate, floor, curve), 6))


def decay_summary(decayed: DataFrame, least: float = 0.05) -> DataFrame:
    moved = F.abs(F.col("new_score") - F.col("importance_score")) > 1e-4
    return decayed.agg(F.count("*").alias("examined"), F.count_if(moved).alias("changed"), F.count_if(moved & (F.col("new_score") < least)).alias("below"))


def bump_recalls(m: DataFrame, recalls: DataFrame) -> DataFrame:
    """recall_count and last_recalled_at after recalls (id, at), summed first."""
    delta = recalls.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    j = m.join(delta.withColumnRenamed("id", "d_id"), F.col("id") == F.col("d_id"), "left")
    return j.withColumn("recall_count", (F.col("recall_count") + F.coalesce("n", F.lit(0))).cast("long")).withColumn("last_recalled_at", F.coalesce("at", "last_recalled_at")).drop("n", "at", "d_id")


def forget(m: DataFrame, edges: DataFrame, targets: DataFrame, now: Column, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memories and edges after targets (id) are forgotten, softly or for good."""
    ids = targets.select(F.col("id").alias("t_id")).distinct()
    if not hard:
        j = m.join(ids, F.col("id") == F.col("t_id"), "left")
        return j.withColumn("deleted_at", F.when(F.col("t_id").isNotNull(), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("t_id"), edges
    left = edges.join(ids, F.col("source_memory_id") == F.col("t_id"), "left_anti").join(ids, F.col("target_memory_id") == F.col("t_id"), "left_anti")
    return m.join(ids, F.col("id") == F.col("t_id"), "left_anti"), left
