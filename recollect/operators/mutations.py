"""Writes as new snapshots: store, update, transition, relationships, conversations, jobs, feedback, usage, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import scalar as sc
from . import nearest

#: Fixed values.
MEMORY_TYPES = ("working", "episodic", "semantic", "procedural")
ROLES = ("user", "assistant", "system", "tool", "function")
SIGNALS = (-1, 0, 1)
RELATIONS = ("derived_from", "contradicts", "supports", "supersedes", "related_to", "caused_by")


class StoreError(ValueError):
    """A write whose values aren't allowed."""


class DuplicateMemoryError(StoreError):
    """A memory that is too near to another one of its org and agent."""

    def __init__(self, existing_id, similarity: float):
        super().__init__(f"a near-duplicate memory exists: {existing_id} (similarity {similarity:.4f})")
        self.existing_id, self.similarity = existing_id, similarity


def refuse(rows: DataFrame, wrong: Column, why: str) -> None:
    if not rows.filter(F.coalesce(wrong, F.lit(True))).isEmpty():
        raise StoreError(why)


def once(rows: DataFrame, key: str) -> None:
    """Raises where two rows have one key."""
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise StoreError(f"two rows have one {key}")


def store(m: DataFrame, rows: DataFrame, now: Column, ttl_seconds: int | None = None, duplicate_threshold: float | None = None) -> DataFrame:
    """m with new memories: (id, org_id, agent_id, content, memory_type) and any further columns of m.

    Importance is .5 where it is null. Ids must be new and differ. With a threshold, rows whose nearest current memory of
    their org and agent, or nearest other new one, is closer are refused."""
    refuse(rows, F.trim(F.coalesce("content", F.lit(""))) == "", "content must be a non-empty string")
    refuse(rows, ~F.col("memory_type").isin(*MEMORY_TYPES), "memory_type must be one of " + ", ".join(MEMORY_TYPES))
    score = F.coalesce("importance_score", F.lit(0.5)) if "importance_score" in rows.columns else F.lit(0.5)
    refuse(rows, ~score.between(0.0, 1.0), "importance must be between 0.0 and 1.0")
    once(rows, "id")
    if not rows.join(m.select("id"), "id", "left_semi").isEmpty():
        raise StoreError("a memory of this id exists")
    if duplicate_threshold is not None:
        cell = F.concat_ws(":", F.col("org_id").cast("string"), F.coalesce(F.col("agent_id").cast("string"), F.lit("none")))
        live = m.filter(F.col("deleted_at").isNull() & (F.col("valid_to").isNull() if "valid_to" in m.columns else F.lit(True)))
        vectors = lambda d: d.filter(F.col("embedding").isNotNull()).select(cell.alias("cell"), "id", "embedding")
        asked = vectors(rows).select("cell", F.col("id").alias("query_id"), F.col("embedding").alias("q"))
        # rows and new ones meet in blocks of an agent's memories, however many it has
        near = nearest.in_cells(vectors(live).unionByName(vectors(rows)), asked, 1).filter(F.col("similarity") > duplicate_threshold)
        if found := near.orderBy(F.col("similarity").desc(), "id").select("id", "similarity").limit(1).collect():
            raise DuplicateMemoryError(*found[0])
    new = rows.withColumn("importance_score", score).withColumn("recall_count", F.lit(0).cast("long")).withColumn("created_at", now)
    for c, value in (("valid_from", now), ("ttl_expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds else None)):
        if c in m.columns and value is not None:
            new = new.withColumn(c, value)
    new = new.withColumn("pinned", F.coalesce("pinned", F.lit(False)) if "pinned" in rows.columns else F.lit(False))
    return m.unionByName(new.select(*[c for c in m.columns if c in new.columns]), allowMissingColumns=True)


def stored(m: DataFrame, rows: DataFrame, now: Column, **options) -> dict[str, DataFrame]:
    """What a call of ``store`` leaves: memories, and for the new ones their relationships, audit rows and first memo versions.

    rows may have relationships, array<struct<target_id, type, weight>>: known types, weights from 0 to 1 (1 where null), none
    to the memory itself."""
    linked = "relationships" in rows.columns
    kind = dict(rows.dtypes)["id"]
    each = rows.select("id", "org_id", F.explode("relationships").alias("r")).select(
        F.col("id").alias("source_memory_id"), "org_id", F.col("r.target_id").alias("target_memory_id"), F.col("r.type").alias("relationship_type"), F.coalesce(F.col("r.weight").cast("double"), F.lit(1.0)).alias("weight")
    ) if linked else rows.limit(0).select(F.col("id").alias("source_memory_id"), "org_id", F.col("id").alias("target_memory_id"), F.lit("").alias("relationship_type"), F.lit(1.0).alias("weight"))
    if linked:
        refuse(each, ~F.col("relationship_type").isin(*RELATIONS), "relationship_type must be one of " + ", ".join(RELATIONS))
        refuse(each, ~F.col("weight").between(0.0, 1.0), "a weight must be between 0.0 and 1.0")
        refuse(each, F.col("source_memory_id") == F.col("target_memory_id"), "a memory isn't related to itself")
    memories = store(m, rows.drop("relationships"), now, **options)
    number = F.size(F.coalesce("relationships", F.array().cast(rows.schema["relationships"].dataType))) if linked else F.lit(0)
    details = F.to_json(F.struct(F.col("memory_type"), number.alias("relationship_count")))
    audit = rows.select("org_id", "agent_id", F.col("id").alias("memory_id"), "memory_type", F.lit("store").alias("operation"), details.alias("details"), now.alias("created_at"))
    versions = rows.select(F.col("id").cast(kind).alias("memo_id"), F.lit(1).alias("version"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return {"memories": memories, "relationships": each, "audit": audit, "versions": versions}


def update(m: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Current rows closed and opened anew with the content, metadata (replaced, not merged), importance or type of changes (id, and at least one of them not null)."""
    names = [c for c in ("content", "metadata", "importance_score", "memory_type") if c in changes.columns]
    if not names:
        raise StoreError("an update changes content, metadata, importance or type")
    refuse(changes, F.coalesce(*[F.col(c).cast("string") for c in names]).isNull(), "an update changes content, metadata, importance or type")
    once(changes, "id")
    u = changes.select(F.col("id").alias("u_id"), *[F.col(c).alias(f"u_{c}") for c in names])
    j = m.join(u, (F.col("id") == F.col("u_id")) & F.col("valid_to").isNull() & F.col("deleted_at").isNull(), "left")
    differs = F.lit(False)
    for c in names:
        differs |= F.col(f"u_{c}").isNotNull() & ~F.col(f"u_{c}").eqNullSafe(F.col(c))
    j = j.withColumn("versioned", F.coalesce(differs, F.lit(False)))
    kept = j.withColumn("valid_to", F.when(F.col("versioned"), now).otherwise(F.col("valid_to"))).select(*m.columns)
    opened = j.filter("versioned").withColumn("valid_from", now).withColumns({c: F.coalesce(f"u_{c}", c) for c in names}).select(*m.columns)
    return kept.unionByName(opened)


def transition(m: DataFrame, ids: DataFrame, memory_type: str, now: Column) -> DataFrame:
    """Current rows of ids as a new version of another memory type."""
    if memory_type not in MEMORY_TYPES:
        raise StoreError("unknown memory_type")
    return update(m, ids.select("id", F.lit(memory_type).alias("memory_type")), now)


def upsert_sum(table: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables' values summed by keys; rows of 0 or less are ignored."""
    return table.select(*keys, value).unionByName(rows.filter(F.col(value) > 0).select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def patched(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the values of changes that aren't null, by key."""
    names = [c for c in changes.columns if c != key]
    u = changes.select(F.col(key).alias("u_key"), *[F.col(c).alias(f"u_{c}") for c in names])
    j = table.join(u, F.col(key) == F.col("u_key"), "left")
    return j.select(*[F.coalesce(f"u_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def add_feedback(feedback: DataFrame, rows: DataFrame) -> DataFrame:
    """feedback with rows (memory_id or edge_id, signal): exactly one target, a signal of -1, 0 or 1."""
    refuse(rows, ~F.col("signal").isin(*SIGNALS), "signal must be -1, 0 or 1")
    refuse(rows, F.col("memory_id").isNull() == F.col("edge_id").isNull(), "exactly one of memory_id and edge_id")
    return feedback.unionByName(rows, allowMissingColumns=True)


def add_turns(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their turn_count raised, and the new turns (conv_id, at, role) with turn_index going on from it."""
    refuse(turns, ~F.col("role").isin(*ROLES), "role must be one of " + ", ".join(ROLES))
    by = W.partitionBy("conv_id").orderBy("at")
    n = turns.groupBy(F.col("conv_id").alias("c_id")).agg(F.count("*").alias("more"))
    held = conversations.select(F.col("id").alias("conv_id"), "turn_count")
    new = turns.join(held, "conv_id").withColumn("turn_index", F.col("turn_count") + F.row_number().over(by)).drop("turn_count")
    raised = conversations.join(n, F.col("id") == F.col("c_id"), "left").withColumn("turn_count", F.col("turn_count") + F.coalesce("more", F.lit(0))).drop("more", "c_id")
    return raised, new


def mark_summary(conversations: DataFrame, marks: DataFrame) -> DataFrame:
    """last_summary_turn never falls: the greater of what it is and marks (id, turn)."""
    u = marks.groupBy(F.col("id").alias("u_id")).agg(F.max("turn").alias("turn"))
    return conversations.join(u, F.col("id") == F.col("u_id"), "left").withColumn("last_summary_turn", F.greatest("last_summary_turn", F.coalesce("turn", "last_summary_turn"))).drop("u_id", "turn")


def mark_dispatched(tenants: DataFrame, ids: DataFrame, at: Column | None, now: Column) -> DataFrame:
    """refine_last_run_at of the tenants of ids: the given time or now."""
    u = ids.select(F.col("org_id").alias("u_id")).distinct()
    when = F.coalesce(at, now) if at is not None else now
    return tenants.join(u, F.col("org_id") == F.col("u_id"), "left").withColumn("refine_last_run_at", F.when(F.col("u_id").isNotNull(), when).otherwise(F.col("refine_last_run_at"))).drop("u_id")


def mirror(m: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph's vertices (id, org_id, memory_type, preview of 200 characters) and edges (src, dst, safe label, weight) of current memories."""
    live = m.filter(F.col("deleted_at").isNull())
    nodes = live.select("id", "org_id", "memory_type", F.left(F.coalesce("content", F.lit("")), F.lit(200)).alias("preview"))
    ids = live.select(F.col("id").alias("n_id"))
    e = edges.join(ids, F.col("source_memory_id") == F.col("n_id"), "left_semi").join(ids, F.col("target_memory_id") == F.col("n_id"), "left_semi")
    return nodes, e.select(*(["id"] if "id" in edges.columns else []), F.col("source_memory_id").alias("src"), F.col("target_memory_id").alias("dst"), sc.safe_label(F.col("relationship_type")).alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def stamp_provenance(m: DataFrame, job: str, model: str, prompt_hash: Column) -> DataFrame:
    """m with distill_provenance: a JSON blob with a correlation id made of job and memory."""
    cid = F.sha2(F.concat_ws(":", F.lit(job), F.col("id").cast("string")), 256)
    return m.withColumn("distill_provenance", F.to_json(F.struct(cid.alias("correlation_id"), F.lit(job).alias("job_id"), F.lit(model).alias("model"), prompt_hash.alias("prompt_hash"))))


def merge_losers(m: DataFrame, grouped: DataFrame, now: Column) -> DataFrame:
    """m after deduplication: losers are deleted, and each primary's metadata lists them under refine.merged_from."""
    losers = grouped.filter("loses").select(F.col("id").alias("l_id"), "primary_id")
    lists = losers.groupBy("primary_id").agg(F.to_json(F.array_sort(F.collect_list("l_id"))).alias("merged"))
    x = m.join(losers.select("l_id"), F.col("id") == F.col("l_id"), "left").join(lists, F.col("id") == F.col("primary_id"), "left")
    new = F.when(F.col("merged").isNotNull(), jsons.appended(F.col("metadata"), ("refine", "merged_from"), F.col("merged"))).otherwise(F.col("metadata"))
    return x.withColumn("metadata", new).withColumn("deleted_at", F.when(F.col("l_id").isNotNull(), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*m.columns)


def by_source_uri(m: DataFrame, uri: str, dataset=None) -> DataFrame:
    """The newest current memory that came from a URI, in a dataset (null: those in none)."""
    keep = F.col("deleted_at").isNull() & (F.get_json_object("metadata", "$.source_uri") == uri)
    return in_dataset(m.filter(keep), dataset).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def in_dataset(m: DataFrame, dataset=None) -> DataFrame:
    """Rows of a dataset; without one, those that belong to none."""
    return m.filter(F.col("dataset_id").eqNullSafe(F.lit(dataset)))
