"""Refinement of the graph and distilled results: duplicates, weights, clusters, merges; usage and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc


def dedupe_groups(m: DataFrame) -> DataFrame:
    """m with dedupe_key (a hash of it), the primary of each group (first by valid_from and id) and whether the row loses.

    The key is the ontology uri (an empty one is none), else memo type and normalised content; rows with neither are left out."""
    uri = F.when(F.coalesce(F.col("ontology_uri"), F.lit("")) != "", F.concat(F.lit("uri:"), "ontology_uri"))
    named = F.when(F.coalesce(F.col("memo_type"), F.lit("")) != "", F.concat(F.lit("type:"), "memo_type", F.lit(":"), sc.normal_name(F.coalesce("content", F.lit("")))))
    x = m.filter(F.col("deleted_at").isNull()).withColumn("dedupe_key", F.md5(F.coalesce(uri, named))).filter(F.col("dedupe_key").isNotNull())
    # the primaries are aggregated first, so a large group is not sorted in one task; only hashes and ids are shuffled for it
    first = x.groupBy("org_id", "dedupe_key").agg(F.min(F.struct("valid_from", "id")).alias("p"), F.count("*").alias("members")).filter("members > 1")
    x = x.join(first, ["org_id", "dedupe_key"]).withColumn("primary_id", F.col("p.id"))
    return x.withColumn("loses", F.col("id") != F.col("primary_id")).drop("p")


def reweight(edges: DataFrame, feedback: DataFrame, d: float = 0.95) -> DataFrame:
    """Edge weights drawn to the mean signal: clamp(w d + (1 - d)(s + 1) / 2)."""
    mean = feedback.groupBy("edge_id").agg(F.avg("signal").alias("signal"), F.count("*").alias("n"))
    return edges.join(mean, edges["id"] == mean["edge_id"]).withColumn("new_weight", sc.clamp01(F.col("weight") * d + F.lit(1 - d) * (F.col("signal") + 1) / 2)).drop("edge_id")


def prune(edges: DataFrame, least: float = 0.05) -> DataFrame:
    return edges.filter(F.col("weight") < least)


def cluster_by_type(m: DataFrame, least: int = 2) -> DataFrame:
    live = m.filter(F.col("memo_type").isNotNull() & (F.col("memo_type") != "SUMMARY") & F.col("deleted_at").isNull())
    return live.groupBy("org_id", "memo_type").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter(F.col("members") >= least)


def cluster_hash(clusters: DataFrame, key: str, member: str) -> DataFrame:
    """sha-256 of each cluster's sorted ids, joined by commas."""
    ids = F.array_sort(F.collect_list(F.col(member).cast("string")))
    return clusters.groupBy(key).agg(F.sha2(F.array_join(ids, ","), 256).alias("cluster_hash"), F.count("*").alias("members"))


def mode_agent(m: DataFrame, key: str) -> DataFrame:
    n = m.groupBy(key, "agent_id").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("agent_id", F.struct("n", (-F.col("agent_id")).alias("a"))).alias("agent_id"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Of each name and type, whatever their case, the entry with the highest confidence, the first on ties; rows (pos, name, type, confidence)."""
    by = W.partitionBy(F.lower("name"), F.lower("type")).orderBy(F.col("confidence").desc(), "pos")
    return entities.withColumn("rn", F.row_number().over(by)).filter("rn = 1").drop("rn")


#: Why a chain of provenance isn't whole, in the order of the checks.
BROKEN = (
    "distill_provenance is NULL (pre-Phase-F Memo or skipped)",
    "distill_provenance is missing correlation_id",
    "no entity_provenance row for this Memo",
    "no matching distill audit entry (chained or pending)",
)


def provenance_verdict(m: DataFrame, provenance: DataFrame, log: DataFrame) -> DataFrame:
    """m with is_valid and reason: its blob distill_provenance, the blob's correlation_id, a provenance row (memo_id), and a
    distill row of the log (chained and pending ones together) with the same correlation_id in its details."""
    p = provenance.select(F.col("memo_id").alias("p_id")).distinct()
    told = log.filter(F.col("operation") == "distill").select(F.col("memory_id").alias("a_id"), F.get_json_object("details", "$.correlation_id").alias("a_cid")).distinct()
    cid = F.get_json_object("distill_provenance", "$.correlation_id")
    x = m.withColumn("cid", cid).join(p, F.col("id") == F.col("p_id"), "left").join(told, (F.col("id") == F.col("a_id")) & (F.col("cid") == F.col("a_cid")), "left")
    reason = F.when(F.col("distill_provenance").isNull(), BROKEN[0]).when(F.coalesce("cid", F.lit("")) == "", BROKEN[1]).when(F.col("p_id").isNull(), BROKEN[2]).when(F.col("a_id").isNull(), BROKEN[3])
    return x.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).drop("cid", "p_id", "a_id", "a_cid")


def ontology_exact(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, uri): case-folded label matches; the first uri on several."""
    n = labels.groupBy(F.lower("label").alias("folded")).agg(F.min("uri").alias("uri"))
    return names.join(n, F.lower("name") == F.col("folded")).select("name", "uri")


def content_hashes(m: DataFrame) -> DataFrame:
    return m.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))


# --- usage, jobs, conversations --------------------------------------------------------------------------------------


def usage(events: DataFrame) -> DataFrame:
    """(org_id, period_day, kind, count) of usage events (org_id, day, kind, amount); nothing for amounts of 0 or less."""
    return events.filter(F.col("amount") > 0).groupBy("org_id", F.col("day").alias("period_day"), "kind").agg(F.sum("amount").alias("count"))


def budget_breaches(used: DataFrame, caps: dict[str, int], since: Column, until: Column) -> DataFrame:
    """(org_id, kind, used, cap) where a month's use reaches a cap above 0."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    x = used.filter(F.col("period_day").between(since, until)).groupBy("org_id", "kind").agg(F.sum("count").alias("used")).withColumn("cap", F.element_at(cap, F.col("kind")))
    return x.filter((F.col("cap") > 0) & (F.col("used") >= F.col("cap")))


def batch_status(jobs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return jobs.groupBy("search_batch_id").agg(n("pending"), n("running"), n("completed"), n("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("updated_at", "id"))), lambda x: x["id"].cast("string")), ",").alias("job_ids"))


def stale_jobs(jobs: DataFrame, now: Column, seconds: int, limit: int) -> DataFrame:
    """Running jobs not heard of for so long, oldest first, as failed; an error that is known already stays."""
    old = jobs.filter((F.col("status") == "running") & (sc.seconds_between(now, F.col("updated_at")) > seconds)).orderBy("updated_at", "id").limit(limit)
    return old.withColumn("status", F.lit("failed")).withColumn("error", F.coalesce(F.col("error"), F.lit("stale")) if "error" in jobs.columns else F.lit("stale"))


def turns(conversations: DataFrame, after: int = 0, limit: int | None = None) -> DataFrame:
    """Turns with turn_index from 1 in each conversation, those after an index, at most limit of each."""
    by = W.partitionBy("conv_id").orderBy("turn")
    x = conversations.withColumn("turn_index", F.row_number().over(by)).filter(F.col("turn_index") > after)
    return x if limit is None else x.filter(F.col("turn_index") <= after + limit)


def needs_summary(conversations: DataFrame) -> DataFrame:
    """Conversations (turn_count, last_summary_turn, summary_cadence) whose turns since the last summary reach the cadence."""
    return conversations.filter(F.col("turn_count") - F.col("last_summary_turn") >= F.col("summary_cadence"))


def rotation(tenants: DataFrame, limit: int) -> DataFrame:
    return tenants.orderBy(F.col("refine_last_run_at").asc_nulls_first(), "org_id").limit(limit)


def usage_window(counters: DataFrame, since: str, until: str) -> DataFrame:
    """A row a tenant: totals of the known kinds, and by_day, a map from day to a map from kind (also an unknown one) to count."""
    if until < since:
        raise ValueError("until must be >= since")
    x = counters.filter(F.col("period_day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    day = x.groupBy("org_id", "period_day", "kind").agg(F.sum("count").alias("count")).groupBy("org_id", "period_day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds"))
    by_day = day.groupBy("org_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period_day", F.map_entries("kinds").alias("kinds"))))).alias("by_day"))
    total = x.groupBy("org_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).cast("long").alias(k) for k in KINDS])
    return total.join(by_day, "org_id")


#: Kinds of use, and the pairs of kind and window in the order in which budgets are checked.
KINDS = ("tokens", "embeddings", "llm_calls", "storage_bytes")
BUDGETS = (("tokens", "daily"), ("tokens", "monthly"), ("llm_calls", "daily"), ("llm_calls", "monthly"), ("embeddings", "daily"), ("embeddings", "monthly"))


def first_breach(counters: DataFrame, budgets: DataFrame, defaults: dict[str, int], today: str) -> DataFrame:
    """(org_id, kind, period, used, cap): each tenant's first budget, in order, whose cap is above 0 and reached.

    budgets: (org_id, name, cap) overrides, names like daily_tokens; one that isn't above 0 falls back to the default."""
    day = F.lit(today).cast("date")
    x = counters.filter(F.col("period_day").between(F.trunc(day, "MM"), day))
    used = x.groupBy("org_id").agg(*[F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.lit(w == "monthly") | (F.col("period_day") == day)), F.col("count"))), F.lit(0)).alias(f"{w}_{k}") for k, w in BUDGETS])
    names = [f"{w}_{k}" for k, w in BUDGETS]
    own = budgets.groupBy("org_id").agg(*[F.max(F.when((F.col("name") == n) & (F.col("cap") > 0), F.col("cap"))).alias(f"cap_{n}") for n in names])
    x = used.join(own, "org_id", "left")
    cap = lambda n: F.coalesce(f"cap_{n}", F.lit(defaults.get(n, 0))).cast("long")
    pairs = F.array(*[F.when((cap(f"{w}_{k}") > 0) & (F.col(f"{w}_{k}") >= cap(f"{w}_{k}")), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("period"), F.col(f"{w}_{k}").cast("long").alias("used"), cap(f"{w}_{k}").alias("cap"))) for k, w in BUDGETS])
    return x.select("org_id", F.get(F.array_compact(pairs), F.lit(0)).alias("b")).filter("b is not null").select("org_id", "b.kind", "b.period", "b.used", "b.cap")


def contents(clusters: DataFrame, key: str) -> DataFrame:
    """Contents of each cluster's members in order of valid_from and id, joined by blank lines; rows (key, id, valid_from, content)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "id", "content"))), lambda x: x["content"])
    return clusters.groupBy(key).agg(F.array_join(texts, "\n\n").alias("contents"))


def fresh_candidates(m: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(focal, candidate) of a tenant's first limit entities (by id), each with the others that no edge leads to from it."""
    some = m.filter(F.col("memo_type").isNotNull() & F.col("deleted_at").isNull()).withColumn("rn", F.row_number().over(W.partitionBy("org_id").orderBy("id"))).filter(F.col("rn") <= limit).select("org_id", "id")
    pairs = some.withColumnRenamed("id", "focal").join(some.withColumnRenamed("id", "candidate"), "org_id").filter("focal <> candidate")  # limit squared rows a tenant
    known = edges.select(F.col("source_memory_id").alias("focal"), F.col("target_memory_id").alias("candidate")).distinct()
    return pairs.join(known, ["focal", "candidate"], "left_anti")


def by_name(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id): the first entity (by pos) of each name, whatever its case; rows name, and (pos, id, name)."""
    first = entities.groupBy(F.lower("name").alias("folded")).agg(F.min_by("id", "pos").alias("id"))
    return names.join(first, F.lower("name") == F.col("folded")).select("name", "id")


def routing_accuracy(decisions: DataFrame) -> DataFrame:
    """(expected, correct, total, accuracy) of decisions (expected, got)."""
    return decisions.groupBy("expected").agg(F.count_if(F.col("expected") == F.col("got")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))
