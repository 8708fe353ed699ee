"""Data-processing pipelines with an injected gateway: ingest (files to memories), forge (memories to a graph), refine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import graph, mutations, refine
from ..operators.cuts import cut
from ..operators.text import token_windows
from ..sources import loaders
from .gateway import Gateway, GatewayError


def ingest(m: DataFrame, files: DataFrame, org, agent, now: Column, dataset=None) -> tuple[DataFrame, DataFrame]:
    """(memories, jobs): files (path, content, and mime_type where known) loaded by their kind and stored as episodic memories.

    A file whose path a current memory of the dataset (or of none) came from is not stored again; a file that can't be
    loaded fails its job; one without text becomes the memory '(empty)'."""
    loaded = cut(loaders.load(files))  # read and parsed once, for all that follows
    same = F.col("dataset_id").eqNullSafe(F.lit(dataset).cast("string")) if "dataset_id" in m.columns else F.lit(dataset is None)
    held = m.filter((F.col("org_id") == F.lit(org)) & F.col("deleted_at").isNull() & same).select(F.get_json_object("metadata", "$.source_uri").alias("h_uri")).distinct()
    x = loaded.join(held, F.col("path") == F.col("h_uri"), "left").withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("h_uri").isNotNull(), "skipped").otherwise("completed"))
    meta = F.to_json(F.struct(F.col("path").alias("source_uri"), F.col("loader").alias("loader")))
    new = x.filter("status = 'completed'").select(F.sha2(F.concat_ws(":", F.lit(str(org)), F.lit(dataset).cast("string"), "path"), 256).alias("id"), F.lit(org).alias("org_id"), F.lit(agent).alias("agent_id"), F.lit("episodic").alias("memory_type"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "(empty)").otherwise(F.col("text")).alias("content"), meta.alias("metadata"), F.lit(dataset).cast("string").alias("dataset_id"))
    jobs = x.select(F.col("path").alias("source_uri"), "status", "error", "loader", now.alias("updated_at"))
    new = new.withColumn("id", F.col("id").cast(dict(m.dtypes)["id"])) if dict(m.dtypes)["id"] == "string" else new.withColumn("id", F.conv(F.substring("id", 1, 15), 16, 10).cast("long"))
    return mutations.store(m, new, now), jobs


def extracted(chunks: DataFrame, gateway: Gateway) -> DataFrame:
    """(id, pos, what, name, type, description, confidence, predicate, target) of the entities and relationships that the gateway finds in chunks (id, chunk_index, text).

    A chunk whose call fails gives one row 'error' and no result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, k, text in zip(f["id"], f["chunk_index"], f["text"], strict=True):
                try:
                    got = gateway.complete("extract", text)
                except Exception as error:
                    rows.append((i, k * 1000, "error", str(error)[:2000], None, None, None, None, None))
                    continue
                for j, e in enumerate(got.get("entities", [])):
                    rows.append((i, k * 1000 + j, "entity", e["name"], e.get("type", "ENTITY"), e.get("description"), float(e.get("confidence", 1.0)), None, None))
                for j, e in enumerate(got.get("relationships", [])):
                    rows.append((i, k * 1000 + j, "edge", e["source"], None, None, float(e.get("confidence", 1.0)), e["predicate"], e["target"]))
                if got.get("summary"):
                    rows.append((i, k * 1000, "summary", got["summary"], None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "pos", "what", "name", "type", "description", "confidence", "predicate", "target"])

    kind = dict(chunks.dtypes)["id"]
    return chunks.select("id", "chunk_index", "text").mapInPandas(run, f"id {kind}, pos long, what string, name string, type string, description string, confidence double, predicate string, target string")


def merged(found: DataFrame) -> DataFrame:
    """Entities once for each name and type, whatever their case: the highest confidence, the first on ties, with the first description that isn't empty; relationships likewise."""
    best = W.partitionBy("id", "what", F.lower("name"), F.lower("type"), F.lower("predicate"), F.lower("target")).orderBy(F.col("confidence").desc(), "pos")
    every = best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = found.filter("what in ('entity', 'edge')").withColumn("rn", F.row_number().over(best))
    x = x.withColumn("description", F.first(F.when(F.col("description") != "", F.col("description")), ignorenulls=True).over(every))
    return x.filter("rn = 1").drop("rn")


#: Partial summaries that one call combines.
FAN_IN = 16


def rolling(chunks: DataFrame, gateway: Gateway, fan_in: int = FAN_IN) -> DataFrame:
    """(id, summary, calls): chunks (id, chunk_index, text) summarised each by a call, and the answers in turns of fan_in a call
    until one is left. Blank chunks and answers, and calls that fail, drop out; a single chunk takes one call. Each turn's answers are kept, so
    that no call is made again."""

    def one(text: str) -> str:
        try:
            return str(gateway.complete("summarise", text).get("summary") or "").strip()
        except GatewayError:
            return ""

    @F.pandas_udf("string")
    def told(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if n == 1 else one(t) for t, n in zip(texts, parts, strict=True)], dtype=object)

    x = chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", F.col("chunk_index").cast("long").alias("at"), told("text", F.lit(0)).alias("text"), F.lit(1).cast("long").alias("calls"))
    while True:
        calls = W.partitionBy("id")
        x = cut(x.withColumn("every", F.sum("calls").over(calls)).filter("text <> ''"))
        x = x.withColumn("at", (F.row_number().over(W.partitionBy("id").orderBy("at")) - 1).cast("long")).withColumn("n", F.count("*").over(calls))
        if x.filter("n > 1").isEmpty():
            return x.select("id", F.col("text").alias("summary"), F.col("every").alias("calls"))
        turn = x.groupBy("id", F.expr(f"at div {fan_in}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"), F.max("every").alias("every"))  # fan_in answers at most
        one = F.size("parts") == 1
        joined = F.when(one, F.get("parts", F.lit(0))["text"]).otherwise(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("- "), p["text"])), "\n\n"))
        first = F.col("block") == 0  # the calls so far are carried by one row
        x = turn.select("id", F.col("block").alias("at"), told(joined, F.size("parts")).alias("text"), (F.when(one, 0).otherwise(1) + F.when(first, F.col("every")).otherwise(0)).cast("long").alias("calls"))


def forge(m: DataFrame, gateway: Gateway, job: str, model: str = "stub", size: int = 1024, overlap: int = 128, summaries: bool = True, done: DataFrame | None = None, breaches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Memories to a graph: chunks, extraction, merge, and what is kept: memos (entities, and a summary a memory), edges between
    them, provenance, audit rows, errors, and jobs: a row a tenant with its status and counts.

    done: memories (id) that the job has distilled already. breaches: (org_id, kind, period, used, cap) as ``refine.first_breach``
    tells them; those tenants' jobs are rejected before any call. The work is a row a chunk, and each call is made once; a
    memory's entities become memos with the id of memory and name."""
    every = m.select("org_id").distinct()
    if done is not None:
        m = m.join(done.select("id"), "id", "left_anti")
    if breaches is not None:
        m = m.join(F.broadcast(breaches.select("org_id")), "org_id", "left_anti")  # a row a tenant; contents aren't dealt by tenant
    chunks = token_windows(m.select("id", F.col("content").alias("text")), size, overlap).select("id", "chunk_index", F.col("chunk").alias("text"))
    found = cut(extracted(chunks, gateway))
    whole = merged(found)
    memo_id = lambda name: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lower(name)), 256)
    owner = m.select(F.col("id").alias("o_id"), "org_id", "agent_id")
    entities = whole.filter("what = 'entity'").join(owner, F.col("id") == F.col("o_id"))
    memos = entities.select(memo_id(F.col("name")).alias("memo_id"), "org_id", "agent_id", F.col("id").alias("source_id"), F.upper("type").alias("memo_type"), sc.entity_content(F.col("name"), F.col("type"), F.col("description")).alias("content"), "confidence")
    known = entities.select(F.col("id").alias("k_id"), F.lower("name").alias("k_name")).distinct()
    edges = whole.filter("what = 'edge'")
    for end in ("name", "target"):  # both ends must be entities of the same memory
        edges = edges.join(known, (F.col("id") == F.col("k_id")) & (F.lower(end) == F.col("k_name")), "left_semi")
    edges = edges.select(F.col("id").alias("source_id"), memo_id(F.col("name")).alias("source_memory_id"), memo_id(F.col("target")).alias("target_memory_id"), sc.safe_label(F.col("predicate")).alias("relationship_type"), F.col("confidence").alias("weight")).filter("source_memory_id <> target_memory_id")
    if summaries:
        # the extraction's own summary, else one of the chunks
        given = found.filter("what = 'summary'").groupBy("id").agg(F.min_by("name", "pos").alias("summary"))
        made = rolling(chunks.join(given.select("id"), "id", "left_anti"), gateway).select("id", "summary")
        told = given.unionByName(made).join(owner, F.col("id") == F.col("o_id"))
        memos = memos.unionByName(told.select(memo_id(F.lit("<summary>")).alias("memo_id"), "org_id", "agent_id", F.col("id").alias("source_id"), F.lit("SUMMARY").alias("memo_type"), F.col("summary").alias("content"), F.lit(1.0).alias("confidence")))
    memos = mutations.stamp_provenance(memos.withColumnRenamed("memo_id", "id"), job, model, F.sha2(F.lit("extract\0" + model), 256))
    provenance = memos.select(F.col("id").alias("memo_id"), "source_id", F.lit(job).alias("job_id"))
    audit = memos.select("org_id", F.lit("distill").alias("operation"), F.col("id").alias("memory_id"), F.to_json(F.struct(F.get_json_object("distill_provenance", "$.correlation_id").alias("correlation_id"))).alias("details"))
    # a tenant's job: its counts, or why it didn't run
    per = lambda df, name: df.join(owner, F.col("id") == F.col("o_id")).groupBy("org_id").agg(F.count("*").alias(name))
    jobs = every.join(m.groupBy("org_id").agg(F.count("*").alias("memories")), "org_id", "left")
    for df, name in ((chunks, "chunks_total"), (found.filter("what = 'error'"), "chunks_failed"), (whole.filter("what = 'entity'"), "entities_extracted"), (whole.filter("what = 'edge'"), "relationships_extracted")):
        jobs = jobs.join(per(df, name), "org_id", "left")
    jobs = jobs.join(memos.groupBy("org_id").agg(F.count("*").alias("memos_written")), "org_id", "left").fillna(0)
    error = F.lit(None).cast("string")
    if breaches is not None:
        why = F.concat("period", F.lit(" "), "kind", F.lit(" budget exceeded: used="), F.col("used").cast("string"), F.lit(" cap="), F.col("cap").cast("string"))
        jobs, error = jobs.join(breaches.select("org_id", why.alias("why")), "org_id", "left"), F.col("why")
    jobs = jobs.withColumn("job_id", F.lit(job)).withColumn("status", F.when(error.isNotNull(), "rejected").otherwise("completed")).withColumn("error", error).drop("why")
    return {"memos": memos, "edges": edges.drop("source_id"), "provenance": provenance, "audit": audit, "errors": found.filter("what = 'error'"), "jobs": jobs}


def summarise(clusters: DataFrame, gateway: Gateway, done: DataFrame | None = None) -> DataFrame:
    """(component, cluster_hash, summary) of clusters (component, id, valid_from, content) by the gateway; clusters whose hash is done already are left out."""
    hashes = refine.cluster_hash(clusters, "component", "id")
    if done is not None:
        hashes = hashes.join(done.select("cluster_hash"), "cluster_hash", "left_anti")
    texts = refine.contents(clusters, "component").join(hashes.select("component", "cluster_hash"), "component")

    @F.pandas_udf("string")
    def told(s: pd.Series) -> pd.Series:
        return s.map(lambda t: str(gateway.complete("summarise", t).get("summary", "")))

    return texts.select("component", "cluster_hash", told("contents").alias("summary"))


#: Entities that a tenant needs for inference, and edges from which on one has enough.
LEAST_ENTITIES, ENOUGH_EDGES = 2, 5


def infer(m: DataFrame, edges: DataFrame, gateway: Gateway, limit: int = 50, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(edges, counters): new edges between a tenant's first limit entities that the gateway proposes, and a row a tenant with
    the entities examined, the calls made, and the edges proposed and written.

    One call an entity, about all others; entities with enough edges aren't asked about. Proposals to what an edge leads to
    already, to the entity itself or to no candidate, and with other relations than those of edges, aren't written."""
    live = m.filter(F.col("memo_type").isNotNull() & F.col("deleted_at").isNull())
    rank = F.row_number().over(W.partitionBy("org_id").orderBy("id"))
    some = live.select("org_id", "id", "memo_type", F.left(F.coalesce("content", F.lit("")), F.lit(80)).alias("name")).withColumn("rn", rank).filter(F.col("rn") <= limit).drop("rn")
    group = some.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "memo_type"))).alias("others"))  # limit of them at most
    out = edges.select(F.col("source_memory_id").alias("id"), "target_memory_id").distinct().join(some.select("id"), "id", "left_semi")
    out = out.groupBy("id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("target_memory_id")), 1, ENOUGH_EDGES).alias("known"))  # only those of fewer are used
    focal = some.join(group, "org_id").join(out, "id", "left").filter((F.size("others") >= LEAST_ENTITIES) & (F.coalesce("n", F.lit(0)) < ENOUGH_EDGES))
    line = lambda e: F.concat(e["id"].cast("string"), F.lit(" | "), e["name"], F.lit(" ("), e["memo_type"], F.lit(")"))
    others = F.filter("others", lambda e: e["id"] != F.col("id"))
    prompt = F.concat(F.lit("Entity: "), "name", F.lit(" ("), "memo_type", F.lit(")\nCandidates:\n"), F.array_join(F.transform(others, line), "\n"))

    @F.pandas_udf("array<struct<target:string,predicate:string,confidence:double>>")
    def proposed(prompts: pd.Series) -> pd.Series:
        def one(prompt: str) -> list:
            try:
                told = gateway.complete("infer", prompt).get("edges", [])
            except GatewayError:
                return []  # the others go on
            return [{"target": str(e.get("target_id")), "predicate": e.get("predicate"), "confidence": float(e.get("confidence", 0.0))} for e in told]

        return prompts.map(one)

    told = cut(focal.select("org_id", "id", "known", F.transform(others, lambda e: e["id"].cast("string")).alias("ids"), proposed(prompt).alias("told")))
    each = told.select("org_id", "id", "known", "ids", F.explode("told").alias("e"))
    right = F.array_contains("ids", F.col("e.target")) & ~F.coalesce(F.array_contains("known", F.col("e.target").try_cast(dict(edges.dtypes)["target_memory_id"])), F.lit(False))
    made = each.withColumn("relationship_type", sc.safe_label(F.col("e.predicate"))).filter(right & F.col("relationship_type").isin(*mutations.RELATIONS) & (F.col("e.confidence") >= least))
    target = F.col("e.target").cast(dict(edges.dtypes)["target_memory_id"])
    made = made.select("org_id", F.col("id").alias("source_memory_id"), target.alias("target_memory_id"), "relationship_type", F.col("e.confidence").alias("weight")).dropDuplicates(["source_memory_id", "target_memory_id"])
    calls = told.groupBy("org_id").agg(F.count("*").alias("calls"), F.sum(F.size("told")).alias("edges_proposed"))
    counters = some.groupBy("org_id").agg(F.count("*").alias("candidates_examined")).join(calls, "org_id", "left").join(made.groupBy("org_id").agg(F.count("*").alias("edges_written")), "org_id", "left").fillna(0)
    return made, counters


def refined(m: DataFrame, edges: DataFrame, feedback: DataFrame, now: Column, gateway: Gateway | None = None, d: float = 0.95, least: float = 0.05) -> dict[str, DataFrame]:
    """One cycle: duplicates merged, edges inferred, clusters summarised, weights drawn to feedback, weak edges pruned.

    Returns memories, edges, summaries (None without a gateway) and the stages' counters."""
    grouped = refine.dedupe_groups(m)
    after = mutations.merge_losers(m, grouped, now)
    more = infer(after, edges, gateway)[0] if gateway else None
    heavier = refine.reweight(edges, feedback, d)
    every = edges.join(heavier.select(F.col("id").alias("h_id"), "new_weight"), F.col("id") == F.col("h_id"), "left").withColumn("weight", F.coalesce("new_weight", "weight")).drop("h_id", "new_weight")
    kept = every.filter(F.col("weight") >= least)
    summaries = None
    if gateway:
        live = after.filter(F.col("deleted_at").isNull() & F.col("memo_type").isNotNull()).select("id", "valid_from", "content")
        clusters = graph.components(kept).join(live, "id")
        summaries = summarise(clusters, gateway)
    counters = (
        grouped.agg(F.count_if("loses").alias("n")).select(F.lit("deduped").alias("stage"), "n")
        .union(heavier.agg(F.count("*").alias("n")).select(F.lit("reweighted"), "n"))
        .union(every.agg(F.count_if(F.col("weight") < least).alias("n")).select(F.lit("pruned"), "n"))
    )
    return {"memories": after, "edges": kept if more is None else kept.unionByName(more, allowMissingColumns=True), "summaries": summaries, "counters": counters}
