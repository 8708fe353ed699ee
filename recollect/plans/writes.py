"""Registered queries of the write path, the recall dispatcher and the pipelines, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import cypher, gateway, pipelines
from ..engine import recall as rc
from ..functions import ed25519, jsons
from ..functions import scalar as sc
from ..operators import codegraph, graph, memory, mutations, proof, refine, text
from ..operators.cuts import shared_folder
from ..sources import loaders, snapshots, turtle
from . import tables as t
from .catalog import DEDUPE, FUSED, LIVE, MERKLE_SQL, SIM, _probe, _valid, query, r6
from .tables import with_tables

# --- writes ----------------------------------------------------------------------------------------------------------


@query(with_tables("SELECT id, org_id, memory_type, importance_score, recall_count, created_at FROM memories UNION ALL SELECT doc_id + 1000000, doc_id % 4, 'episodic', CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END, 0, TIMESTAMP '2024-02-01' FROM documents WHERE doc_id % 10 = 3 AND trim(text) <> ''", "memories"))
def store_memories(spark, sf):
    m = t.memories(spark, sf)
    rows = t.read(spark, sf, "documents").filter("doc_id % 10 = 3 and trim(text) <> ''").select((F.col("doc_id") + 1_000_000).alias("id"), (F.col("doc_id") % 4).alias("org_id"), F.lit(0).cast("long").alias("agent_id"), F.col("text").alias("content"), F.lit("episodic").alias("memory_type"), F.when(F.col("doc_id") % 2 == 1, F.lit(0.9)).alias("importance_score"))
    return mutations.store(m, rows, t.now()).select("id", "org_id", "memory_type", "importance_score", "recall_count", "created_at")


def _history(spark, sf) -> DataFrame:
    m = t.memories(spark, sf)
    return m.withColumn("valid_from", F.col("created_at")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


@query(with_tables("SELECT org_id, count(*) + count(*) FILTER (WHERE org_id = 2 AND id % 3 = 0 AND deleted_at IS NULL) AS versions, round(sum(importance_score) + coalesce(sum(importance_score / 2) FILTER (WHERE org_id = 2 AND id % 3 = 0 AND deleted_at IS NULL), 0), 6) AS importance, org_id <> 2 AS files_stay FROM memories WHERE org_id <> 3 AND (importance_score > 0 OR id % 3 > 0 OR org_id <> 2 OR deleted_at IS NOT NULL) GROUP BY 1", "memories"))
def tenant_update(spark, sf):
    """A table in a folder a tenant: two tenants' changes leave the files of the others. A third of tenant 2 get half their
    importance (where it isn't 0, as a version of their own), tenant 3 is forgotten."""
    path = f"{shared_folder(spark)}/tenants-{uuid.uuid4().hex}"
    snapshots.create(_history(spark, sf).filter("importance_score > 0 or id % 3 > 0 or org_id <> 2 or deleted_at is not null"), path)
    lies = lambda: {(r.org_id, r.f) for r in spark.read.parquet(path).select("org_id", F.input_file_name().alias("f")).distinct().collect()}
    before, now = lies(), t.now()
    halved = spark.read.parquet(path).filter("org_id = 2 and id % 3 = 0 and deleted_at is null").select(F.col("org_id").cast("long").alias("org_id"), "id", (F.col("importance_score") / 2).alias("importance_score"))
    snapshots.update(spark, path, halved, now)
    snapshots.forget(spark, path, spark.read.parquet(path).filter("org_id = 3").select("org_id", "id"))
    after = lies()
    kept = F.col("org_id").isin(sorted({o for o, _ in after} - {o for o, _ in after ^ before}))
    got = spark.read.parquet(path).groupBy(F.col("org_id").cast("long").alias("org_id")).agg(F.count("*").alias("versions"), r6(F.sum("importance_score"), "importance"))
    return got.withColumn("files_stay", kept)


UPDATED = """h AS (SELECT *, created_at AS valid_from, NULL::TIMESTAMP AS valid_to FROM memories), u AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'new text ' || id ELSE content END AS new_content, CASE WHEN id % 3 = 1 THEN '{"v":2}' ELSE metadata END AS new_metadata FROM h WHERE id % 6 < 4 AND deleted_at IS NULL),
d AS (SELECT h.*, u.new_content, u.new_metadata, u.id IS NOT NULL AND (new_content IS DISTINCT FROM content OR new_metadata IS DISTINCT FROM metadata) AS versioned FROM h LEFT JOIN u ON u.id = h.id)"""


@query(with_tables("SELECT id, md5(content) AS content_md5, metadata, valid_from, CASE WHEN versioned THEN TIMESTAMP '2024-02-01' END AS valid_to FROM d UNION ALL SELECT id, md5(new_content), new_metadata, TIMESTAMP '2024-02-01', NULL FROM d WHERE versioned", "memories", more=UPDATED))
def update_memories(spark, sf):
    h = _history(spark, sf)
    u = h.filter("id % 6 < 4").select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("new text "), F.col("id").cast("string"))).alias("content"), F.when(F.col("id") % 3 == 1, F.lit('{"v":2}')).alias("metadata")).filter("content is not null or metadata is not null")
    return mutations.update(h, u, t.now()).select("id", F.md5("content").alias("content_md5"), "metadata", "valid_from", "valid_to")


@query(with_tables("SELECT id, memory_type, valid_to IS NULL AS current FROM (SELECT id, memory_type, CASE WHEN id % 7 = 2 AND deleted_at IS NULL AND memory_type <> 'procedural' THEN TIMESTAMP '2024-02-01' END AS valid_to FROM memories UNION ALL SELECT id, 'procedural', NULL FROM memories WHERE id % 7 = 2 AND deleted_at IS NULL AND memory_type <> 'procedural')", "memories"))
def transition_type(spark, sf):
    h = _history(spark, sf)
    return mutations.transition(h, h.filter("id % 7 = 2").select("id"), "procedural", t.now()).select("id", "memory_type", F.col("valid_to").isNull().alias("current"))


@query(with_tables("SELECT org_id, period_day, kind, sum(n)::BIGINT AS count FROM (SELECT org_id, day AS period_day, kind, amount AS n FROM usage WHERE amount > 0 UNION ALL SELECT org_id, DATE '2024-01-05', 'tokens', amount FROM usage WHERE amount > 0 AND day = DATE '2024-01-06') GROUP BY ALL", "usage"))
def usage_upsert(spark, sf):
    u = t.usage(spark, sf)
    rows = u.filter("day = date'2024-01-06'").select("org_id", F.lit("2024-01-05").cast("date").alias("period_day"), F.lit("tokens").alias("kind"), F.col("amount").alias("count"))
    return mutations.upsert_sum(refine.usage(u), rows, ["org_id", "period_day", "kind"], "count")


@query(with_tables("SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 3 = 1 THEN 'boom' END AS error FROM jobs", "jobs"))
def patch_jobs(spark, sf):
    j = t.jobs(spark, sf).withColumn("error", F.lit(None).cast("string"))
    return mutations.patched(j, j.select("id", F.when(F.col("id") % 3 == 0, F.lit("completed")).alias("status"), F.when(F.col("id") % 3 == 1, F.lit("boom")).alias("error"))).select("id", "status", "error")


@query("SELECT conv_id AS id, count(*)::BIGINT + CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END AS turn_count, greatest(floor(count(*) / 2), CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 0 END)::BIGINT AS last_summary_turn FROM conversations GROUP BY conv_id")
def conversation_add_and_mark(spark, sf):
    c = t.conversations(spark, sf)
    more = c.filter("id % 2 = 0").select(F.col("id").alias("conv_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), F.lit("user").alias("role"))
    raised, _ = mutations.add_turns(c, more)
    return mutations.mark_summary(raised, c.filter("id % 3 = 0").select("id", F.lit(4).cast("long").alias("turn"))).select("id", "turn_count", "last_summary_turn")


@query("SELECT conv_id, role, turn_index FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM conversations) WHERE turn_index > 2 AND turn_index <= 5")
def conversation_page(spark, sf):
    return refine.turns(t.read(spark, sf, "conversations"), after=2, limit=3).select("conv_id", "role", F.col("turn_index").cast("long").alias("turn_index"))


@query(with_tables("SELECT 'node' AS what, id AS a, NULL::BIGINT AS b, memory_type AS label, left(content, 200) AS preview FROM memories WHERE deleted_at IS NULL UNION ALL SELECT 'edge', source_memory_id, target_memory_id, relationship_type, NULL FROM edges WHERE source_memory_id IN (SELECT id FROM memories WHERE deleted_at IS NULL) AND target_memory_id IN (SELECT id FROM memories WHERE deleted_at IS NULL)", "memories", "edges"))
def graph_mirror(spark, sf):
    nodes, edges = mutations.mirror(t.memories(spark, sf), t.edges(spark, sf))
    one = nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("memory_type").alias("label"), "preview")
    return one.union(edges.select(F.lit("edge"), "src", "dst", "label", F.lit(None).cast("string")))


@query("SELECT CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS signal, count(*) AS n FROM events WHERE event_type IN ('purchase', 'click', 'error') GROUP BY 1")
def feedback_insert(spark, sf):
    e = t.read(spark, sf, "events").filter("event_type in ('purchase', 'click', 'error')")
    rows = e.select(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("memory_id"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("edge_id"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("signal"))
    return mutations.add_feedback(rows.limit(0), rows).groupBy("signal").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS org_id, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS refine_last_run_at FROM nation")
def refine_dispatch_mark(spark, sf):
    x = t.read(spark, sf, "nation").select(F.col("n_nationkey").alias("org_id"), F.lit(None).cast("timestamp_ntz").alias("refine_last_run_at"))
    return mutations.mark_dispatched(x, x.filter("org_id % 3 = 0"), None, t.now())


@query("SELECT doc_id AS id, sha256('job-1:' || doc_id) AS correlation_id FROM documents")
def provenance_stamp(spark, sf):
    m = mutations.stamp_provenance(t.memories(spark, sf), "job-1", "stub", F.lit("h"))
    return m.select("id", F.get_json_object("distill_provenance", "$.correlation_id").alias("correlation_id"))


@query(with_tables("SELECT v.id, CASE WHEN g.id <> g.primary_id THEN TIMESTAMP '2024-02-01' ELSE v.deleted_at END AS deleted_at, coalesce(l.merged, '') AS merged FROM v LEFT JOIN g ON g.id = v.id LEFT JOIN (SELECT primary_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS merged FROM g WHERE id <> primary_id GROUP BY 1) l ON l.primary_id = v.id", "memories", more=DEDUPE))
def dedupe_merge(spark, sf):
    m = _valid(spark, sf)
    got = mutations.merge_losers(m, refine.dedupe_groups(m), t.now())
    merged = F.regexp_replace(F.coalesce(F.get_json_object("metadata", "$.refine.merged_from"), F.lit("")), r"[\[\] ]", "")
    return got.select("id", "deleted_at", merged.alias("merged"))


def _sourced(spark, sf) -> DataFrame:
    """Memories with nested metadata, a dataset for some, and the URI that they came from."""
    i = F.col("id")
    meta = F.concat(F.lit('{"source_uri":"u'), (i % 9).cast("string"), F.lit('","a":{"b":'), (i % 3).cast("string"), F.lit(',"c":[1,'), (i % 4).cast("string"), F.lit(']},"on":'), F.when(i % 2 == 0, "true").otherwise("false"), F.when(i % 5 == 0, F.lit(',"codegraph_kind":null')).otherwise(""), F.lit("}"))
    return t.memories(spark, sf).withColumn("metadata", meta).withColumn("dataset_id", F.when(i % 3 > 0, (i % 3).cast("string")))


@query(with_tables("SELECT id FROM memories WHERE id % 3 = 1 AND (id % 4 = 2 OR id % 4 = 1) AND id % 2 = 0", "memories"))
def json_containment(spark, sf):
    """Objects and arrays at any depth, and a boolean: id % 4 = 2 or the 1 that all lists hold."""
    m = _sourced(spark, sf).filter("id % 4 in (1, 2)")
    return m.filter(jsons.contains(F.col("metadata"), {"a": {"b": 1, "c": [1]}, "on": True})).select("id")


@query(with_tables("SELECT id, CASE id % 4 WHEN 1 THEN 'number' ELSE 'text' END AS held FROM memories WHERE org_id IN (1, 2) AND deleted_at IS NULL", "memories"))
def json_containment_types(spark, sf):
    """Of {"v": [1, 2]}, {"v": 1}, {"v": "1"} and {"v": {"v": 1}} (by id), {"v": 1} and {"v": "1"} hold in one each."""
    i = F.col("id") % 4
    meta = F.when(i == 0, '{"v":[1,2]}').when(i == 1, '{"v":1}').when(i == 2, '{"v":"1"}').otherwise('{"v":{"v":1}}')
    m = t.memories(spark, sf).withColumn("metadata", meta)
    found = [memory.scan(m, org, metadata={"v": v}).select("id", F.lit(held).alias("held")) for v, held in ((1, "number"), ("1", "text")) for org in range(4)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query(with_tables("SELECT id FROM memories WHERE id % 5 = 0", "memories"))
def json_key_exists(spark, sf):
    """A key with a null value is there."""
    return _sourced(spark, sf).filter(jsons.has_key(F.col("metadata"), "codegraph_kind")).select("id")


@query("SELECT doc_id AS id, '{\"a\":1,\"k\":' || (doc_id % 7) || '}' AS metadata FROM documents")
def json_merge(spark, sf):
    m = t.memories(spark, sf).select("id")
    return m.select("id", jsons.merged(F.lit('{"a":1,"k":0}'), F.concat(F.lit('{"k":'), (F.col("id") % 7).cast("string"), F.lit("}"))).alias("metadata"))


@query(with_tables("SELECT CASE WHEN id % 3 > 0 THEN 'some' ELSE 'none' END AS scope, count(*) AS n FROM memories WHERE id % 3 <> 2 GROUP BY 1", "memories"))
def dataset_scope(spark, sf):
    m = _sourced(spark, sf)
    count = lambda d, name: mutations.in_dataset(m, d).agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
    return count(None, "none").union(count("1", "some"))


@query(with_tables("SELECT id FROM memories WHERE id % 9 = 4 AND id % 3 = 1 AND deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 1", "memories"))
def find_by_source_uri(spark, sf):
    return mutations.by_source_uri(_sourced(spark, sf), "u4", "1").select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'name' || doc_id || ' (T) — d' ELSE 'name' || doc_id || ' (T)' END AS content, CASE WHEN doc_id % 2 = 0 THEN 'is_a_kind_of' ELSE 'related_to' END AS label, 'x' || (doc_id % 10) AS local, '[' || doc_id || ',' || (doc_id + 1) || ']' AS vec, TIMESTAMP '2024-01-05 10:00:00' AS at FROM documents")
def text_formats(spark, sf):
    """Entity contents, safe labels, local names, vector literals and ISO times."""
    i = F.col("id")
    return t.memories(spark, sf).select(
        "id", sc.entity_content(F.concat(F.lit("name"), i.cast("string")), F.lit("T"), F.when(i % 3 == 0, F.lit("d"))).alias("content"),
        sc.safe_label(F.when(i % 2 == 0, F.lit(" Is-a kind/of!")).otherwise(F.lit("??"))).alias("label"),
        sc.local_name(F.concat(F.when(i % 2 == 0, F.lit("http://a/b#x")).otherwise(F.lit("http://a/b/x")), (i % 10).cast("string"))).alias("local"),
        sc.vector_literal(F.array(i, i + 1)).alias("vec"), sc.iso_timestamp(F.when(i % 2 == 0, F.lit("2024-01-05T10:00:00Z")).otherwise(F.lit("2024-01-05T12:00:00+02:00"))).cast("timestamp_ntz").alias("at"),
    )


# --- refinement ------------------------------------------------------------------------------------------------------


@query(with_tables("SELECT f.id AS focal, c.id AS candidate FROM s f JOIN s c ON f.org_id = c.org_id AND f.id <> c.id WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_memory_id = f.id AND e.target_memory_id = c.id)", "memories", "edges", more="s AS (SELECT org_id, id FROM (SELECT org_id, id, row_number() OVER (PARTITION BY org_id ORDER BY id) AS rn FROM memories WHERE memo_type IS NOT NULL AND deleted_at IS NULL) WHERE rn <= 12)"))
def infer_candidates(spark, sf):
    return refine.fresh_candidates(t.memories(spark, sf), t.edges(spark, sf), 12).select("focal", "candidate")


@query(with_tables("SELECT r.component, md5(string_agg(m.content, chr(10) || chr(10) ORDER BY m.created_at, m.id)) AS contents_md5 FROM cc r JOIN memories m ON m.id = r.id GROUP BY 1", "memories", "edges", recursive=True, more="s AS (SELECT source_memory_id AS src, target_memory_id AS dst FROM edges WHERE weight >= 0.9 UNION SELECT target_memory_id, source_memory_id FROM edges WHERE weight >= 0.9), r AS (SELECT src AS id, src AS seen FROM s UNION SELECT r.id, s.dst FROM r JOIN s ON s.src = r.seen), cc AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)"))
def cluster_contents(spark, sf):
    m = t.memories(spark, sf).select("id", F.col("created_at").alias("valid_from"), "content")
    return refine.contents(graph.components(t.edges(spark, sf).filter("weight >= 0.9")).join(m, "id"), "component").select("component", F.md5("contents").alias("contents_md5"))


@query("SELECT lower(n_name) AS name, min_by(n_nationkey, n_nationkey) AS id FROM nation GROUP BY 1")
def lookup_by_name(spark, sf):
    n = t.read(spark, sf, "nation")
    return refine.by_name(n.select(F.lower("n_name").alias("name")).distinct(), n.select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("SELECT event_type AS expected, count(*) FILTER (WHERE event_id % 4 > 0) AS correct, count(*) AS total, round(count(*) FILTER (WHERE event_id % 4 > 0) / count(*), 6) AS accuracy FROM events GROUP BY 1")
def routing_accuracy(spark, sf):
    e = t.read(spark, sf, "events").select(F.col("event_type").alias("expected"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise("none").alias("got"))
    return refine.routing_accuracy(e).withColumn("accuracy", F.round("accuracy", 6))


CERT = MERKLE_SQL.replace("SELECT c_nationkey AS k, sha256(concat(c_custkey, ':', sha256(c_name), ':-')) AS h FROM customer", "SELECT org_id AS k, sha256(concat(id, ':', sha256(coalesce(content, '')), ':-')) AS h FROM memories WHERE id % 10 = 3") + f""",
roots AS ({' UNION ALL '.join(f'SELECT k AS org_id, h FROM m{n} WHERE size = 1' for n in range(13))}),
ids AS (SELECT org_id, count(*) AS leaves, string_agg('"' || id || '"', ',' ORDER BY id::VARCHAR) AS ids FROM memories WHERE id % 10 = 3 GROUP BY 1),
seqs AS (SELECT org_id, min(id) AS a, max(id) AS b FROM log WHERE operation = 'forget' AND (org_id, memory_id) IN (SELECT org_id, id FROM memories WHERE id % 10 = 3) GROUP BY 1)"""


@query(with_tables("""SELECT org_id, leaves, a AS audit_seq_start, b AS audit_seq_end, true AS ok, '{"audit_seq_end":' || coalesce(b::VARCHAR, 'null') || ',"audit_seq_start":' || coalesce(a::VARCHAR, 'null') || ',"cert_id":"cert-' || org_id || '","hard_delete":false,"memory_ids":[' || ids || '],"merkle_root":"' || base64(unhex(h)) || '","org_id":"' || org_id || '","signed_at":"2024-02-01T00:00:00+00:00","signer_key_id":"key-1"}' AS payload FROM ids JOIN roots USING (org_id) LEFT JOIN seqs USING (org_id)""", "memories", "log", more=CERT))
def forget_certificates(spark, sf):
    """Signed with an Ed25519 key, checked with its public half; the payloads are those of SQL, byte by byte."""
    secret = bytes(range(32))
    gone = t.memories(spark, sf).filter("id % 10 = 3")
    certs = proof.certificates(gone, "cert", "key-1", "2024-02-01T00:00:00+00:00", sign=proof.signer(secret), log=t.log(spark, sf))
    return proof.verified(certs, proof.checker(ed25519.public_key(secret))).select("org_id", "leaves", "audit_seq_start", "audit_seq_end", "ok", "payload")


@query(with_tables("SELECT m.id, count(*) AS n FROM memories m JOIN (SELECT source_memory_id AS a, target_memory_id AS b FROM edges WHERE relationship_type = 'contradicts' UNION SELECT target_memory_id, source_memory_id FROM edges WHERE relationship_type = 'contradicts') c ON c.a = m.id GROUP BY 1", "memories", "edges"))
def contradiction_counts(spark, sf):
    return graph.contradiction_counts(t.edges(spark, sf))


@query(with_tables("SELECT DISTINCT c.dst AS id FROM (SELECT source_memory_id AS src, target_memory_id AS dst FROM edges UNION SELECT target_memory_id, source_memory_id FROM edges) c JOIN memories m ON m.id = c.src WHERE m.memo_type = 'ORG' AND m.org_id = 1 AND c.dst IN (SELECT id FROM memories WHERE deleted_at IS NULL)", "memories", "edges"))
def concept_recall(spark, sf):
    m = t.memories(spark, sf)
    return graph.concept_recall(m, t.edges(spark, sf), m.filter("memo_type = 'ORG' and org_id = 1").select("id"))


@query(with_tables("SELECT e.id, e.source_memory_id, e.target_memory_id FROM edges e JOIN memories a ON a.id = e.source_memory_id JOIN memories b ON b.id = e.target_memory_id WHERE a.agent_id = 1 AND b.agent_id = 1 AND a.created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND b.created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'", "memories", "edges"))
def session_subgraph(spark, sf):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-20"))
    inside = t.memories(spark, sf).filter((F.col("agent_id") == 1) & F.col("created_at").between(a, b))
    return graph.subgraph(t.edges(spark, sf), inside.select("id")).select("id", "source_memory_id", "target_memory_id")


@query(with_tables("SELECT e.id FROM edges e WHERE e.source_memory_id IN (SELECT id FROM v) AND e.target_memory_id IN (SELECT id FROM v)", "versions", "edges", more="v AS (SELECT id FROM versions WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') AND deleted_at IS NULL)"))
def graph_snapshot(spark, sf):
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    live = t.versions(spark, sf).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)) & F.col("deleted_at").isNull())
    return graph.subgraph(t.edges(spark, sf), live.select("id")).select("id")


# --- the dispatcher --------------------------------------------------------------------------------------------------


def _engine(spark, sf, **options) -> rc.Engine:
    return rc.Engine(t.memories(spark, sf), t.edges(spark, sf), t.now(), **options)


RULES = [("like", {"strategy": "GRAPH"}), ("when", {"strategy": "TEMPORAL", "timestamp": "2024-01-10T00:00:00Z"}), ("how many", {"strategy": "ASK", "cypher": "MATCH (a)-[r:supports]->(b) RETURN count(*)"})]


@query(with_tables(f"SELECT id, round({FUSED}, 6) AS relevance_score FROM (SELECT *, {SIM} AS sim FROM memories WHERE org_id = 0 AND agent_id = 1 AND {LIVE} AND embedding IS NOT NULL ORDER BY sim DESC, id LIMIT 8) WHERE sim >= 0", "memories"))
def recall_auto(spark, sf):
    """AUTO: the stub model names no strategy, so it is VECTOR."""
    rows, _ = _engine(spark, sf, gateway=gateway.StubGateway(RULES)).recall(rc.Request(0, "anything", _probe(spark, sf), agent=1, top_k=8))
    return rows.select("id", r6("relevance_score"))


@query(with_tables("SELECT 0::BIGINT AS id, count(*)::DOUBLE AS aggregate, 1.0::DOUBLE AS relevance_score FROM edges WHERE org_id = 1 AND relationship_type = 'supports' AND source_memory_id IN (SELECT id FROM memories WHERE deleted_at IS NULL) AND target_memory_id IN (SELECT id FROM memories WHERE deleted_at IS NULL)", "memories", "edges"))
def recall_ask(spark, sf):
    rows, _ = _engine(spark, sf, gateway=gateway.StubGateway(RULES)).recall(rc.Request(1, "how many supports?"))
    return rows.select("id", "aggregate", "relevance_score")


CYPHER = "MATCH (a)-[:related_to]->(b) WHERE a.memory_type <> 'working' AND b.memory_type = 'semantic' RETURN DISTINCT b.id LIMIT 7"


@query(with_tables("SELECT id, round(1.0::DOUBLE / row_number() OVER (ORDER BY id), 4) AS relevance_score FROM (SELECT DISTINCT b.id FROM edges e JOIN memories a ON a.id = e.source_memory_id JOIN memories b ON b.id = e.target_memory_id WHERE e.org_id = 2 AND e.relationship_type = 'related_to' AND a.memory_type <> 'working' AND b.memory_type = 'semantic' AND a.deleted_at IS NULL AND b.deleted_at IS NULL ORDER BY 1 LIMIT 7)", "memories", "edges"))
def recall_cypher(spark, sf):
    rows, _ = _engine(spark, sf, allow_cypher=True).recall(rc.Request(2, strategy="CYPHER", extra={"raw_cypher": CYPHER}))
    return rows.select("id", "relevance_score")


#: Edges between memories that are there (memory 0 counts as it), in both directions, each with its id; trails take no edge twice.
WALK = "l AS (SELECT id FROM memories WHERE deleted_at IS NULL OR id = 0), e AS (SELECT id, source_memory_id AS src, target_memory_id AS dst FROM edges WHERE source_memory_id IN (SELECT id FROM l) AND target_memory_id IN (SELECT id FROM l)), b AS (SELECT * FROM e UNION ALL SELECT id, dst, src FROM e), p AS (SELECT src AS start, dst AS value FROM b UNION ALL SELECT x.src, y.dst FROM b x JOIN b y ON y.src = x.dst AND y.id <> x.id)"


def _walked(spark, sf, query: str) -> DataFrame:
    m = t.memories(spark, sf).withColumn("deleted_at", F.when(F.col("id") > 0, F.col("deleted_at")))
    return cypher.run(query, *mutations.mirror(m, t.edges(spark, sf)), 100_000)


@query(with_tables("SELECT DISTINCT value FROM p WHERE start = 0", "memories", "edges", more=WALK))
def cypher_walk(spark, sf):
    """Both directions, one or two hops from memory 0 (which counts as there)."""
    return _walked(spark, sf, "MATCH (a)-[*1..2]-(b) WHERE a.id = 0 RETURN DISTINCT b.id")


@query(with_tables("SELECT count(*)::DOUBLE AS value FROM p", "memories", "edges", more=WALK))
def cypher_path_count(spark, sf):
    """All paths of one or two edges, those with the same ends too."""
    return _walked(spark, sf, "MATCH (a:Memory)-[*1..2]-(b) RETURN count(*)")


@query(with_tables("SELECT b.id AS value, a.memory_type AS value2 FROM e JOIN memories a ON a.id = e.src JOIN memories b ON b.id = e.dst WHERE b.memory_type = 'semantic' ORDER BY a.memory_type DESC, b.id DESC, a.id LIMIT 9", "memories", "edges", more=WALK))
def cypher_ordered(spark, sf):
    """Two items, by a type from the last on, then by ids from the greatest on."""
    return _walked(spark, sf, "MATCH (a:Memory)-->(b:Memory) WHERE b.memory_type = 'semantic' RETURN b.id, a.memory_type ORDER BY a.memory_type DESC, b.id DESC LIMIT 9")


@query(with_tables(f"SELECT id, round({FUSED}, 6) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY sim DESC, id) AS rn FROM (SELECT *, {SIM} AS sim FROM memories WHERE org_id = 1 AND {LIVE} AND memory_type = 'procedural' AND embedding IS NOT NULL)) WHERE rn <= 5 ORDER BY {FUSED} DESC, id LIMIT 5", "memories"))
def recall_tier_routed(spark, sf):
    rows, _ = _engine(spark, sf).recall(rc.Request(1, "how do I reset it", _probe(spark, sf), strategy="VECTOR", tier_route=True, top_k=5))
    return rows.select("id", r6("relevance_score"))


@query(with_tables("SELECT id, round(0.7::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - hop::DOUBLE / 3.0::DOUBLE) + 0.3::DOUBLE * importance_score, 6) AS relevance_score FROM (SELECT m.id, m.importance_score, min(c.hop) AS hop FROM cw c JOIN memories m ON m.id = c.id WHERE m.org_id = 2 AND m.deleted_at IS NULL GROUP BY 1, 2 ORDER BY 3, 2 DESC, 1 LIMIT 10)", "memories", "edges", recursive=True, more="bb AS (SELECT DISTINCT source_memory_id AS src, target_memory_id AS dst FROM edges WHERE org_id = 2 UNION SELECT target_memory_id, source_memory_id FROM edges WHERE org_id = 2), seeds AS (SELECT id FROM memories WHERE org_id = 2 AND deleted_at IS NULL AND memo_type LIKE 'CODE_%' AND contains(lower(content), 'tion') ORDER BY importance_score DESC, id LIMIT 10), cw AS (SELECT id, 0 AS hop FROM seeds UNION SELECT bb.dst, cw.hop + 1 FROM cw JOIN bb ON bb.src = cw.id WHERE cw.hop < 2)"))
def recall_code(spark, sf):
    rows, _ = _engine(spark, sf).recall(rc.Request(2, "TION", strategy="CODE"))
    return rows.select("id", r6("relevance_score"))


@query(with_tables("SELECT id, max(version) AS memo_version FROM (SELECT m.id FROM memories m WHERE org_id = 0 AND deleted_at IS NULL AND created_at <= TIMESTAMP '2024-01-10' ORDER BY importance_score DESC, created_at DESC, id LIMIT 10) x LEFT JOIN mv ON mv.memo_id = x.id AND mv.valid_from <= TIMESTAMP '2024-01-10' AND (mv.valid_to IS NULL OR mv.valid_to > TIMESTAMP '2024-01-10') GROUP BY 1", "versions", "memories", more="mv AS (SELECT id AS memo_id, row_number() OVER w AS version, valid_from, lead(valid_from) OVER w AS valid_to FROM versions WINDOW w AS (PARTITION BY id ORDER BY valid_from))"))
def recall_temporal(spark, sf):
    """The time comes from the stub model's answer; no embedding, so the fallback's order."""
    m = _history(spark, sf)
    e = rc.Engine(m, t.edges(spark, sf), t.now(), gateway=gateway.StubGateway(RULES), versions=memory.memo_versions(t.versions(spark, sf)))
    rows, _ = e.recall(rc.Request(0, "when was it?"))
    return rows.select("id", F.col("memo_version").cast("long").alias("memo_version"))


# --- pipelines -------------------------------------------------------------------------------------------------------


def _files(spark, sf) -> DataFrame:
    d = t.read(spark, sf, "documents").filter("text is not null")
    kind = F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "md").otherwise("py")
    return d.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("SELECT '/d/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' ELSE '.py' END AS path, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' ELSE 'code' END AS loader, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def load_files(spark, sf):
    return loaders.load(_files(spark, sf)).select("path", "loader", F.md5("text").alias("text_md5"))


@query("SELECT CASE WHEN doc_id % 5 = 0 AND doc_id % 17 > 0 AND doc_id % 2 = 0 THEN 'skipped' ELSE 'completed' END AS status, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def ingest_pipeline(spark, sf):
    """Every fifth file came in before: some of those memories were deleted, and odd ones are another dataset's, so their files come in again."""
    files = _files(spark, sf)
    ext = F.when(F.col("id") % 3 == 0, "txt").when(F.col("id") % 3 == 1, "md").otherwise("py")
    m = t.memories(spark, sf).withColumn("org_id", F.lit(9).cast("long")).filter("id % 5 = 0")
    m = m.withColumn("metadata", F.concat(F.lit('{"source_uri":"/d/'), F.col("id").cast("string"), F.lit("."), ext, F.lit('"}')))
    m = m.withColumn("dataset_id", F.when(F.col("id") % 2 == 0, "d1").otherwise("d2"))
    return pipelines.ingest(m, files, 9, 1, t.now(), "d1")[1].groupBy("status").agg(F.count("*").alias("n"))


STUB = gateway.StubGateway([("tion", {"entities": [{"name": "Nation", "type": "place", "confidence": 0.4}, {"name": "nation", "type": "place", "description": "a land", "confidence": 0.9}, {"name": "Ruler", "type": "person"}], "relationships": [{"source": "Ruler", "predicate": "rules over", "target": "Nation"}, {"source": "Ruler", "predicate": "knows", "target": "Nobody"}]})], {"entities": [], "relationships": []})


@query(with_tables("SELECT 'memo' AS what, memo AS name, count(*) AS n FROM x CROSS JOIN (VALUES ('nation (place) — a land'), ('Ruler (person)')) v(memo) GROUP BY 2 UNION ALL SELECT 'edge', 'rules_over', count(*) FROM x", "memories", more="x AS (SELECT id FROM memories WHERE org_id = 3 AND contains(lower(content), 'tion'))"))
def forge_pipeline(spark, sf):
    """Entities and edges of the stub's extraction; one chunk a memory here, so each counts once."""
    m = t.memories(spark, sf).filter("org_id = 3")
    got = pipelines.forge(m, STUB, "job-1", size=10_000_000)
    memos = got["memos"].groupBy("content").agg(F.count("*").alias("n")).select(F.lit("memo").alias("what"), F.col("content").alias("name"), "n")
    return memos.union(got["edges"].groupBy("relationship_type").agg(F.count("*").alias("n")).select(F.lit("edge"), "relationship_type", "n"))


@query(with_tables("SELECT 'deduped' AS stage, count(*) AS n FROM g WHERE id <> primary_id UNION ALL SELECT 'reweighted', count(DISTINCT e.id) FROM edges e JOIN log l ON l.id = e.id UNION ALL SELECT 'pruned', count(*) FROM (SELECT CASE WHEN l.id IS NULL THEN e.weight ELSE greatest(0, least(1, e.weight * 0.95::DOUBLE + 0.05::DOUBLE * (-1 + 1) / 2)) END AS w FROM edges e LEFT JOIN log l ON l.id = e.id) WHERE w < 0.05::DOUBLE", "memories", "edges", "log", more=DEDUPE))
def refine_pipeline(spark, sf):
    f = t.log(spark, sf).select(F.col("id").alias("edge_id"), F.lit(-1).alias("signal"))
    return pipelines.refined(_valid(spark, sf), t.edges(spark, sf), f, t.now())["counters"]


WINDOWS = "x AS (SELECT id, org_id, len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n FROM memories), c AS (SELECT *, greatest(1, ceil((n - 20) / 80.0::DOUBLE))::BIGINT AS chunks FROM x WHERE n > 0)"


@query(with_tables("SELECT id, chunks + CASE WHEN chunks > 1 THEN ceil(chunks / 4.0::DOUBLE) ELSE 0 END + CASE WHEN chunks > 4 THEN ceil(ceil(chunks / 4.0::DOUBLE) / 4) ELSE 0 END + CASE WHEN chunks > 16 THEN ceil(ceil(ceil(chunks / 4.0::DOUBLE) / 4) / 4) ELSE 0 END + CASE WHEN chunks > 64 THEN ceil(ceil(ceil(ceil(chunks / 4.0::DOUBLE) / 4) / 4) / 4) ELSE 0 END - CASE WHEN chunks > 1 AND chunks % 4 = 1 THEN 1 ELSE 0 END - CASE WHEN chunks > 4 AND ceil(chunks / 4.0::DOUBLE)::BIGINT % 4 = 1 THEN 1 ELSE 0 END - CASE WHEN chunks > 16 AND ceil(ceil(chunks / 4.0::DOUBLE) / 4)::BIGINT % 4 = 1 THEN 1 ELSE 0 END AS calls FROM c WHERE chunks <= 256", "memories", more=WINDOWS))
def rolling_summary_calls(spark, sf):
    """Calls that the summaries of all memories take: one a chunk, then turns of four answers (a turn of one takes none)."""
    m = t.memories(spark, sf).select("id", F.col("content").alias("text"))
    chunks = text.token_windows(m, 100, 20).select("id", "chunk_index", F.col("chunk").alias("text"))
    told = pipelines.rolling(chunks, gateway.StubGateway([], {"summary": "in short"}), 4)
    return told.select("id", F.col("calls").cast("double").alias("calls"))


FORGED = """spent AS (SELECT org_id, sum(amount) AS used FROM usage WHERE amount > 0 AND kind = 'tokens' AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1), cap AS (SELECT org_id, used, CASE WHEN org_id % 2 = 0 THEN 1 ELSE 1000000000 END AS cap FROM spent), """ + WINDOWS


@query(with_tables("SELECT m.org_id, CASE WHEN used >= cap THEN 'rejected' ELSE 'completed' END AS status, CASE WHEN used >= cap THEN 'monthly tokens budget exceeded: used=' || used::BIGINT || ' cap=' || cap END AS error, CASE WHEN used >= cap THEN 0 ELSE m.n END AS memories, CASE WHEN used >= cap THEN 0 ELSE ch.n END AS chunks_total FROM (SELECT org_id, count(*) AS n FROM memories GROUP BY 1) m LEFT JOIN cap USING (org_id) LEFT JOIN (SELECT org_id, sum(chunks)::BIGINT AS n FROM c GROUP BY 1) ch USING (org_id)", "memories", "usage", more=FORGED))
def forge_budget_jobs(spark, sf):
    """Every second tenant has spent its month's tokens: its job is rejected before a call is made."""
    used = refine.usage(t.usage(spark, sf))
    caps = spark.range(4).select(F.col("id").alias("org_id"), F.lit("monthly_tokens").alias("name"), F.when(F.col("id") % 2 == 0, 1).otherwise(1_000_000_000).alias("cap"))
    breaches = refine.first_breach(used, caps, {}, "2024-01-20")
    got = pipelines.forge(t.memories(spark, sf), STUB, "job-2", size=100, overlap=20, summaries=False, breaches=breaches)["jobs"]
    return got.select("org_id", "status", "error", "memories", "chunks_total")


#: A source a part, in one of three languages: a class with a base, a method that calls a function and more, and an import.
SOURCES = {
    "ts": """import {x} from './lib';\n// class Hidden {}\nexport class C%k extends Base {\n  run(): void { help%k(new Thing(1), "x() {"); }\n}\nfunction help%k(a: T) { return a; }\n""",
    "go": """package p\nimport "fmt"\ntype C%k struct { n int }\nfunc (c *C%k) Run() { help%k(fmt.Sprint(c)) }\nfunc help%k(s string) { /* x() */ }\n""",
    "rs": """use std::fmt;\npub struct C%k;\nimpl Base for C%k { fn run(&self) { help%k(1); } }\nfn help%k(n: i32) { println!("{}", n); }\n""",
}
_M = "'src.p' || p_partkey"
_K = lambda before: f"'{before}' || p_partkey"
_IN = lambda name, key=True: f"{_M} || '.{name}'" + (" || p_partkey" if key else "")
_METHOD = f"{_M} || '.C' || p_partkey || '.run'"
SOURCE_EDGES = {
    0: [("IMPORTS", _M, "'./lib'"), ("DEFINES", _M, _IN("C")), ("INHERITS", _IN("C"), "'Base'"), ("DEFINES", _IN("C"), _METHOD), ("CALLS", _METHOD, _K("help")), ("CALLS", _METHOD, "'Thing'"), ("DEFINES", _M, _IN("help"))],
    1: [("IMPORTS", _M, "'fmt'"), ("DEFINES", _M, _IN("C")), ("DEFINES", _M, _IN("Run", False)), ("CALLS", _IN("Run", False), _K("help")), ("CALLS", _IN("Run", False), "'Sprint'"), ("DEFINES", _M, _IN("help"))],
    2: [("IMPORTS", _M, "'std::fmt'"), ("DEFINES", _M, _IN("C")), ("INHERITS", _IN("C"), "'Base'"), ("DEFINES", _IN("C"), _METHOD), ("CALLS", _METHOD, _K("help")), ("DEFINES", _M, _IN("help")), ("CALLS", _IN("help"), "'println'")],
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {a} AS source, {b} AS target FROM part WHERE p_partkey % 3 = {k}" for k, edges in SOURCE_EDGES.items() for kind, a, b in edges))
def code_graph_languages(spark, sf):
    """The edges of a TypeScript, Go or Rust source for each part."""
    key = F.col("p_partkey").cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in SOURCES]), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), kind)
    files = t.read(spark, sf, "part").select(F.concat(F.lit("src/p"), key, F.lit("."), kind).alias("path"), F.replace(text, F.lit("%k"), key).alias("text"))
    return codegraph.extract(files)[1]


@query("""SELECT 'http://x.org/P' || p_partkey AS uri, p_name AS "primary", list_aggregate(list_sort(['2plain ' || p_partkey, '3"alt" ' || p_partkey, '3form ' || p_partkey]), 'string_agg', '|') AS aliases, 'Part' AS type_hint FROM part
UNION ALL SELECT 'http://x.org/L' || p_partkey, 'form ' || p_partkey, '', NULL FROM part UNION ALL SELECT 'http://x.org/B' || p_partkey, 'B' || p_partkey, '', 'Brand' FROM part""")
def turtle_labels(spark, sf):
    """A Turtle source a part: prefixes, lists of predicates and objects, escapes, blank nodes, and a label that is a thing of its own."""
    key = F.col("p_partkey").cast("string")
    text = """@prefix : <http://x.org/> . PREFIX skos: <http://www.w3.org/2004/02/skos/core#>
@prefix xl: <http://www.w3.org/2008/05/skos-xl#> . # comment
@base <http://x.org/> .
<P%k> a :Part ; :by :B%k, [ skos:prefLabel "nobody" ] ; skos:prefLabel "%n"@en ; skos:altLabel "\\"alt\\" %k" , '%n' ; xl:altLabel :L%k ;
  <http://www.w3.org/2000/01/rdf-schema#label> \"\"\"plain %k\"\"\" ; :size 3.5 ; :ok true ; :all ( 1 :B%k ) .
:L%k xl:literalForm "form %k"^^<http://www.w3.org/2001/XMLSchema#string> . :B%k a :Brand ."""
    files = t.read(spark, sf, "part").select(key.alias("path"), F.replace(F.replace(F.lit(text), F.lit("%k"), key), F.lit("%n"), F.col("p_name")).alias("text"))
    found = turtle.labelled(turtle.triples(files))
    ranked = F.transform("aliases", lambda a: F.concat(F.when(a.startswith("plain"), "2").otherwise("3"), a))
    return found.select("uri", "primary", F.array_join(ranked, "|").alias("aliases"), "type_hint")


@query("SELECT 'CLASS' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'FUNCTION', 2 * count(*) FROM nation UNION ALL SELECT 'MODULE', count(*) FROM nation UNION ALL SELECT 'IMPORT', count(*) FROM nation UNION ALL SELECT 'UNRESOLVED', 2")
def code_graph(spark, sf):
    """A source for each nation: a class with a method that calls a function of the module, an import, and a base that no source has."""
    source = F.concat(F.lit("import os\n\ndef help_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")), F.lit("():\n    return 1\n\nclass C(Base):\n    def run(self):\n        return help_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")), F.lit("()\n"))
    files = t.read(spark, sf, "nation").select(F.concat(F.lit("pkg/m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), source.alias("text"))
    nodes, _ = codegraph.graph(*codegraph.extract(files))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))
