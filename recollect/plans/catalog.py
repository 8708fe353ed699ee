"""Registered queries of the engine, each with its SQL for DuckDB where SQL can tell the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import audit, graph, inverted, memory, merkle, nearest, ontology, refine, text
from ..operators.cuts import shared_folder
from ..sources import loaders
from ..streaming import jobs as streams
from ..streaming import watchdog
from . import tables as t
from .tables import with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _probe(spark: SparkSession, sf: str):
    """The embedding of vector 0, a literal of the plan."""
    return F.lit([float(x) for x in t.read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]])


r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
LIVE = "deleted_at IS NULL"
SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
DAYS = "((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us({c})) / 1000000.0::DOUBLE / 86400.0::DOUBLE)"
REC = f"least(1.0::DOUBLE, 1.0::DOUBLE / greatest({DAYS.format(c='created_at')}, 0.01::DOUBLE))"
FUSED = f"0.6::DOUBLE * sim + 0.25::DOUBLE * importance_score + 0.15::DOUBLE * {REC}"


def _vector_sql(where: str, k: int, least: float) -> str:
    return with_tables(f"SELECT id, round(sim, 6) AS similarity, round({FUSED}, 6) AS relevance_score FROM (SELECT *, {SIM} AS sim FROM memories WHERE {where} AND embedding IS NOT NULL ORDER BY sim DESC, id LIMIT {k}) WHERE sim >= {least}", "memories")


def _recall(spark, sf, k=10, threshold=0.0, **where) -> DataFrame:
    m = memory.scan(t.memories(spark, sf), 0, **where)
    return memory.recall_vector(m, _probe(spark, sf), t.now(), k, threshold).select("id", r6("similarity"), r6("relevance_score"))


@query(_vector_sql(f"org_id = 0 AND {LIVE}", 10, -1))
def recall_vector(spark, sf):
    return _recall(spark, sf, threshold=-1.0)


@query(_vector_sql(f"org_id = 0 AND {LIVE}", 50, 0.1))
def recall_vector_threshold(spark, sf):
    return _recall(spark, sf, 50, 0.1)


@query(_vector_sql(f"org_id = 0 AND {LIVE} AND metadata LIKE '%\"lang\":\"en\"%'", 10, -1))
def recall_metadata_filter(spark, sf):
    return _recall(spark, sf, threshold=-1.0, metadata={"lang": "en"})


@query(_vector_sql(f"org_id = 0 AND {LIVE} AND user_id = 12", 10, -1))
def recall_user_scope(spark, sf):
    return _recall(spark, sf, threshold=-1.0, user=12)


@query(_vector_sql(f"org_id = 0 AND {LIVE} AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'", 10, -1))
def recall_time_range(spark, sf):
    span = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-15")]
    return _recall(spark, sf, threshold=-1.0, between=span)


@query(with_tables(f"SELECT id, round(0.5::DOUBLE * importance_score + 0.5::DOUBLE * {REC}, 6) AS relevance_score FROM (SELECT * FROM memories WHERE org_id = 1 AND {LIVE} ORDER BY importance_score DESC, created_at DESC, id LIMIT 10)", "memories"))
def recall_fallback(spark, sf):
    return memory.recall_fallback(memory.scan(t.memories(spark, sf), 1), t.now()).select("id", r6("relevance_score"))


@query(with_tables("SELECT id, importance_score, valid_from FROM versions WHERE org_id = 0 AND deleted_at IS NULL AND valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10') ORDER BY importance_score DESC, id LIMIT 20", "versions"))
def recall_as_of(spark, sf):
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    return memory.scan(t.versions(spark, sf), 0, as_of=at).orderBy(F.col("importance_score").desc(), "id").limit(20).select("id", "importance_score", "valid_from")


@query(with_tables(f"SELECT id, round(sim, 6) AS similarity FROM (SELECT *, {SIM} AS sim FROM memories WHERE org_id = 0 AND agent_id = 2 AND {LIVE} AND embedding IS NOT NULL ORDER BY sim DESC, id LIMIT 1) WHERE sim > 0.95", "memories"))
def near_duplicate_check(spark, sf):
    return memory.near_duplicate(memory.scan(t.memories(spark, sf), 0, agent=2), _probe(spark, sf)).select("id", r6("similarity"))


@query("SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id <> e.vec_id AND q.vec_id % 20 = 0) WHERE rank <= 10")
def batch_knn_topk(spark, sf):
    """All due searches: each row whose id is divisible by 20 against all rows."""
    e = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return memory.knn_per_query(e, asked, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


DUE = "SELECT count(*) AS n FROM embeddings WHERE vec_id % 20 = 0"


@query(f"WITH d AS ({DUE}), e AS (SELECT least(10, count(*) - 1) AS k FROM embeddings) SELECT n AS queries, n * k AS neighbours, true AS reached FROM d, e")
def ivf_recall(spark, sf):
    """An inverted file over all embeddings, asked all due queries: whether it finds nine tenths of the ten nearest."""
    e = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = nearest.build(e, nearest.folder(shared_folder(spark)))
    asked = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    true = nearest.knn(e, asked, 10).select("query_id", "id")
    found = nearest.search(index, asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    x = true.join(found, ["query_id", "id"], "left")
    return x.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") / F.count("*") >= 0.9).alias("reached"))


@query(with_tables("SELECT id, memory_type, importance_score FROM memories WHERE org_id = 2 AND id = 42 AND deleted_at IS NULL", "memories"))
def point_lookup(spark, sf):
    return memory.scan(t.memories(spark, sf), 2).filter("id = 42").select("id", "memory_type", "importance_score")


@query(with_tables("SELECT id, valid_from, valid_to, importance_score FROM versions WHERE id = 25", "versions"))
def memory_history(spark, sf):
    return memory.history(t.versions(spark, sf), 25).select("id", "valid_from", "valid_to", "importance_score")


@query(with_tables("SELECT id, valid_from FROM versions WHERE org_id = 1 AND valid_from BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'", "versions"))
def changed_between(spark, sf):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-07"))
    return memory.changed_between(t.versions(spark, sf), a, b, 1).select("id", "valid_from")


MEMO_SQL = "mv AS (SELECT id AS memo_id, row_number() OVER w AS version, valid_from, lead(valid_from) OVER w AS valid_to FROM versions WINDOW w AS (PARTITION BY id ORDER BY valid_from))"


@query(with_tables("SELECT * FROM mv", "versions", more=MEMO_SQL))
def memo_versions_build(spark, sf):
    return memory.memo_versions(t.versions(spark, sf)).withColumn("version", F.col("version").cast("long"))


@query(with_tables("SELECT m.id, v.version FROM memories m LEFT JOIN (SELECT memo_id, max(version) AS version FROM mv WHERE valid_from <= TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-12') GROUP BY 1) v ON m.id = v.memo_id", "versions", more=MEMO_SQL))
def memo_as_of_join(spark, sf):
    v = memory.memo_versions(t.versions(spark, sf))
    return memory.memo_as_of(t.memories(spark, sf).select("id"), v, F.lit("2024-01-12").cast("timestamp_ntz")).withColumn("version", F.col("version").cast("long"))


UPDATES = "SELECT id, CASE WHEN id % 3 = 0 THEN importance_score / CAST(4 AS DOUBLE) END AS importance_score, CASE WHEN id % 3 = 1 THEN recall_count + 1 END AS recall_count, CAST(NULL AS {TS}) AS deleted_at FROM {v} WHERE valid_to IS NULL AND id % 6 <> 5"


@query(with_tables("""SELECT v.id, v.importance_score, coalesce(u.recall_count, v.recall_count) AS recall_count, v.valid_from, v.valid_to FROM versions v LEFT JOIN u ON u.id = v.id AND v.valid_to IS NULL WHERE NOT coalesce(u.importance_score <> v.importance_score, false)
 UNION ALL SELECT v.id, v.importance_score, v.recall_count, v.valid_from, TIMESTAMP '2024-02-01' FROM versions v JOIN u ON u.id = v.id AND v.valid_to IS NULL WHERE u.importance_score <> v.importance_score
 UNION ALL SELECT v.id, u.importance_score, coalesce(u.recall_count, v.recall_count), TIMESTAMP '2024-02-01', NULL FROM versions v JOIN u ON u.id = v.id AND v.valid_to IS NULL WHERE u.importance_score <> v.importance_score""", "versions", more="u AS (" + UPDATES.replace("{TS}", "TIMESTAMP").replace("{v}", "versions") + ")"))
def scd2_apply_updates(spark, sf):
    v = t.versions(spark, sf)
    u = spark.sql(UPDATES.replace("{TS}", "TIMESTAMP_NTZ"), v=v)
    return memory.apply_updates(v, u, t.now()).select("id", "importance_score", "recall_count", "valid_from", "valid_to")


@query(with_tables("SELECT id, TIMESTAMP '2024-02-01' AS deleted_at FROM memories WHERE ttl_expires_at < TIMESTAMP '2024-02-01' AND deleted_at IS NULL", "memories"))
def ttl_sweep(spark, sf):
    return memory.ttl_sweep(t.memories(spark, sf), t.now()).select("id", "deleted_at")


@query(with_tables("SELECT id, org_id, memory_type FROM (SELECT *, count(*) OVER (PARTITION BY org_id, agent_id, memory_type) - 20 AS excess, row_number() OVER (PARTITION BY org_id, agent_id, memory_type, pinned ORDER BY importance_score, created_at, id) AS rn FROM memories WHERE deleted_at IS NULL) WHERE NOT pinned AND rn <= excess", "memories"))
def retention_cap(spark, sf):
    return memory.retention_evictions(t.memories(spark, sf), 20).select("id", "org_id", "memory_type")


DECAYED = f"(SELECT *, greatest(0.0::DOUBLE, importance_score * exp(-0.05::DOUBLE * greatest({DAYS.format(c='coalesce(last_recalled_at, created_at)')}, 0.0::DOUBLE))) AS s FROM memories WHERE {LIVE} AND NOT pinned AND importance_score > 0)"


@query(with_tables(f"SELECT id, round(s, 6) AS new_score FROM {DECAYED}", "memories"))
def decay_importance(spark, sf):
    return memory.decay(t.memories(spark, sf), t.now()).select("id", "new_score")


@query(with_tables(f"SELECT count(*) AS examined, count(*) FILTER (WHERE abs(round(s, 6) - importance_score) > 0.0001) AS changed, count(*) FILTER (WHERE abs(round(s, 6) - importance_score) > 0.0001 AND round(s, 6) < 0.05) AS below FROM {DECAYED}", "memories"))
def decay_summary(spark, sf):
    return memory.decay_summary(memory.decay(t.memories(spark, sf), t.now()))


@query(with_tables("SELECT m.id, m.recall_count + coalesce(b.n, 0) AS recall_count, coalesce(b.at, m.last_recalled_at) AS last_recalled_at FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n, max(created_at) AS at FROM log WHERE operation = 'recall' GROUP BY 1) b ON b.memory_id = m.id", "memories", "log"))
def recall_count_bump(spark, sf):
    recalls = t.log(spark, sf).filter("operation = 'recall'").select(F.col("memory_id").alias("id"), F.col("created_at").alias("at"))
    return memory.bump_recalls(t.memories(spark, sf), recalls).select("id", "recall_count", "last_recalled_at")


# --- audit -----------------------------------------------------------------------------------------------------------


@query(with_tables("SELECT id, operation, created_at, (SELECT count(*) FROM log WHERE org_id = 1) AS total, (SELECT count(*) FROM log WHERE org_id = 1) > 150 AS has_next FROM log WHERE org_id = 1 ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", "log"))
def audit_page_offset(spark, sf):
    return audit.page(audit.matching(t.log(spark, sf), 1), 3, 50).select("id", "operation", "created_at", "total", "has_next")


@query(with_tables("SELECT id, operation, (SELECT CASE WHEN count(*) > 50 THEN (SELECT min(id) FROM (SELECT id FROM log WHERE org_id = 1 AND id < 900 ORDER BY id DESC LIMIT 50)) END FROM log WHERE org_id = 1 AND id < 900) AS next_cursor FROM log WHERE org_id = 1 AND id < 900 ORDER BY id DESC LIMIT 50", "log"))
def audit_keyset(spark, sf):
    return audit.keyset(audit.matching(t.log(spark, sf), 1), 900, 50).select("id", "operation", "next_cursor")


@query(with_tables("SELECT id FROM log WHERE org_id = 2 AND operation = 'recall' AND memory_type = 'semantic' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'", "log"))
def audit_filtered(spark, sf):
    span = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-20")]
    return audit.matching(t.log(spark, sf), 2, operation="recall", memory_type="semantic", between=span).select("id")


@query(with_tables("SELECT a.*, b.total FROM (SELECT org_id, agent_id, operation, count(*) AS n FROM log GROUP BY ALL) a JOIN (SELECT org_id, agent_id, count(*) AS total FROM log GROUP BY ALL) b ON a.org_id = b.org_id AND a.agent_id = b.agent_id", "log"))
def activity_summary(spark, sf):
    return audit.activity(t.log(spark, sf))


@query(with_tables("SELECT id, operation, created_at FROM log WHERE memory_id = 77", "log"))
def memory_lifecycle(spark, sf):
    return t.log(spark, sf).filter("memory_id = 77").orderBy("created_at", "id").select("id", "operation", "created_at")


@query(with_tables("SELECT month FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-05-01', INTERVAL 1 MONTH))::DATE AS month) WHERE month NOT IN (SELECT date_trunc('month', created_at)::DATE FROM log)", "log"))
def audit_partitions(spark, sf):
    return audit.missing_months(t.log(spark, sf), F.lit("2024-01-15").cast("date"), 4)


#: The hashed text of a log row and the chain over it, in DuckDB.
CANON_SQL = """canon AS (SELECT org_id, id, created_at, row_number() OVER (PARTITION BY org_id ORDER BY id) AS rn,
 concat('{"agent_id":"', agent_id, '","created_at":"', CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END, '","details":', replace(details, ' ', ''),
 ',"memory_id":"', memory_id, '","memory_type":', CASE WHEN memory_type IS NULL THEN 'null' ELSE '"' || memory_type || '"' END, ',"operation":"', operation, '","org_id":"', org_id, '","user_id":"', user_id, '"}') AS c FROM log)"""
CHAIN_SQL = CANON_SQL + """, chain AS (SELECT org_id, id, rn, NULL::VARCHAR AS prev_hash, upper(sha256(c)) AS row_hash FROM canon WHERE rn = 1
 UNION ALL SELECT n.org_id, n.id, n.rn, p.row_hash, upper(sha256(unhex(p.row_hash) || encode(n.c))) FROM chain p JOIN canon n ON n.org_id = p.org_id AND n.rn = p.rn + 1)"""


@query(with_tables("SELECT org_id, id, prev_hash, row_hash FROM chain", "log", recursive=True, more=CHAIN_SQL))
def audit_hash_chain(spark, sf):
    return audit.hash_chain(t.log(spark, sf)).select("org_id", "id", F.hex("prev_hash").alias("prev_hash"), F.hex("row_hash").alias("row_hash"))


@query(with_tables("SELECT org_id, id, reason FROM (SELECT org_id, id, CASE WHEN id % 97 = 0 THEN 'content' WHEN before % 101 = 50 THEN 'link' END AS reason FROM (SELECT org_id, id, lag(id) OVER (PARTITION BY org_id ORDER BY id) AS before FROM log) WHERE id % 101 <> 50) WHERE reason IS NOT NULL", "log"))
def audit_verify_tampered(spark, sf):
    """What verification tells of a log whose rows 97, 194, ... were edited and rows 50, 151, ... taken out."""
    chain = audit.hash_chain(t.log(spark, sf)).filter("id % 101 <> 50")
    return audit.verify(chain.withColumn("details", F.when(F.col("id") % 97 == 0, F.lit('{"k": "edited"}')).otherwise(F.col("details"))))


@query(with_tables("SELECT org_id, upper(list_reduce(list_prepend('', list(c ORDER BY id)), lambda p, x: sha256(unhex(p) || encode(x)))) AS row_hash FROM (SELECT * FROM canon QUALIFY id <= max_by(id, created_at::VARCHAR || lpad(id::VARCHAR, 20, '0')) OVER (PARTITION BY org_id)) GROUP BY 1", "log", more=CANON_SQL))
def latest_hash(spark, sf):
    return audit.latest_hash(audit.hash_chain(t.log(spark, sf))).select("org_id", F.hex("row_hash").alias("row_hash"))


@query(with_tables("SELECT id FROM log WHERE id % 50 = 7", "log"))
def audit_immutability(spark, sf):
    """Rows of the log that a later snapshot, in which every fiftieth was edited, holds otherwise."""
    log = t.log(spark, sf)
    return audit.changed_rows(log, log.withColumn("operation", F.when(F.col("id") % 50 == 7, F.lit("forget!")).otherwise(F.col("operation")))).select("id")


@query(with_tables("SELECT id, org_id, operation FROM log UNION ALL SELECT (SELECT max(id) FROM log) + row_number() OVER (ORDER BY o), o, 'quarantine' FROM range(4) r(o)", "log"))
def audit_enqueue(spark, sf):
    log = t.log(spark, sf)
    rows = spark.range(4).select(F.col("id").alias("org_id"), F.lit("quarantine").alias("operation"), t.now().alias("created_at"))
    return audit.enqueue(log, rows).select("id", "org_id", "operation")


@query(with_tables("SELECT org_id, id AS memory_id, 'forget' AS operation, '{\"reason\":\"ttl_expiry\"}' AS details FROM memories WHERE ttl_expires_at < TIMESTAMP '2024-02-01' AND deleted_at IS NULL", "memories"))
def ttl_audit_rows(spark, sf):
    """What the sweep of expired memories writes to the audit queue."""
    return audit.expiries(memory.ttl_sweep(t.memories(spark, sf), t.now()), t.now()).select("org_id", "memory_id", "operation", "details")


@query(with_tables("SELECT DISTINCT org_id FROM log ORDER BY 1 LIMIT 3", "log"))
def pending_orgs(spark, sf):
    return t.log(spark, sf).select("org_id").distinct().orderBy("org_id").limit(3)


# --- graph -----------------------------------------------------------------------------------------------------------

BOTH = "b AS (SELECT DISTINCT source_memory_id AS src, target_memory_id AS dst FROM edges UNION SELECT target_memory_id, source_memory_id FROM edges)"
WALK = "w AS (SELECT 0::BIGINT AS id, 0 AS hop UNION SELECT b.dst, w.hop + 1 FROM w JOIN b ON b.src = w.id WHERE w.hop < {n})"


def _start(spark, i: int = 0) -> DataFrame:
    return spark.range(i, i + 1)


@query(with_tables("SELECT id, min(hop)::BIGINT AS hop FROM w GROUP BY 1", "edges", recursive=True, more=BOTH + ", " + WALK.format(n=3)))
def related_n_hops(spark, sf):
    return graph.reach(_start(spark), t.edges(spark, sf), 3).select("id", F.col("hop").cast("long").alias("hop"))


@query(with_tables("SELECT target, depth::BIGINT AS depth FROM p", "edges", recursive=True, more="p AS (SELECT target_memory_id AS target, [id] AS path, 1 AS depth FROM edges WHERE relationship_type = 'derived_from' AND source_memory_id = 6 UNION ALL SELECT e.target_memory_id, list_append(p.path, e.id), p.depth + 1 FROM p JOIN edges e ON e.source_memory_id = p.target AND e.relationship_type = 'derived_from' AND NOT list_contains(p.path, e.id) WHERE p.depth < 4)"))
def derivation_chain(spark, sf):
    return graph.chains(t.edges(spark, sf), 6, "derived_from", 4).select("target", F.col("depth").cast("long").alias("depth"))


@query(with_tables("SELECT DISTINCT source_memory_id AS src, target_memory_id AS dst FROM edges WHERE relationship_type = 'contradicts' UNION SELECT target_memory_id, source_memory_id FROM edges WHERE relationship_type = 'contradicts'", "edges"))
def contradictions(spark, sf):
    return graph.contradictions(t.edges(spark, sf))


@query(with_tables("SELECT min(hop)::BIGINT AS length FROM w WHERE id = 100 HAVING min(hop) IS NOT NULL", "edges", recursive=True, more=BOTH + ", " + WALK.format(n=8)))
def shortest_path(spark, sf):
    return graph.reach(_start(spark), t.edges(spark, sf), 8).filter("id = 100").select(F.col("hop").cast("long").alias("length"))


@query(with_tables("SELECT id FROM w GROUP BY 1 HAVING min(hop) > 0", "edges", recursive=True, more=BOTH + ", " + WALK.format(n=2)))
def cascade_neighbours(spark, sf):
    return graph.reach(_start(spark), t.edges(spark, sf), 2).filter("hop > 0").select("id")


@query(with_tables("SELECT m.id, CASE WHEN x.id IS NOT NULL THEN coalesce(m.deleted_at, TIMESTAMP '2024-02-01') ELSE m.deleted_at END AS deleted_at FROM memories m LEFT JOIN (SELECT DISTINCT id FROM w) x ON x.id = m.id", "memories", "edges", recursive=True, more=BOTH + ", " + WALK.format(n=2)))
def cascade_forget(spark, sf):
    e = t.edges(spark, sf)
    return memory.forget(t.memories(spark, sf), e, graph.reach(_start(spark), e, 2), t.now())[0].select("id", "deleted_at")


@query(with_tables("SELECT id, source_memory_id, target_memory_id FROM edges WHERE source_memory_id % 10 <> 3 AND target_memory_id % 10 <> 3", "edges"))
def hard_delete(spark, sf):
    m = t.memories(spark, sf)
    return memory.forget(m, t.edges(spark, sf), m.filter("id % 10 = 3"), t.now(), hard=True)[1].select("id", "source_memory_id", "target_memory_id")


@query(with_tables("SELECT id FROM memories WHERE id NOT IN (SELECT source_memory_id FROM edges) AND id NOT IN (SELECT target_memory_id FROM edges)", "memories", "edges"))
def orphan_memories(spark, sf):
    return graph.orphans(t.memories(spark, sf), t.edges(spark, sf)).select("id")


COMPONENTS = "s AS (SELECT source_memory_id AS src, target_memory_id AS dst FROM edges WHERE weight >= 0.9 UNION SELECT target_memory_id, source_memory_id FROM edges WHERE weight >= 0.9), r AS (SELECT src AS id, src AS seen FROM s UNION SELECT r.id, s.dst FROM r JOIN s ON s.src = r.seen), cc AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)"


@query(with_tables("SELECT id, component FROM cc", "edges", recursive=True, more=COMPONENTS))
def connected_components(spark, sf):
    return graph.components(t.edges(spark, sf).filter("weight >= 0.9"))


@query(with_tables("SELECT component, sha256(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR)) AS cluster_hash, count(*) AS members FROM cc GROUP BY 1", "edges", recursive=True, more=COMPONENTS))
def cluster_hash(spark, sf):
    return refine.cluster_hash(graph.components(t.edges(spark, sf).filter("weight >= 0.9")), "component", "id")


@query(with_tables(f"""SELECT s.id, round(0.5::DOUBLE * s.sim + 0.3::DOUBLE * least(1.0::DOUBLE, (coalesce(n.n, 0) + coalesce(e.n, 0))::DOUBLE / 10.0::DOUBLE) + 0.2::DOUBLE * s.importance_score, 6) AS relevance_score FROM seeds s
 LEFT JOIN (SELECT seed, least(count(*), 50) AS n FROM (SELECT seed, id FROM gw GROUP BY 1, 2 HAVING min(hop) > 0) GROUP BY 1) n ON n.seed = s.id LEFT JOIN (SELECT src, least(count(*), 50) AS n FROM (SELECT source_memory_id AS src FROM edges UNION ALL SELECT target_memory_id FROM edges) GROUP BY 1) e ON e.src = s.id""", "memories", "edges", recursive=True, more=BOTH + f", seeds AS (SELECT * FROM (SELECT *, {SIM} AS sim FROM memories WHERE org_id = 0 AND {LIVE}) ORDER BY sim DESC, id LIMIT 3), gw AS (SELECT id AS seed, id, 0 AS hop FROM seeds UNION SELECT gw.seed, b.dst, gw.hop + 1 FROM gw JOIN b ON b.src = gw.id WHERE gw.hop < 2)"))
def graph_recall(spark, sf):
    m = memory.scan(t.memories(spark, sf), 0)
    seeds = memory.recall_vector(m, _probe(spark, sf), t.now(), 3, -1.0).select("id", "similarity", "importance_score")
    return graph.graph_recall(seeds, t.edges(spark, sf), 2).select("id", r6("relevance_score"))


CONTEXT = f"""l AS (SELECT id, memory_type FROM memories WHERE org_id = 0 AND {LIVE}), ie AS (SELECT * FROM edges WHERE org_id = 0 AND source_memory_id IN (SELECT id FROM l) AND target_memory_id IN (SELECT id FROM l)),
ib AS (SELECT source_memory_id AS src, target_memory_id AS dst, relationship_type AS type FROM ie UNION SELECT target_memory_id, source_memory_id, relationship_type FROM ie),
seeds AS (SELECT id FROM l WHERE id % 8 = 0),
gw AS (SELECT id AS seed, id, 0 AS hop FROM seeds UNION SELECT gw.seed, ib.dst, gw.hop + 1 FROM gw JOIN ib ON ib.src = gw.id WHERE gw.hop < 2),
near AS (SELECT seed, id, min(hop) AS hop FROM gw GROUP BY 1, 2 HAVING min(hop) > 0)"""


@query(with_tables("SELECT s.id, coalesce(n.nodes, '') AS nodes, coalesce(e.edges, '') AS edges FROM seeds s, LATERAL (SELECT string_agg(x.id || ':' || x.memory_type, ',' ORDER BY x.hop, x.id) AS nodes FROM (SELECT near.id, l.memory_type, near.hop FROM near JOIN l USING (id) WHERE near.seed = s.id ORDER BY near.hop, near.id LIMIT 5) x) n, LATERAL (SELECT string_agg(y.type || ':' || y.dst, ',' ORDER BY y.type, y.dst) AS edges FROM (SELECT DISTINCT type, dst FROM ib WHERE src = s.id ORDER BY 1, 2 LIMIT 5) y) e", "memories", "edges", recursive=True, more=CONTEXT))
def graph_context(spark, sf):
    """The surroundings of every eighth memory of a tenant's: five nodes and five edges at most."""
    m = memory.scan(t.memories(spark, sf), 0)
    x = graph.context(m.filter("id % 8 = 0").select("id"), m, t.edges(spark, sf).filter("org_id = 0"), 2, 5)
    said = lambda c, a, b: F.array_join(F.transform(f"graph_context.{c}", lambda e: F.concat(e[a].cast("string"), F.lit(":"), e[b].cast("string"))), ",").alias(c)
    return x.select("id", said("nodes", "id", "memory_type"), said("edges", "type", "target"))


@query(with_tables("SELECT DISTINCT dst AS id FROM (SELECT source_memory_id AS src, target_memory_id AS dst FROM edges WHERE relationship_type = 'supports' UNION ALL SELECT target_memory_id, source_memory_id FROM edges WHERE relationship_type = 'supports') WHERE src IN (SELECT id FROM memories WHERE contains(lower(left(content, 200)), 'tion'))", "memories", "edges"))
def triplet_match(spark, sf):
    return graph.triplet_match(t.memories(spark, sf), t.edges(spark, sf), "Tion", "supports")


@query(with_tables("SELECT id, min(hop)::BIGINT AS hop, round(0.7::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - min(hop)::DOUBLE / 3.0::DOUBLE), 6) AS walk_score FROM cw GROUP BY 1", "memories", "edges", recursive=True, more=BOTH + ", cw AS (SELECT id, 0 AS hop FROM memories WHERE memo_type = 'CODE_FUNCTION' AND contains(lower(content), 'worthless') UNION SELECT b.dst, cw.hop + 1 FROM cw JOIN b ON b.src = cw.id WHERE cw.hop < 2)"))
def code_recall(spark, sf):
    seeds = t.memories(spark, sf).filter((F.col("memo_type") == "CODE_FUNCTION") & F.lower("content").contains("worthless"))
    return graph.code_recall(seeds, t.edges(spark, sf), 2).select("id", F.col("hop").cast("long").alias("hop"), r6("walk_score"))


# --- strategies ------------------------------------------------------------------------------------------------------

STEPS = "SELECT id % 50 AS id, id % 3 AS step, importance_score AS relevance_score FROM {m} WHERE org_id = 0"


@query(with_tables("SELECT id, step, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY relevance_score DESC, step) AS rn FROM (" + STEPS.format(m="memories") + ")) WHERE rn = 1", "memories"))
def trace_merge(spark, sf):
    return memory.trace_merge(spark.sql(STEPS, m=t.memories(spark, sf)))


@query(with_tables(f"SELECT id, round({FUSED}, 6) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY sim DESC, id) AS rn FROM (SELECT *, {SIM} AS sim FROM memories WHERE org_id = 0 AND {LIVE} AND memory_type IN ('episodic', 'semantic') AND embedding IS NOT NULL)) WHERE rn <= 5 ORDER BY {FUSED} DESC, id LIMIT 5", "memories"))
def tier_fanout(spark, sf):
    m = memory.scan(t.memories(spark, sf), 0)
    return memory.tier_fanout(m, _probe(spark, sf), t.now(), ["episodic", "semantic"], 5).select("id", r6("relevance_score"))


TIER_SQL = r"""SELECT conv_id, turn, CASE WHEN len(h) = 0 THEN 'episodic,procedural,semantic,working' ELSE array_to_string(list_sort(h), ',') END AS tiers FROM (SELECT conv_id, turn, list_filter([
 CASE WHEN regexp_matches(t, '\bhow\s+(do|can|should)\s+i\b') OR regexp_matches(t, '\b(step|steps)\s+to\b') OR regexp_matches(t, '\b(procedure\s+for|recipe|workflow)\b') OR regexp_matches(t, '\bhow\s+to\s+\w+') THEN 'procedural' END,
 CASE WHEN regexp_matches(t, '\b(yesterday|today|this morning|earlier|last week|last month|last quarter|last year|this week|this month|this year|recent|recently|when did|when were|on \d\d\d\d-\d\d-\d\d)\b') OR regexp_matches(t, '\bwhat (did|happened|occurred)\b') THEN 'episodic' END,
 CASE WHEN regexp_matches(t, '\b(current|currently|right now|in this session|in this chat|in this conversation|in progress|so far)\b') THEN 'working' END,
 CASE WHEN regexp_matches(t, '\b(prefer|prefers|preference|like|likes|favourite|favorite|always|usually|tend to|tends to|what is|what are|who is|who are|where is|where are|why)\b') THEN 'semantic' END], lambda x: x IS NOT NULL) AS h FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations))"""


@query(TIER_SQL)
def tier_route(spark, sf):
    return t.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(sc.tiers(F.col("text"))), ",").alias("tiers"))


@query(with_tables("SELECT id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS relevance_score FROM (SELECT id, ((id * 31) % 97)::DOUBLE / 97.0::DOUBLE AS raw FROM (SELECT * FROM memories WHERE org_id = 0 AND deleted_at IS NULL ORDER BY importance_score DESC, created_at DESC, id LIMIT 20))", "memories"))
def rerank_minmax(spark, sf):
    top = memory.recall_fallback(memory.scan(t.memories(spark, sf), 0), t.now(), 20)
    return memory.rerank(top, (F.col("id") * 31 % 97).cast("double") / F.lit(97.0), 20).select("id", r6("relevance_score"))


#: RE2 knows ASCII word boundaries only, so both engines read texts whose other characters are an x; a test holds Unicode texts against plain patterns.
ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"
REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[REDACTED:EMAIL]', 'g'),
 '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED:SSN]', 'g'), '\b(?:\d[ -]?){13,19}\b', '[REDACTED:CARD]', 'g'), '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '[REDACTED:PHONE]', 'g')"""


@query(f"SELECT doc_id, md5({REDACT_SQL}) AS clean_md5 FROM (SELECT doc_id, {ASCII_SQL} AS text FROM documents)")
def redact_pii(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", F.md5(sc.redacted(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("clean_md5"))


@query("SELECT doc_id, md5((" + REDACT_SQL.replace("(text,", "(regexp_replace(text, 'the', '[X]', 'g'),") + ")) AS clean_md5 FROM (SELECT doc_id, " + ASCII_SQL + " AS text FROM documents)")
def redact_by_role(spark, sf):
    """An unknown role falls back to the rules of 'guest', which come before the defaults."""
    rules = sc.rules_for("visitor", {"guest": (("the", "the", "[X]"),)}, "guest")
    return t.read(spark, sf, "documents").select("doc_id", F.md5(sc.redacted(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), rules)).alias("clean_md5"))


@query("SELECT c_custkey, regexp_replace(lower(regexp_replace(c_name, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS name FROM customer")
def normalize_names(spark, sf):
    return t.read(spark, sf, "customer").select("c_custkey", sc.normal_name(F.col("c_name")).alias("name"))


LEXICAL_SQL = f"""x AS (SELECT id, created_at, importance_score, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}]+'), lambda w: len(w) >= 3) AS w FROM memories WHERE org_id = 0 AND {LIVE}),
f AS (SELECT *, len(w) AS n, len(list_filter(w, lambda z: z = 'this')) AS a, len(list_filter(w, lambda z: z = 'with')) AS b FROM x),
d AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
s AS (SELECT id, created_at, importance_score, ln(1 + (docs - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS raw FROM f CROSS JOIN d WHERE a > 0 AND b > 0)"""


@query(with_tables(f"SELECT id, round(raw / (1 + raw), 6) AS lexical, round(0.7::DOUBLE * raw / (1 + raw) + 0.2::DOUBLE * importance_score + 0.1::DOUBLE * {REC}, 6) AS relevance_score FROM s ORDER BY raw / (1 + raw) DESC, created_at DESC, id LIMIT 10", "memories", more=LEXICAL_SQL))
def lexical_recall(spark, sf):
    return text.lexical_recall(memory.scan(t.memories(spark, sf), 0), "this with", t.now(), english=False).select("id", r6("lexical"), r6("relevance_score"))


@query()
def lexical_recall_english(spark, sf):
    return text.lexical_recall(memory.scan(t.memories(spark, sf), 0), "the things", t.now()).select("id", r6("lexical"), r6("relevance_score"))


#: Full-text ranks in SQL, from the positions of each word in the whole text.
POSITIONS = r"x AS (SELECT id, created_at, importance_score, regexp_extract_all(lower(content), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM memories WHERE org_id = 0 AND deleted_at IS NULL), f AS (SELECT id, created_at, importance_score, list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'this')[1:256], lambda p: least(p, 16383)) AS a, list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'with')[1:256], lambda p: least(p, 16383)) AS b FROM x)"
NEAR = "sqrt(0.01::DOUBLE * CASE WHEN abs(p - q) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(p - q) / 1.5::DOUBLE - 2)) END)"
RANKS = f", s AS (SELECT id, greatest(1 - product(CASE WHEN p = q THEN 1 ELSE 1 - {NEAR} END), 1e-20)::FLOAT::DOUBLE AS rank FROM (SELECT id, p, unnest(b) AS q FROM (SELECT id, b, unnest(a) AS p FROM f)) GROUP BY 1)"
RANK = ", s AS (SELECT id, (sum(0.1::DOUBLE / (j * j)) / 1.64493406685::DOUBLE)::FLOAT::DOUBLE AS rank FROM (SELECT id, unnest(range(1, len(b) + 1)) AS j FROM f) GROUP BY 1)"
LEXICAL = f" SELECT id, round(least(rank, 1), 6) AS lexical, round(0.7::DOUBLE * least(rank, 1) + 0.2::DOUBLE * importance_score + 0.1::DOUBLE * {REC}, 6) AS relevance_score FROM f JOIN s USING (id) ORDER BY rank DESC, created_at DESC, id LIMIT 10"


def _index(spark, sf) -> inverted.Index:
    return inverted.build(t.memories(spark, sf), f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}", "simple", 64)


def _by_rank(spark, sf, words: str, index: inverted.Index | None) -> DataFrame:
    m = memory.scan(t.memories(spark, sf), 0)
    return inverted.recall(m, words, t.now(), index=index, config="simple", org=0).select("id", r6("lexical"), r6("relevance_score"))


@query(with_tables(LEXICAL, "memories", more=POSITIONS + RANKS))
def lexical_index_recall(spark, sf):
    """Both words by closeness, from an index of all memories."""
    return _by_rank(spark, sf, "This, with", _index(spark, sf))


@query(with_tables(LEXICAL, "memories", more=POSITIONS + RANK))
def lexical_index_term(spark, sf):
    return _by_rank(spark, sf, "with", _index(spark, sf))


@query(with_tables(LEXICAL, "memories", more=POSITIONS + RANKS))
def lexical_scan_rank(spark, sf):
    """The same from the texts."""
    return _by_rank(spark, sf, "this with", None)


# --- refinement, usage, jobs, conversations --------------------------------------------------------------------------

DEDUPE = """v AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN '' ELSE ontology_uri END AS ontology_uri), created_at + (id % 3) * INTERVAL 1 DAY AS valid_from FROM memories),
k AS (SELECT *, CASE WHEN ontology_uri <> '' THEN concat('uri:', ontology_uri) WHEN memo_type IS NOT NULL THEN concat('type:', memo_type, ':', regexp_replace(lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) END AS dedupe_key FROM v WHERE deleted_at IS NULL),
g AS (SELECT id, first_value(id) OVER (PARTITION BY org_id, dedupe_key ORDER BY valid_from, id) AS primary_id, count(*) OVER (PARTITION BY org_id, dedupe_key) AS members FROM k WHERE dedupe_key IS NOT NULL)"""


def _valid(spark, sf) -> DataFrame:
    """Memories with a valid_from of their own, and some empty uris."""
    m = t.memories(spark, sf).withColumn("valid_from", F.expr("created_at + make_dt_interval(cast(id % 3 as int))"))
    return m.withColumn("ontology_uri", F.when(F.col("id") % 13 == 0, F.lit("")).otherwise(F.col("ontology_uri")))


@query(with_tables("SELECT id, primary_id, members FROM g WHERE members > 1", "memories", more=DEDUPE))
def dedupe_groups(spark, sf):
    return refine.dedupe_groups(_valid(spark, sf)).select("id", "primary_id", "members")


@query(with_tables("SELECT m.id, m.memory_type FROM memories m WHERE deleted_at IS NULL AND id NOT IN (SELECT id FROM g WHERE members > 1 AND id <> primary_id)", "memories", more=DEDUPE))
def dedupe_apply(spark, sf):
    m = _valid(spark, sf)
    losers = refine.dedupe_groups(m).filter("loses").select("id")
    return m.filter("deleted_at IS NULL").join(losers, "id", "left_anti").select("id", "memory_type")


FEEDBACK = "SELECT event_id % (2 * n) AS edge_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS signal FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE event_type IN ('purchase', 'click', 'error')"


@query(with_tables("SELECT e.id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, weight * 0.95::DOUBLE + 0.05::DOUBLE * (s + 1) / 2)), 6) AS new_weight, n FROM edges e JOIN (SELECT edge_id, avg(signal) AS s, count(*) AS n FROM (" + FEEDBACK.format(events="events", documents="documents") + ") GROUP BY 1) f ON f.edge_id = e.id", "edges"))
def edge_reweight(spark, sf):
    f = spark.sql(FEEDBACK, events=t.read(spark, sf, "events"), documents=t.read(spark, sf, "documents"))
    return refine.reweight(t.edges(spark, sf), f).select("id", r6("new_weight"), "n")


@query(with_tables("SELECT id, weight FROM edges WHERE weight < 0.05", "edges"))
def edge_prune(spark, sf):
    return refine.prune(t.edges(spark, sf)).select("id", "weight")


@query(with_tables("SELECT org_id, memo_type, count(*) AS members, min(id) AS first_id, max(id) AS last_id FROM memories WHERE memo_type IS NOT NULL AND deleted_at IS NULL GROUP BY 1, 2 HAVING count(*) >= 2", "memories"))
def cluster_by_memo_type(spark, sf):
    return refine.cluster_by_type(t.memories(spark, sf))


@query(with_tables("SELECT memory_type, agent_id FROM (SELECT memory_type, agent_id, row_number() OVER (PARTITION BY memory_type ORDER BY count(*) DESC, agent_id) AS rn FROM memories GROUP BY 1, 2) WHERE rn = 1", "memories"))
def mode_agent(spark, sf):
    return refine.mode_agent(t.memories(spark, sf), "memory_type")


@query("SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def distill_merge(spark, sf):
    """Parts as entities: brands are their names, a brand has many types."""
    p = t.read(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("confidence"))
    return refine.merge_entities(p).select("pos", "name")


@query(with_tables("""SELECT m.id, CASE WHEN m.id % 5 = 0 THEN 'distill_provenance is NULL (pre-Phase-F Memo or skipped)' WHEN m.id % 5 = 1 THEN 'distill_provenance is missing correlation_id'
 WHEN m.id NOT IN (SELECT source_memory_id FROM edges) THEN 'no entity_provenance row for this Memo' WHEN NOT EXISTS (SELECT 1 FROM log l WHERE l.memory_id = m.id AND l.id % 2 = 0 AND l.user_id % 3 = m.id % 3) THEN 'no matching distill audit entry (chained or pending)' END AS reason FROM memories m""", "memories", "edges", "log"))
def provenance_verdict(spark, sf):
    blob = F.when(F.col("id") % 5 == 1, F.lit('{"job": 1}')).when(F.col("id") % 5 > 1, F.concat(F.lit('{"correlation_id": "c'), (F.col("id") % 3).cast("string"), F.lit('"}')))
    details = F.concat(F.lit('{"correlation_id": "c'), (F.col("user_id") % 3).cast("string"), F.lit('"}'))
    told = t.log(spark, sf).withColumn("operation", F.when(F.col("id") % 2 == 0, F.lit("distill")).otherwise(F.col("operation"))).withColumn("details", details)
    p = t.edges(spark, sf).select(F.col("source_memory_id").alias("memo_id"))
    return refine.provenance_verdict(t.memories(spark, sf).withColumn("distill_provenance", blob), p, told).select("id", "reason")


@query("SELECT c.c_custkey, concat('urn:n:', n.n_nationkey) AS uri FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def ontology_exact(spark, sf):
    n = t.read(spark, sf, "nation")
    names = t.read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("name"))  # 25 nations
    labels = n.select(F.col("n_name").alias("label"), F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")).alias("uri"))
    return names.join(refine.ontology_exact(names.select("name").distinct(), labels), "name").select("c_custkey", "uri")


@query()
def ontology_fuzzy(spark, sf):
    n = t.read(spark, sf, "nation")
    names = t.read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = names.select(F.concat(F.lower("n_name"), F.when(F.col("c_custkey") % 2 == 0, "s").otherwise(" land")).alias("name"), F.lit("place").alias("type"))
    return ontology.match(names, n.select(F.col("n_name").alias("label"), F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")).alias("uri"), F.lit("place").alias("type_hint")))


_CYPHER = "concat(CASE n_nationkey % 4 WHEN 0 THEN '/* CREATE */ match ' WHEN 1 THEN 'MATCH ' WHEN 2 THEN 'SET ' ELSE 'WITH 1 AS x MATCH ' END, '(n) WHERE n.name = ', n_name, CASE WHEN n_nationkey % 5 = 0 THEN ' DETACH DELETE n' ELSE ' RETURN n' END)"


@query("SELECT n_nationkey, n_nationkey % 4 <> 2 AND n_nationkey % 5 <> 0 AS read_only FROM nation")
def cypher_read_only(spark, sf):
    return t.read(spark, sf, "nation").select("n_nationkey", sc.read_only(F.expr(_CYPHER)).alias("read_only"))


@query("SELECT event_id, concat(user_id % 4, '/', strftime(ts, '%Y/%m'), '/', event_id, '.txt') AS key FROM events")
def artifact_keys(spark, sf):
    return t.read(spark, sf, "events").select("event_id", sc.artifact_key(F.col("user_id") % 4, F.col("ts"), F.col("event_id"), F.lit("a.b.TXT")).alias("key"))


@query("SELECT doc_id AS id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hashes(spark, sf):
    return refine.content_hashes(t.memories(spark, sf))


#: Six levels are enough for up to 64 leaves; odd last nodes are paired with themselves.
MERKLE_LEVEL = "l{n} AS (SELECT k, i // 2 AS i, sha256(unhex(string_agg(h, '' ORDER BY i) || CASE WHEN count(*) = 1 THEN min(h) ELSE '' END)) AS h, max(size) AS size FROM l{p} WHERE size > 1 GROUP BY k, i // 2), m{n} AS (SELECT k, i, h, count(*) OVER (PARTITION BY k) AS size FROM l{n})"
MERKLE_SQL = "leaf AS (SELECT c_nationkey AS k, sha256(concat(c_custkey, ':', sha256(c_name), ':-')) AS h FROM customer), m0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY h) - 1 AS i, h, count(*) OVER (PARTITION BY k) AS size FROM leaf), " + ", ".join(MERKLE_LEVEL.format(n=n, p=n - 1).replace(f"FROM l{n - 1} ", f"FROM m{n - 1} ") for n in range(1, 13))


@query(f"WITH {MERKLE_SQL} SELECT k AS c_nationkey, h AS merkle_root, (SELECT count(*) FROM leaf WHERE leaf.k = r.k) AS leaves FROM ({' UNION ALL '.join(f'SELECT k, h FROM m{n} WHERE size = 1' for n in range(13))}) r")
def merkle_by_nation(spark, sf):
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_name").alias("content"))
    return merkle.roots(c, "c_nationkey")


@query(with_tables(f"SELECT k AS org_id, h AS merkle_root, (SELECT count(*) FROM leaf WHERE leaf.k = r.k) AS leaves FROM ({' UNION ALL '.join(f'SELECT k, h FROM m{n} WHERE size = 1' for n in range(13))}) r", "memories", more=MERKLE_SQL.replace("SELECT c_nationkey AS k, sha256(concat(c_custkey, ':', sha256(c_name), ':-')) AS h FROM customer", "SELECT org_id AS k, sha256(concat(id, ':', sha256(coalesce(content, '')), ':-')) AS h FROM memories")))
def merkle_root(spark, sf):
    return merkle.roots(t.memories(spark, sf).select("id", "org_id", "content"), "org_id")


@query(with_tables("SELECT org_id, day AS period_day, kind, sum(amount)::BIGINT AS count FROM usage WHERE amount > 0 GROUP BY ALL", "usage"))
def usage_rollup(spark, sf):
    return refine.usage(t.usage(spark, sf))


CAPS = {"tokens": 1000, "llm_calls": 500, "embeddings": 100_000_000, "storage_bytes": 0}
CAP_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in CAPS.items()) + ") c(kind, cap)"


@query(with_tables(f"SELECT org_id, u.kind, used, cap::BIGINT AS cap FROM (SELECT org_id, kind, sum(amount)::BIGINT AS used FROM usage WHERE amount > 0 AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1, 2) u JOIN {CAP_SQL} ON c.kind = u.kind WHERE cap > 0 AND used >= cap", "usage"))
def budget_check(spark, sf):
    a, b = (F.lit(x).cast("date") for x in ("2024-01-01", "2024-01-31"))
    return refine.budget_breaches(refine.usage(t.usage(spark, sf)), CAPS, a, b).withColumn("cap", F.col("cap").cast("long"))


@query(with_tables("""SELECT org_id, kind, w AS period, used::BIGINT AS used, cap::BIGINT AS cap FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY pos) AS rn FROM (
 SELECT u.org_id, c.kind, c.w, c.pos, sum(CASE WHEN u.kind = c.kind AND (c.w = 'monthly' OR day = DATE '2024-01-20') THEN amount ELSE 0 END) AS used, max(CASE WHEN u.org_id = 1 AND c.pos = 1 THEN 10 ELSE c.cap END) AS cap FROM usage u CROSS JOIN (VALUES ('tokens', 'daily', 1, 100000), ('tokens', 'monthly', 2, 60000), ('llm_calls', 'daily', 3, 5), ('llm_calls', 'monthly', 4, 0), ('embeddings', 'daily', 5, 0), ('embeddings', 'monthly', 6, 1)) c(kind, w, pos, cap)
 WHERE amount > 0 AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY ALL) WHERE cap > 0 AND used >= cap) WHERE rn = 1""", "usage"))
def budget_first_breach(spark, sf):
    own = spark.range(1, 2).select(F.col("id").alias("org_id"), F.lit("daily_tokens").alias("name"), F.lit(10).alias("cap"))
    defaults = {"daily_tokens": 100_000, "monthly_tokens": 60_000, "daily_llm_calls": 5, "monthly_embeddings": 1}
    return refine.first_breach(refine.usage(t.usage(spark, sf)), own, defaults, "2024-01-20")


@query(with_tables("SELECT org_id, sum(CASE WHEN kind = 'tokens' THEN amount ELSE 0 END)::BIGINT AS tokens, sum(CASE WHEN kind = 'embeddings' THEN amount ELSE 0 END)::BIGINT AS embeddings, sum(CASE WHEN kind = 'llm_calls' THEN amount ELSE 0 END)::BIGINT AS llm_calls, sum(CASE WHEN kind = 'storage_bytes' THEN amount ELSE 0 END)::BIGINT AS storage_bytes, count(DISTINCT day) AS days FROM usage WHERE amount > 0 AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1", "usage"))
def usage_window(spark, sf):
    return refine.usage_window(refine.usage(t.usage(spark, sf)), "2024-01-03", "2024-01-09").select("org_id", *refine.KINDS, F.size("by_day").cast("long").alias("days"))


@query(with_tables("SELECT search_batch_id, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'running') AS n_running, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'failed') AS n_failed, string_agg(id::VARCHAR, ',' ORDER BY updated_at, id) AS job_ids FROM jobs GROUP BY 1", "jobs"))
def search_batch_aggregate(spark, sf):
    return refine.batch_status(t.jobs(spark, sf))


@query(with_tables("SELECT id, 'failed' AS status, updated_at FROM jobs WHERE status = 'running' AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at) > 80000 * 1000000::BIGINT ORDER BY updated_at, id LIMIT 10", "jobs"))
def stale_jobs(spark, sf):
    return refine.stale_jobs(t.jobs(spark, sf), t.now(), 80_000, 10).select("id", "status", "updated_at")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index, role FROM conversations")
def conversation_turns(spark, sf):
    return refine.turns(t.read(spark, sf, "conversations")).select("conv_id", F.col("turn_index").cast("long").alias("turn_index"), "role")


@query("SELECT conv_id AS id, count(*) AS turn_count FROM conversations GROUP BY 1 HAVING count(*) - floor(count(*) / 2) >= 3")
def needs_summary(spark, sf):
    return refine.needs_summary(t.conversations(spark, sf)).select("id", "turn_count")


@query("SELECT n_nationkey AS org_id FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN DATE '2024-01-01' + CAST((n_nationkey * 7) % 20 AS INTEGER) END AS d FROM nation) ORDER BY d ASC NULLS FIRST, n_nationkey LIMIT 9")
def tenant_rotation(spark, sf):
    x = t.read(spark, sf, "nation").select(F.col("n_nationkey").alias("org_id"), F.when(F.col("n_nationkey") % 4 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_nationkey") * 7 % 20).cast("int"))).alias("refine_last_run_at"))
    return refine.rotation(x, 9).select("org_id")


# --- text and loaders ------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS tk FROM documents)
SELECT id, k AS chunk_index, len(tk[k * 80 + 1 : k * 80 + 100])::BIGINT AS n_tokens, md5(array_to_string(tk[k * 80 + 1 : k * 80 + 100], ' ')) AS chunk_md5 FROM (SELECT *, unnest(range(0, greatest(1, ceil((len(tk) - 20) / 80.0::DOUBLE))::BIGINT)) AS k FROM w WHERE len(tk) > 0)""")
def chunk_tokens(spark, sf):
    d = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.token_chunks(d, 100, 20).select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("chunk").alias("chunk_md5"))


@query("""WITH parts AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+|[ \\t\\n\\r]+')) AS part, generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\r]+|[ \\t\\n\\r]+'), 1) AS i FROM documents),
ends AS (SELECT *, sum(len(part)) OVER (PARTITION BY id ORDER BY i) AS till FROM parts),
tokens AS (SELECT id, till - len(part) AS a, till AS b, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS n, count(*) OVER (PARTITION BY id) AS whole FROM ends WHERE NOT regexp_matches(part, '^[ \\t\\n\\r]')),
windows AS (SELECT *, unnest(range(greatest(0, (n - 100) // 80), n // 80 + 1)) AS k FROM tokens),
w AS (SELECT id, k, count(*) AS n_tokens, min(a) AS a, max(b) AS b FROM windows WHERE n BETWEEN k * 80 AND k * 80 + 99 AND (k = 0 OR k * 80 + 20 < whole) GROUP BY 1, 2)
SELECT w.id, k::BIGINT AS chunk_index, n_tokens, a::BIGINT AS char_start, b::BIGINT AS char_end, md5(substr(text, a::BIGINT + 1, (b - a)::BIGINT)) AS chunk_md5 FROM w JOIN documents d ON d.doc_id = w.id""")
def chunk_offsets(spark, sf):
    """Windows of tokens as they stand in the texts, with their places."""
    d = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    x = text.token_windows(d, 100, 20)
    return x.select("id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "n_tokens", "char_start", "char_end")], F.md5("chunk").alias("chunk_md5"))


#: Paragraphs in SQL: a list of starts and ends, packed by a recursion over them.
PARAGRAPHS = """parts AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '\\n\\s*\\n|[^\\n]+|\\n')) AS part, generate_subscripts(regexp_extract_all(text, '\\n\\s*\\n|[^\\n]+|\\n'), 1) AS i FROM documents WHERE text <> ''),
till AS (SELECT *, sum(len(part)) OVER (PARTITION BY id ORDER BY i) AS e, regexp_matches(part, '^\\n\\s*\\n$') AS gap FROM parts),
run AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM till),
para AS (SELECT id, g, min(e - len(part)) AS a, max(e) AS b, string_agg(part, '' ORDER BY i) AS body FROM run WHERE NOT gap GROUP BY 1, 2),
solid AS (SELECT id, a::BIGINT AS a, b::BIGINT AS b, row_number() OVER (PARTITION BY id ORDER BY a) AS r FROM para WHERE regexp_matches(body, '\\S')),
packed AS (SELECT id, r, a, b, 0 AS k, a AS s FROM solid WHERE r = 1
 UNION ALL SELECT x.id, x.r, x.a, x.b, CASE WHEN x.b - p.s <= 2000 THEN p.k ELSE p.k + 1 END, CASE WHEN x.b - p.s <= 2000 THEN p.s ELSE x.a END FROM packed p JOIN solid x ON x.id = p.id AND x.r = p.r + 1)"""


@query(f"WITH RECURSIVE {PARAGRAPHS} SELECT id, k AS chunk_index, min(s)::INT AS char_start, max(b)::INT AS char_end, greatest(1, (max(b) - min(s)) // 4)::INT AS token_count FROM packed GROUP BY 1, 2")
def chunk_paragraphs(spark, sf):
    return text.paragraph_chunks(t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def load_html(spark, sf):
    return loaders.html_loaded(t.read(spark, sf, "pages"))


@query("SELECT doc_id, (len(text) - len(replace(text, chr(10), '')) + CASE WHEN len(text) > 0 AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS line_count, len(regexp_extract_all(text, '(?m)^[ \\t]{0,3}#{1,6}[ \\t]+'))::BIGINT AS headings FROM documents")
def markdown_stats(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", loaders.line_count(F.col("text")).cast("long").alias("line_count"), loaders.heading_count(F.col("text")).cast("long").alias("headings"))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id % 1000 AS id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def counter_stream(spark, sf):
    folder = f"{shared_folder(spark)}/counter-{uuid.uuid4().hex}"
    got = streams.run_over(spark, f"{sf}/events.parquet", streams.counter_stream, folder, ["event_id % 1000 AS id"], "event_type IN ('view', 'click')")
    return got.groupBy("id").agg(F.sum("n").alias("n"))


@query("WITH RECURSIVE log AS (SELECT event_id AS id, user_id % 4 AS org_id, user_id % 3 AS agent_id, user_id, NULL::VARCHAR AS memory_type, event_type AS operation, event_id % 1000 AS memory_id, props AS details, ts AS created_at FROM events), " + CHAIN_SQL + " SELECT org_id, id, row_hash FROM chain")
def audit_stream(spark, sf):
    folder = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    columns = ["event_id AS id", "user_id % 4 AS org_id", "user_id % 3 AS agent_id", "user_id", "event_type AS operation", "event_id % 1000 AS memory_id", "props AS details", "ts AS created_at"]
    return streams.run_over(spark, f"{sf}/events.parquet", streams.chain_stream, folder, columns).select("org_id", "id", F.hex("row_hash").alias("row_hash"))


#: Events as reports of jobs, one a user: a job that is running and silent for two days has gone stale.
REPORTS = ["user_id AS job_id", "ts AS at", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status"]


@query("""WITH r AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heard, max(ts) OVER () AS latest FROM events)
SELECT job_id, ts AS updated_at, ts + INTERVAL 2 DAY AS failed_at, 'watchdog: stale running >172800s; row never transitioned' AS error FROM r
WHERE status = 'running' AND (heard IS NULL OR heard > ts + INTERVAL 2 DAY) AND epoch_ms(latest) > (epoch_us(ts) + 172800000000 + 999) // 1000""")
def watchdog_stream(spark, sf):
    """All jobs that went stale, by event-time timers."""
    folder = f"{shared_folder(spark)}/watchdog-{uuid.uuid4().hex}"
    start = lambda reports, checkpoint, sink: watchdog.watch(reports, checkpoint, sink, 172_800)
    got = streams.run_over(spark, f"{sf}/events.parquet", start, folder, REPORTS)
    return got.select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("updated_at", "failed_at")], "error")
