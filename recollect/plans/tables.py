"""The memory domain over the driver's tables: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_TEXT = "2024-02-01 00:00:00"


def now() -> Column:
    """The clock of all queries."""
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


MEMORIES = """SELECT d.doc_id AS id, d.doc_id % 4 AS org_id, CAST((d.doc_id % 12 - d.doc_id % 4) / 4 AS BIGINT) AS agent_id,
 CAST(CASE WHEN d.doc_id % 10 < 7 THEN d.doc_id % 50 END AS BIGINT) AS user_id,
 CASE WHEN d.doc_id % 10 = 0 THEN 'working' WHEN d.doc_id % 10 <= 4 THEN 'episodic' WHEN d.doc_id % 10 <= 8 THEN 'semantic' ELSE 'procedural' END AS memory_type,
 CASE d.doc_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'CODE_FUNCTION' END AS memo_type,
 CASE WHEN d.doc_id % 11 = 0 THEN concat('urn:c:', CAST(d.doc_id % 7 AS {STRING})) END AS ontology_uri,
 d.text AS content, concat('{{"source":"', d.source, '","lang":"', d.lang, '"}}') AS metadata, e.embedding AS embedding,
 CAST((d.doc_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS importance_score, CAST(d.doc_id % 21 AS BIGINT) AS recall_count,
 {TS} '2024-01-01 00:00:00' + ((d.doc_id * 7919) % 2592000) * INTERVAL '1' SECOND AS created_at,
 CASE WHEN d.doc_id % 2 = 0 THEN {TS} '2024-01-01 00:00:00' + ((d.doc_id * 7919) % 2592000 + 3600 * (1 + d.doc_id % 48)) * INTERVAL '1' SECOND END AS last_recalled_at,
 CASE WHEN d.doc_id % 17 = 0 THEN {TS} '2024-01-31 00:00:00' END AS deleted_at, d.doc_id % 20 = 0 AS pinned,
 CASE WHEN d.doc_id % 10 = 0 THEN {TS} '2024-01-08 00:00:00' + ((d.doc_id * 7919) % 2592000) * INTERVAL '1' SECOND END AS ttl_expires_at
 FROM (SELECT x.*, x.doc_id % n.n AS vec FROM {documents} x CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM {embeddings}) n) d LEFT JOIN {embeddings} e ON e.vec_id = d.vec"""

EDGES = """SELECT s.doc_id * 3 + k.k AS id, s.doc_id % 4 AS org_id, s.doc_id AS source_memory_id, (s.doc_id * (13 + 4 * k.k) + 4 * (k.k + 1)) % n.n AS target_memory_id,
 CASE (s.doc_id + k.k) % 6 WHEN 0 THEN 'derived_from' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'supports' WHEN 3 THEN 'supersedes' WHEN 4 THEN 'related_to' ELSE 'caused_by' END AS relationship_type,
 CAST((s.doc_id * 17 + k.k * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS weight
 FROM {documents} s CROSS JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT CAST(1 AS BIGINT)) k CROSS JOIN (SELECT count(*) AS n FROM {documents}) n
 WHERE s.doc_id % 3 <> 2 AND s.doc_id <> (s.doc_id * (13 + 4 * k.k) + 4 * (k.k + 1)) % n.n"""

LOG = """SELECT event_id AS id, user_id % 4 AS org_id, CAST((user_id % 12 - user_id % 4) / 4 AS BIGINT) AS agent_id,
 CASE event_type WHEN 'signup' THEN 'store' WHEN 'view' THEN 'recall' WHEN 'click' THEN 'recall' WHEN 'purchase' THEN 'update' ELSE 'forget' END AS operation,
 event_id % 1000 AS memory_id, user_id, CASE event_id % 3 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' END AS memory_type, props AS details, ts AS created_at FROM {events}"""

CONVERSATIONS = """SELECT conv_id AS id, conv_id % 4 AS org_id, count(*) AS turn_count, CAST(floor(count(*) / 2) AS BIGINT) AS last_summary_turn, CAST(3 AS BIGINT) AS summary_cadence FROM {conversations} GROUP BY conv_id"""

VERSIONS = """SELECT id, org_id, agent_id, importance_score * CAST(0.5 AS DOUBLE) AS importance_score, recall_count, deleted_at, created_at AS valid_from, created_at + INTERVAL '3' DAY AS valid_to FROM {m} WHERE id % 5 = 0
 UNION ALL SELECT id, org_id, agent_id, importance_score, recall_count, deleted_at, CASE WHEN id % 5 = 0 THEN created_at + INTERVAL '3' DAY ELSE created_at END AS valid_from, CAST(NULL AS {TSTYPE}) AS valid_to FROM {m}"""

JOBS = """SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, page_id % 5 AS search_batch_id,
 {TS} '2024-01-31 00:00:00' + page_id * INTERVAL '1' MINUTE AS updated_at FROM {pages}"""

USAGE = """SELECT user_id % 4 AS org_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'tokens' WHEN 'click' THEN 'llm_calls' WHEN 'purchase' THEN 'embeddings' ELSE 'storage_bytes' END AS kind,
 CAST(floor(value) AS BIGINT) AS amount FROM {events} WHERE event_type <> 'error'"""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spark(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    sql = sql.replace("{TS}", "TIMESTAMP_NTZ").replace("{TSTYPE}", "TIMESTAMP_NTZ").replace("{STRING}", "STRING")
    return spark.sql(sql, **tables)


def memories(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, MEMORIES, documents=read(spark, sf, "documents"), embeddings=read(spark, sf, "embeddings"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, EDGES, documents=read(spark, sf, "documents"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, LOG, events=read(spark, sf, "events"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, VERSIONS, m=memories(spark, sf))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, JOBS, pages=read(spark, sf, "pages"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, CONVERSATIONS, conversations=read(spark, sf, "conversations"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return _spark(spark, USAGE, events=read(spark, sf, "events"))


def _duck(sql: str) -> str:
    for a, b in (("{TS}", "TIMESTAMP"), ("{TSTYPE}", "TIMESTAMP"), ("{STRING}", "VARCHAR"), ("{m}", "memories"), ("{documents}", "documents"), ("{embeddings}", "embeddings"), ("{events}", "events"), ("{pages}", "pages"), ("{conversations}", "conversations"), ("{{", "{"), ("}}", "}")):
        sql = sql.replace(a, b)
    return sql


#: Common table expressions of the same tables for DuckDB.
DUCK = {"memories": _duck(MEMORIES), "edges": _duck(EDGES), "log": _duck(LOG), "versions": _duck(VERSIONS), "jobs": _duck(JOBS), "usage": _duck(USAGE), "convs": _duck(CONVERSATIONS)}


def with_tables(sql: str, *names: str, recursive: bool = False, more: str = "") -> str:
    names = tuple(dict.fromkeys(("memories", *names))) if "versions" in names else names
    return "WITH " + "RECURSIVE " * recursive + ", ".join([f"{n} AS ({DUCK[n]})" for n in names] + ([more] if more else [])) + " " + sql
