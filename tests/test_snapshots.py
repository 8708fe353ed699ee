"""Changes of tables in a folder a tenant, what a store leaves beside the memories, and surroundings of seeds."""

import os

import pytest
from pyspark.sql import functions as F

from recollect.engine import gateway
from recollect.engine import recall as rc
from recollect.operators import graph, mutations
from recollect.plans import tables
from recollect.sources import snapshots

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(spark, path):
    return sorted((r.org_id, r.id, r.content, r.valid_to is None) for r in spark.read.parquet(path).collect())


def test_changes_touch_the_named_tenants_alone(spark, tmp_path):
    path = str(tmp_path / "memories")
    m = tables.memories(spark, SF).withColumn("valid_from", F.col("created_at")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    snapshots.create(m, path, files=2)
    assert rows(spark, path) == sorted((r.org_id, r.id, r.content, True) for r in m.collect())
    before = files(path)
    live = m.filter("org_id = 1 and deleted_at is null").select("id").limit(3)
    changes = live.select(F.lit(1).cast("long").alias("org_id"), "id", F.lit("new").alias("content"))
    ids = {r.id for r in live.collect()}
    snapshots.update(spark, path, changes, tables.now())
    after = files(path)
    assert {f: t for f, t in before.items() if "org_id=1" not in f} == {f: t for f, t in after.items() if "org_id=1" not in f}
    got = rows(spark, path)
    assert {(i, live) for o, i, c, live in got if c == "new"} == {(i, True) for i in ids} and len(got) == m.count() + 3
    new = spark.createDataFrame([(10_001, 2, 0, "fresh", "semantic"), (10_002, 9, 0, "of a new tenant", "semantic")], "id long, org_id long, agent_id long, content string, memory_type string")
    snapshots.store(spark, path, new, tables.now())
    assert set(after.items()) <= set(files(path).items())  # all old files stay
    assert {(o, i) for o, i, *_ in rows(spark, path)} >= {(2, 10_001), (9, 10_002)}
    with pytest.raises(mutations.StoreError):
        snapshots.store(spark, path, new, tables.now())
    snapshots.forget(spark, path, spark.createDataFrame([(9, 10_002), (2, 10_001), (77, 5)], "org_id long, id long"))
    assert not os.path.exists(f"{path}/org_id=9") and os.path.exists(f"{path}/org_id=2") and rows(spark, path) == got
    plan = spark.read.parquet(path).filter("org_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org_id" in plan


def test_store_leaves_relationships_audit_and_versions(spark):
    m = tables.memories(spark, SF)
    schema = "id long, org_id long, agent_id long, content string, memory_type string, relationships array<struct<target_id:long,type:string,weight:double>>"
    make = lambda *links: spark.createDataFrame([(9001, 1, 0, "a", "semantic", list(links)), (9002, 1, 0, "b", "episodic", None)], schema)
    got = mutations.stored(m, make((5, "supports", 0.5), (9002, "related_to", None)), tables.now())
    assert {(r.source_memory_id, r.target_memory_id, r.relationship_type, r.weight) for r in got["relationships"].collect()} == {(9001, 5, "supports", 0.5), (9001, 9002, "related_to", 1.0)}
    assert {(r.memory_id, r.operation, r.details) for r in got["audit"].collect()} == {(9001, "store", '{"memory_type":"semantic","relationship_count":2}'), (9002, "store", '{"memory_type":"episodic","relationship_count":0}')}
    assert {(r.memo_id, r.version) for r in got["versions"].collect()} == {(9001, 1), (9002, 1)} and got["memories"].count() == m.count() + 2
    for bad in ((5, "likes", 1.0), (5, "supports", 1.5), (9001, "supports", 1.0)):
        with pytest.raises(mutations.StoreError):
            mutations.stored(m, make(bad), tables.now())


def test_context_is_bounded_and_rides_on_the_seeds(spark):
    m = spark.createDataFrame([(i, 0, f"t{i}", "semantic", None, 0.5, "{}", [1.0, i / 10.0]) for i in range(9)], "id long, org_id long, content string, memory_type string, deleted_at timestamp_ntz, importance_score double, metadata string, embedding array<double>")
    m = m.withColumn("deleted_at", F.when(F.col("id") == 8, tables.now())).withColumn("created_at", tables.now()).withColumn("agent_id", F.lit(0))
    pairs = [(0, i) for i in range(1, 6)] + [(0, 1), (1, 6), (6, 7), (0, 8)]
    e = spark.createDataFrame([(k, 0, a, b, "supports", 1.0) for k, (a, b) in enumerate(pairs)], "id long, org_id long, source_memory_id long, target_memory_id long, relationship_type string, weight double")
    got = {r.id: r.graph_context for r in graph.context(m.filter("id in (0, 7)").select("id"), m, e, 2, 4).collect()}
    assert [n.id for n in got[0].nodes] == [1, 2, 3, 4] and [x.target for x in got[0].edges] == [1, 2, 3, 4]
    assert [n.id for n in got[7].nodes] == [6, 1] and [(x.type, x.target) for x in got[7].edges] == [("supports", 6)]
    lone = graph.context(m.filter("id = 8").select("id"), m, e, 2).first().graph_context
    assert lone.nodes == [] and lone.edges == []
    stub = gateway.StubGateway([("t0", {"answer": "forty-two"})], {})
    ask = rc.Request(0, "what?", F.array(F.lit(1.0), F.lit(0.0)), strategy="GRAPH")
    rows = rc.Engine(m, e, tables.now(), gateway=stub).recall(ask)[0].collect()
    assert rows[0].id == 0 and rows[0].metadata == '{"graph_answer":"forty-two"}' and rows[1].metadata == "{}"
    # similarity 1, five nodes and two more (6 and, by it, none else), five edges
    assert rows[0].relevance_score == pytest.approx(0.5 + 0.3 * 1.0 + 0.1) and len(rows[0].graph_context.nodes) == 6
