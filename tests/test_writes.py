"""The write path, the dispatcher, providers, graph queries and the pipelines: errors, fallbacks and plain restatements."""

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.engine import cypher, gateway, pipelines
from recollect.engine import recall as rc
from recollect.functions import jsons, scalar
from recollect.operators import audit, codegraph, mutations, refine
from recollect.plans import catalog, tables, writes  # noqa: F401
from recollect.sources import loaders

SF = "/root/testdata/sf0.01"
NEW = [name for name in catalog.SQL if catalog.QUERIES[name].__module__ == "recollect.plans.writes"]


def test_new_queries_have_rows():
    """The write queries' oracles tell rows at the size of the correctness check, so that agreement says something."""
    c = duckdb.connect()
    for n in "customer nation part events documents embeddings pages conversations".split():
        c.execute(f"create view {n} as select * from read_parquet('{SF}/{n}.parquet')")
    assert len(NEW) > 30
    for name in NEW:
        assert c.execute(f"select count(*) from ({catalog.SQL[name]}) q").fetchone()[0] > 0, name


def rows_of(spark, **columns):
    base = {"id": 5, "org_id": 1, "agent_id": 1, "content": "text", "memory_type": "semantic"} | columns
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in base.items()))


@pytest.mark.parametrize("wrong", [{"content": " "}, {"content": None}, {"memory_type": "dream"}, {"importance_score": 1.5}])
def test_store_refuses(spark, wrong):
    with pytest.raises(mutations.StoreError):
        mutations.store(tables.memories(spark, "/root/testdata/sf0.001"), rows_of(spark, **wrong), tables.now())


def test_store_near_duplicate(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").filter("id = 4")
    same = m.select(F.lit(77).cast("long").alias("id"), "org_id", "agent_id", "content", "memory_type", "embedding")
    assert mutations.store(m, same, tables.now(), duplicate_threshold=1.1).count() == 2
    with pytest.raises(mutations.StoreError):
        mutations.store(m, same, tables.now(), duplicate_threshold=0.95)


def test_update_needs_a_change(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).withColumn("valid_from", F.col("created_at"))
    with pytest.raises(mutations.StoreError):
        mutations.update(m, m.select("id"), tables.now())
    same = mutations.update(m, m.select("id", "content"), tables.now())
    assert same.count() == m.count()


def test_audit_enqueue_refuses(spark):
    log = tables.log(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        audit.enqueue(log, spark.createDataFrame([(1, "steal")], "org_id long, operation string").withColumn("created_at", tables.now()))


@pytest.mark.parametrize("value,part,want", [({"a": [1, {"b": 2}]}, {"a": [{"b": 2}]}, True), ({"a": 1}, {"a": True}, False), ({"a": [1, 2]}, {"a": 1}, False), ([1, 2], 1, True), ([[1, 2]], [1], False), ([[1, 2]], [[2]], True), ({"a": 1}, {"a": "1"}, False), ({"a": 1.0}, {"a": 1}, True), ({"a": {"b": 1}}, {"a": {}}, True), ({"a": "x"}, {"a": "y"}, False), ([1, 2], [2], True)])
def test_json_holds(value, part, want):
    assert jsons.holds(value, part) is want


def test_json_scrub(spark):
    got = spark.createDataFrame([('{"a.b@c.de":["x a.b@c.de",1]}',), (None,), ("broken",)], "j string").select(jsons.scrubbed(F.col("j"), scalar.REDACTIONS)).collect()
    assert [r[0] for r in got] == ['{"a.b@c.de":["x [REDACTED:EMAIL]",1]}', None, "broken"]


@pytest.mark.parametrize("query", ["", "CREATE (n)", "MATCH (n) DELETE n", "MATCH (a) RETURN $$", "/* MATCH */ SET a.x = 1", "MATCH (a)-[*1..99]->(b) RETURN b.id", "MATCH (a) RETURN nonsense()", "RETURN 1", "MATCH (a) RETURN a.nothing", "MATCH (a) RETURN DISTINCT a.id ORDER BY a.preview", "MATCH (a) RETURN sum(*)", "MATCH (a)-->(a) RETURN a.id"])
def test_cypher_refuses(spark, query):
    nodes = spark.createDataFrame([(1, "p")], "id long, preview string")
    edges = spark.createDataFrame([(1, 1, "l", 1.0)], "src long, dst long, label string, weight double")
    with pytest.raises(cypher.CypherError):
        cypher.run(query, nodes, edges, 5).collect()


def test_cypher_patterns(spark):
    nodes = spark.createDataFrame([(i, f"node {i}") for i in range(5)], "id long, preview string")
    edges = spark.createDataFrame([(i, i + 1, "next" if i else "first", 1.0) for i in range(4)], "src long, dst long, label string, weight double")
    ids = lambda q: [r[0] for r in cypher.run(q, nodes, edges, 10).collect()]
    assert ids("MATCH (a)-[:next]->(b) WHERE a.id = 1 RETURN b.id") == [2]
    assert ids("MATCH (a)<-[r]-(b) WHERE a.id = 1 RETURN b") == [0]
    assert ids("MATCH (a)-[*2]->(b) WHERE a.id = 0 RETURN b.id") == [2]
    assert ids("MATCH (a)-[*1..2]-(b) WHERE a.id = 2 RETURN DISTINCT b.id // end") == [0, 1, 3, 4]  # no edge is taken twice
    assert ids("MATCH (a) WHERE a.preview CONTAINS 'node' AND a.id >= 3 RETURN count(*)") == [2.0]
    assert ids("MATCH (a)-[]->(b) RETURN max(b.id)") == [4.0]
    assert ids("MATCH (a) RETURN a.id LIMIT 2") == [0, 1]
    assert ids("MATCH (a:Concept) RETURN a.id") == [] and ids("MATCH (a:Memory) RETURN a.id ORDER BY a.id DESC LIMIT 2") == [4, 3]
    assert ids("MATCH (a)-[*1..2]->(b) RETURN count(*)") == [7.0] and ids("MATCH (a)-[*2]-(b) WHERE a.id = 0 RETURN b.id") == [2]
    assert ids("MATCH (a)-[*0..1]->(b) WHERE a.id = 3 RETURN b.id ORDER BY b.id DESC") == [4, 3]
    assert ids("MATCH (a)-->(b) RETURN b.preview ORDER BY a.id DESC LIMIT 1") == ["node 4"]
    several = cypher.run("MATCH (a)-->(b) RETURN a.id AS x, b.id ORDER BY x DESC LIMIT 2", nodes, edges, 10).collect()
    assert [tuple(r) for r in several] == [(3, 4), (2, 3)]
    many = spark.createDataFrame([(0, 1, "l", 1.0, 7), (0, 1, "l", 1.0, 8), (1, 1, "l", 1.0, 9)], "src long, dst long, label string, weight double, id long")
    count = lambda q: cypher.run(q, nodes, many, 10).collect()[0][0]
    assert count("MATCH (a)-[*1..2]->(b) WHERE a.id = 0 RETURN count(*)") == 4  # two edges, each alone and with the loop
    assert count("MATCH (a)-[*2]-(b) WHERE a.id = 0 AND b.id = 0 RETURN count(*)") == 2  # there by one, back by the other


def test_dispatcher_errors_and_fallbacks(spark):
    m, e = tables.memories(spark, "/root/testdata/sf0.001"), tables.edges(spark, "/root/testdata/sf0.001")
    engine = rc.Engine(m, e, tables.now())
    with pytest.raises(rc.UnknownStrategyError):
        engine.recall(rc.Request(0, strategy="GUESS"))
    with pytest.raises(rc.CypherDisabledError):
        engine.recall(rc.Request(0, strategy="CYPHER", extra={"raw_cypher": "MATCH (a) RETURN a.id"}))
    with pytest.raises(ValueError):
        engine.recall(rc.Request(0, weights=(1.0, 1.0, 1.0)))
    assert engine.recall(rc.Request(0))[1]["strategy"] == "VECTOR"
    told = gateway.StubGateway([("", {"strategy": "GRAPH"})])
    assert rc.Engine(m, e.limit(0), tables.now(), told).route(rc.Request(0, "q")) == "VECTOR"
    assert rc.Engine(m, e, tables.now(), told).route(rc.Request(0, "q")) == "GRAPH"
    for name in ("LEXICAL", "GRAPH", "TRIPLET", "TEMPORAL", "ASK"):
        assert engine.recall(rc.Request(0, strategy=name))[0].count() == 0
    assert engine.tiers("how do I reset") == ["procedural"] and engine.tiers("") == ["working", "episodic", "semantic", "procedural"]
    rows, _ = engine.recall(rc.Request(0, top_k=3))
    assert engine.counted(rows).filter("last_recalled_at = timestamp_ntz'2024-02-01 00:00:00'").count() == 3


def test_triplet_and_trace(spark):
    m, e = tables.memories(spark, "/root/testdata/sf0.001"), tables.edges(spark, "/root/testdata/sf0.001")
    probe = F.lit([float(x) for x in tables.read(spark, "/root/testdata/sf0.001", "embeddings").filter("vec_id = 0").first().embedding])
    seen = []
    engine = rc.Engine(m, e, tables.now(), rules=scalar.REDACTIONS, reranker=lambda q: F.col("importance_score"))
    engine.steps.append(lambda k, q: seen.append(k))
    again = lambda k, r: rc.Request(**{**r.__dict__, "query": r.query + "!"}) if k == 0 else None
    rows, done = engine.recall(rc.Request(0, "q", probe, "TRACE", threshold=-1.0, extra={"refine": again}))
    got = rows.collect()
    assert done["strategy"] == "TRACE" and seen == [0, 1] and len({r.id for r in got}) == len(got) > 0
    rows, _ = rc.Engine(m, e, tables.now()).recall(rc.Request(0, strategy="TRIPLET", extra={"triplet": ["tion", "?", "?"]}))
    assert rows.count() == 0  # two unknowns
    assert rc.Engine(m, e, tables.now()).recall(rc.Request(0, strategy="TRIPLET", extra={"triplet": ["the", "supports", "?"]}))[0].count() >= 0


def test_gateway_tries_again():
    calls = []

    class Flaky:
        def complete(self, system, user):
            calls.append(1)
            if len(calls) < 3:
                raise OSError("busy")
            return {"ok": True}

    assert gateway.Retrying(Flaky(), pause=0).complete("s", "u") == {"ok": True}
    with pytest.raises(gateway.GatewayError):
        gateway.Retrying(gateway.StubGateway([]), pause=0).complete("s", "u")


def test_providers(spark):
    class Found:
        def search(self, query, limit):
            return [{"url": f"http://x/{k}", "score": "bad" if k else 0.5} for k in range(limit)] + [{"title": "no url"}]

    got = gateway.web_search(spark, Found(), ["a"], 50).collect()
    assert len(got) == 20 and {r.score for r in got} == {0.0, 0.5}
    files = spark.createDataFrame([("a.png", b"x"), ("b.png", b"y")], "path string, content binary")
    texts = {r.path: r.text for r in gateway.described(files, lambda c: {"caption": "cat", "ocr": c.decode()}, "image").collect()}
    assert texts == {"a.png": "cat\n\nOCR: x", "b.png": "cat\n\nOCR: y"}
    v = [r[0] for r in spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(gateway.hash_embedding(F.col("t"))).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[2] is None


def test_loader_dispatch(spark):
    zipped = b"PK\x03\x04" + b"." * 30 + b"word/document.xml"
    cases = [("a.bin", b"%PDF-1.7", None, "pdf"), ("a.zip", zipped, None, "docx"), ("x.md", b"# t", None, "markdown"), ("x.py", b"a = 1", None, "code"), ("x", b"plain", "text/CSV; charset=utf-8", "csv"), ("y.dat", b"plain", None, "text"), ("p", b"GIF87a..", None, "image"), ("w", b"RIFF....WAVE", None, "audio"), ("m", b"\xff\xfb..", None, "audio")]
    files = spark.createDataFrame([c[:3] for c in cases], "path string, content binary, mime_type string")
    got = {r.path: r.loader for r in loaders.dispatched(files).collect()}
    assert got == {c[0]: c[3] for c in cases}
    text = {r.path: (r.text, r.error) for r in loaders.load(files).collect()}
    assert text["x.md"] == ("# t", None) and text["x"][0] == "CSV columns: plain" and text["p"][1] and text["a.bin"][1]


def test_ontology_triples(spark):
    label, alt, kind = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#altLabel", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    lines = [f'<http://o/A> <{label}> "Alpha"@en .', f'<http://o/A> <{alt}> "First" .', f"<http://o/A> <{kind}> <http://o#Letter> .", f"<http://o/B> <{kind}> <http://o#Letter> .", "# comment", ""]
    got = {r.uri: (r.primary, r.aliases, r.type_hint) for r in loaders.triples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"http://o/A": ("Alpha", ["First"], "Letter"), "http://o/B": ("B", None, "Letter")} or got["http://o/B"][0] == "B"


def test_code_symbols():
    nodes, edges = codegraph.symbols("a/b.py", "import os\nfrom x import y\nclass C(D):\n    def f(self):\n        return g(h())\ndef g(): pass\n")
    assert ("CLASS", "a.b.C", "C") in nodes and ("FUNCTION", "a.b.C.f", "f") in nodes and ("IMPORT", "a.b:x", "x") in nodes
    assert {("INHERITS", "a.b.C", "D"), ("CALLS", "a.b.C.f", "g"), ("CALLS", "a.b.C.f", "h"), ("DEFINES", "a.b", "a.b.g"), ("IMPORTS", "a.b", "os")} <= set(edges)
    assert codegraph.symbols("a.py", "def (") == ([("MODULE", "a", "a")], [])


def test_forge_errors_and_refine_cycle(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").filter("id < 6")
    got = pipelines.forge(m, gateway.StubGateway([]), "j")
    assert got["memos"].count() == 0 and got["errors"].count() >= 6
    m = writes._valid(spark, "/root/testdata/sf0.001")
    e = tables.edges(spark, "/root/testdata/sf0.001")
    stub = gateway.StubGateway([("Candidates:", {"edges": [{"target_id": 8, "predicate": "Related To", "confidence": 0.8}, {"target_id": 8, "predicate": "knows", "confidence": 0.9}, {"target_id": 10**9, "predicate": "supports", "confidence": 1}]})], {"summary": "all of it"})
    feedback = spark.createDataFrame([(0, 1)], "edge_id long, signal int")
    out = pipelines.refined(m, e, feedback, tables.now(), stub)
    assert {r.summary for r in out["summaries"].collect()} == {"all of it"}
    live = m.filter("deleted_at is null and memo_type is not null and org_id = 0").orderBy("id").limit(50)
    known = {(r[0], r[1]) for r in e.select("source_memory_id", "target_memory_id").collect()}
    focal = [r.id for r in live.collect() if sum(a == r.id for a, _ in known) < 5]
    made, counters = pipelines.infer(m, e, stub)
    assert {(r.source_memory_id, r.target_memory_id, r.relationship_type) for r in made.collect()} == {(i, 8, "related_to") for i in focal if i != 8 and (i, 8) not in known}
    row = {r.org_id: r for r in counters.collect()}[0]
    assert (row.candidates_examined, row.calls, row.edges_proposed) == (live.count(), len(focal), 3 * len(focal))
    assert out["edges"].count() > e.filter("weight >= 0.05").count()
    done = out["summaries"].select("cluster_hash")
    live = m.filter("deleted_at is null and memo_type is not null").select("id", "valid_from", "content")
    assert pipelines.summarise(live.withColumn("component", F.lit(1)), stub, done.unionByName(refine.cluster_hash(live.withColumn("component", F.lit(1)), "component", "id").select("cluster_hash"))).count() == 0


def test_usage_window_range(spark):
    with pytest.raises(ValueError):
        refine.usage_window(refine.usage(tables.usage(spark, "/root/testdata/sf0.001")), "2024-01-09", "2024-01-03")


def test_store_and_update_refuse_repeated_ids_and_near_copies_of_a_batch(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").limit(3)
    rows = rows_of(spark)
    with pytest.raises(mutations.StoreError):
        mutations.store(m, rows.union(rows), tables.now())
    with pytest.raises(mutations.StoreError):
        mutations.store(mutations.store(m, rows, tables.now()), rows, tables.now())
    schema = "id long, org_id long, agent_id long, content string, memory_type string, embedding array<double>"
    batch = lambda *agents: spark.createDataFrame([(900 + i, 1, a, f"t{i}", "episodic", [1.0, 2.0 + i * 1e-6]) for i, a in enumerate(agents)], schema)
    held = m.withColumn("embedding", F.col("embedding").cast("array<double>"))
    with pytest.raises(mutations.DuplicateMemoryError) as refused:
        mutations.store(held, batch(5, 5), tables.now(), duplicate_threshold=0.95)
    assert refused.value.existing_id in (900, 901) and refused.value.similarity > 0.95
    assert mutations.store(held, batch(5, 6, None), tables.now(), duplicate_threshold=0.95).count() == 6
    history = m.withColumn("valid_from", F.col("created_at")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    some = history.filter("deleted_at is null").limit(1).select("id", F.lit("x").alias("content"))
    with pytest.raises(mutations.StoreError):
        mutations.update(history, some.union(some), tables.now())


def test_ingest_knows_files_by_dataset(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").limit(2).withColumn("dataset_id", F.lit(None).cast("string"))
    files = spark.createDataFrame([("/a.txt", b"text"), ("/b.txt", b" ")], "path string, content binary")
    status = lambda m, d: {r.source_uri: r.status for r in pipelines.ingest(m, files, 1, 1, tables.now(), d)[1].collect()}
    once = pipelines.ingest(m, files, 1, 1, tables.now(), "d1")[0]
    assert {r.content for r in once.filter("dataset_id = 'd1' and memory_type = 'episodic'").collect()} == {"text", "(empty)"}
    assert status(once, "d1") == {"/a.txt": "skipped", "/b.txt": "skipped"}
    assert status(once, "d2") == status(once, None) == {"/a.txt": "completed", "/b.txt": "completed"}
    assert pipelines.ingest(once, files, 1, 1, tables.now(), "d2")[0].filter("dataset_id is not null").select("id").distinct().count() == 4


def test_rolling_summaries_call_once_a_chunk_and_turn(spark):
    class Counting:
        """Answers with the length of what it is asked, as text."""

        def complete(self, system, user):
            return {"summary": "" if "silent" in user else f"<{user[:12]}>"}

    rows = [(1, 0, "one")] + [(2, k, f"part {k}") for k in range(9)] + [(3, 0, " "), (3, 1, "silent")] + [(4, 0, "silent"), (4, 1, "spoken")]
    got = {r.id: (r.summary, r.calls) for r in pipelines.rolling(spark.createDataFrame(rows, "id long, chunk_index int, text string"), Counting(), 4).collect()}
    # nine parts: nine calls, then turns of 4, 4 and 1 (two calls), then one of three
    assert got == {1: ("<one>", 1), 2: ("<- <- <part 0>", 12), 4: ("<spoken>", 2)}


def test_forge_keeps_a_summary_a_memory_and_skips_what_is_done(spark):
    m = tables.memories(spark, "/root/testdata/sf0.001").filter("id < 8 and trim(content) <> ''")
    stub = gateway.StubGateway([], {"summary": "short"})
    got = pipelines.forge(m, stub, "j", done=m.filter("id = 1").select("id"))
    memos = got["memos"].collect()
    assert {(r.memo_type, r.content) for r in memos} == {("SUMMARY", "short")} and {r.source_id for r in memos} == {r.id for r in m.collect()} - {1}
    assert sum(r.memos_written for r in got["jobs"].collect()) == len(memos) and {r.status for r in got["jobs"].collect()} == {"completed"}
    every = m.select("org_id").distinct().withColumns({"kind": F.lit("tokens"), "period": F.lit("daily"), "used": F.lit(7), "cap": F.lit(5)})
    stopped = pipelines.forge(m, gateway.StubGateway([]), "j", breaches=every)
    assert stopped["errors"].count() == 0 and {(r.status, r.error) for r in stopped["jobs"].collect()} == {("rejected", "daily tokens budget exceeded: used=7 cap=5")}


def test_graph_queries_stay_within_a_tenant(spark):
    """An edge to another tenant's memory is neither walked nor counted, and that memory isn't returned."""
    m = spark.createDataFrame([(1, 1, "semantic"), (2, 2, "semantic"), (3, 1, "semantic")], "id long, org_id long, memory_type string").withColumn("content", F.lit("x")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    edges = spark.createDataFrame([(7, 1, 1, 2, "supports", 1.0), (8, 1, 1, 3, "supports", 1.0)], "id long, org_id long, source_memory_id long, target_memory_id long, relationship_type string, weight double")
    engine = rc.Engine(m, edges, tables.now(), allow_cypher=True)
    ask = lambda query: engine.recall(rc.Request(1, strategy="CYPHER", extra={"raw_cypher": query}))[0].collect()
    assert [r.aggregate for r in ask("MATCH (a)-[:supports]->(b) RETURN count(*)")] == [1.0]
    assert [r.id for r in ask("MATCH (a)-[:supports]->(b) RETURN DISTINCT b.id")] == [3]


def test_budgets_leave_contents_where_they_are(spark):
    """Breached tenants are told to the memories; contents aren't dealt by tenant, where a tenant would be one task."""
    m = tables.memories(spark, "/root/testdata/sf0.001")
    breaches = spark.range(100).groupBy((F.col("id") % 2 * 2).alias("org_id")).agg(F.lit("tokens").alias("kind"), F.lit("monthly").alias("period"), F.count("*").alias("used"), F.lit(1).alias("cap"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = pipelines.forge(m, writes.STUB, "j", summaries=False, breaches=breaches)["jobs"]
        plan = jobs._jdf.queryExecution().executedPlan().toString()
        assert {r.org_id: r.status for r in jobs.collect()} == {0: "rejected", 1: "completed", 2: "rejected", 3: "completed"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and all("BroadcastHashJoin" in line for line in anti)
