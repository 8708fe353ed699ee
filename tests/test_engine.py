"""Queries against their SQL in DuckDB, and pure functions against plain restatements."""

import hashlib
import io
import json
import re
import zipfile

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from recollect.functions import scalar
from recollect.operators import audit, merkle, ontology, refine, text
from recollect.plans import catalog, tables
from recollect.sources import loaders
from recollect.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {n} as select * from read_parquet('{SF}/{n}.parquet')")
    return c


def plain(rows):
    return sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]}) q").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_lexical_recall_stems_and_drops_stop_words(spark):
    from recollect.functions.porter import stem

    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit generalization:gener oscillators:oscil triplicate:triplic hopeful:hope adoption:adopt probate:probat controll:control"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split()))
    m = catalog.memory.scan(catalog.t.memories(spark, SF), 0).limit(4).drop("content").toPandas()
    m["content"] = ["It relates to 42 motors, ok", "relation of the motor", "motoring 42 go", "this with"][: len(m)]
    docs = spark.createDataFrame(m[["id", "content", "importance_score", "created_at"]])
    ids = lambda q: {r.content for r in text.lexical_recall(docs, q, catalog.t.now()).collect()}
    assert ids("the related motor") == {m["content"][0], m["content"][1]}
    assert ids("42 motors") == {m["content"][0], m["content"][2]} and ids("go") == {m["content"][2]}
    assert ids("this with") == set()


def test_hash_chain_by_plain_fold(spark):
    got = audit.hash_chain(tables.log(spark, SF).filter("id < 40")).orderBy("org_id", "id").collect()
    before = {}
    for r in got:
        plain = {
            "org_id": str(r.org_id), "operation": r.operation, "agent_id": str(r.agent_id), "user_id": str(r.user_id), "memory_id": str(r.memory_id),
            "memory_type": r.memory_type, "details": json.loads(r.details), "created_at": r.created_at.isoformat(),
        }
        text = json.dumps(plain, sort_keys=True, separators=(",", ":"))
        want = hashlib.sha256(before.get(r.org_id, b"") + text.encode()).digest()
        assert bytes(r.row_hash) == want and (r.prev_hash or b"") == before.get(r.org_id, b"")
        before[r.org_id] = want


def test_chain_stream_goes_on_over_batches(spark, tmp_path):
    """Three files, a micro-batch each, make the chain that all rows make at once; a batch that runs again changes nothing."""
    log = tables.log(spark, SF).filter("id < 300").cache()
    for k in range(3):
        log.filter(f"id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.chain_stream(source, str(tmp_path / "state"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 3
    rows = lambda df: sorted((r.org_id, r.id, bytes(r.row_hash)) for r in df.collect())
    assert rows(got) == rows(audit.hash_chain(log))
    assert audit.verify(got).isEmpty()


def test_cadence_stream(spark, tmp_path):
    turns = spark.createDataFrame([(c, k) for c in range(3) for k in range(7 + c)], "conv_id long, turn long")
    turns.repartition(3, "turn").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.cadence_stream(source, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 3), (0, 6), (1, 3), (1, 6), (2, 3), (2, 6), (2, 9)]


def test_redaction_by_plain_patterns(spark):
    texts = ["mail a.b@c.de or x@y.co, ssn 123-45-6789, card 4111 1111 1111 1111 é", "call +1 (555) 555-0134 or 555.123.4567", "nothing 12-34 here", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.redacted(F.col("t"))).collect()]
    want = []
    for t in texts:
        for _, pattern, mark in scalar.REDACTIONS:
            t = t and re.sub(pattern, mark, t)
        want.append(t)
    assert got == want


@given(st.lists(st.binary(min_size=1, max_size=8), max_size=9))
def test_merkle_ignores_order(leaves):
    assert merkle.merkle(leaves) == merkle.merkle(leaves[::-1])


@given(st.text(alphabet="ab \n", max_size=200))
def test_paragraph_spans_are_ordered_and_whole(s):
    spans = text.pack_paragraphs(s, 20)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join(s[a:b] for a, b in spans).replace("\n", "").replace(" ", "") == s.replace("\n", "").replace(" ", "")


def test_csv_and_html():
    assert loaders.csv_text("a;b\n1;2\n3\n") == ("CSV columns: a, b\n\na: 1; b: 2\n\na: 3; b: ", False)
    assert loaders.html_text("<title>T</title><nav>x</nav><article><p>One</p><p>two</p></article>") == "# T\n\nOne\ntwo"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="H9"><w:name w:val="heading 9"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    head = '<w:p><w:pPr><w:pStyle w:val="H9"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>'
    good = docx(head + "<w:p/><w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:r><w:t>b</w:t></w:r></w:p>")
    rows = spark.createDataFrame([("x", bytearray(good)), ("y", bytearray(b"PK no")), ("z", None)], "path string, content binary")
    got = {r.path: r for r in loaders.docx_loaded(rows).collect()}
    assert (got["x"].text, got["x"].headings) == ("###### Top\n\na\tb", 1)
    assert got["y"].text is None and got["y"].error and got["z"].text == ""


def test_ontology_match_by_brute_force(spark):
    words = ["red fox", "fox red", "Red  Fox", "ox", "oxe", "the red fox den", "blue whale", "blu whale", "b", "a b", "cart", "card", "cards", ""]
    labels = [(w, f"u{i:02}", "animal" if i % 2 else None) for i, w in enumerate(words)]
    got = {r.name: (r.uri, round(r.score, 9)) for r in ontology.match(spark.createDataFrame([(w, "animal") for w in words], "name string, type string"), spark.createDataFrame(labels, "label string, uri string, type_hint string")).collect()}
    want = {}
    for w in words:
        all_of = [(w.lower() != lab.lower(), -min(1.0, ontology.token_set(w.lower(), lab.lower()) + (0.05 if hint else 0)), uri) for lab, uri, hint in labels if w.strip() and lab.strip()]
        if all_of := [x for x in all_of if x[1] <= -0.8]:
            want[w] = (min(all_of)[2], round(-min(all_of)[1], 9))
    assert got == want


def test_indel():
    assert ontology.indel("card", "cart") == 0.75 and ontology.indel("", "a") == 0 and ontology.token_set("a b", "b") == 1
