"""The positional inverted index and the inverted file of vectors, against plain restatements over all rows."""

import math
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.engine import recall as rc
from recollect.functions.porter import positioned_terms
from recollect.operators import inverted, nearest



def now():
    return F.lit("2024-02-01").cast("timestamp_ntz")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- text ------------------------------------------------------------------------------------------------------------


def plain_rank(lists):
    """Full-text rank of a text from the positions of each asked term."""
    lists = [[min(p, 16383) for p in x[:256]] for x in lists]
    if len(lists) == 1:
        return float(np.float32(sum(0.1 / j**2 for j in range(1, len(lists[0]) + 1)) / 1.64493406685))
    apart = 1.0
    for i in range(len(lists)):
        for j in range(i):
            for p in lists[i]:
                for q in lists[j]:
                    d = abs(p - q)
                    apart *= 1 - math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))) if d else 1
    return float(np.float32(max(1 - apart, 1e-20)))


def texts(n=300, seed=3):
    r = random.Random(seed)
    names = ["Motor", "motors", "relate", "relation", "the", "of", "42", "Ärger", "x-y", "don't", "stop"]
    rows = [" ".join(r.choices(names, k=r.randrange(25))) for _ in range(n)]
    return [*rows, None, "", "the of", "motor " * 600 + "relation " * 300, rows[5], rows[5]]


def memories(spark, rows):
    return spark.createDataFrame([(i, i % 2, t, i % 7 / 7, datetime(2024, 1, 1 + i % 25)) for i, t in enumerate(rows)], "id long, org_id long, content string, importance_score double, created_at timestamp_ntz")


@pytest.mark.parametrize("config", inverted.CONFIGS)
def test_index_gives_the_rows_and_ranks_of_the_texts(spark, tmp_path, config):
    rows = texts()
    m = memories(spark, rows)
    index = inverted.build(m.filter("id % 3 > 0"), str(tmp_path / "index"), config, buckets=16, files=2)
    inverted.add(index, m.filter("id % 3 = 0"))
    stop = inverted.stop_words() if config == "english" else None
    held = [positioned_terms(t, stop) for t in rows]
    for query in ("motors", "related MOTOR", "42 relation motors", "ärger", "nowhere motor", "the", "don't", "", "the of"):
        asked = sorted(positioned_terms(query, stop))
        want = [(plain_rank([h[t] for t in asked]), i) for i, h in enumerate(held) if i % 2 == 0 and asked and all(t in h for t in asked)]
        want = sorted(want, key=lambda x: (-x[0], -(x[1] % 25), x[1]))[:10]
        live = m.filter("org_id = 0")
        for got in (inverted.recall(live, query, now(), index=index, org=0), inverted.recall(live, query, now(), config=config)):
            got = got.collect()
            assert [r.id for r in got] == [i for _, i in want], query
            assert all(math.isclose(r.lexical, min(s, 1.0), rel_tol=1e-6) for r, (s, _) in zip(got, want, strict=True))


def test_known_ranks_and_folders_that_are_read(spark, tmp_path):
    # published figures of the rank: neighbours 0.0991, one occurrence 0.0608
    m = memories(spark, ["alpha beta", "alpha", "beta gamma alpha alpha"])
    index = inverted.build(m, str(tmp_path / "index"), "simple", buckets=8)
    near = {r.id: round(r.lexical, 4) for r in inverted.recall(m, "alpha beta", now(), index=index).collect()}
    assert near[0] == 0.0991 and near[2] > 0.0991 and 1 not in near
    assert {r.id: round(r.lexical, 4) for r in inverted.recall(m, "gamma", now(), index=index).collect()} == {2: 0.0608}
    read = inverted.read(index, spark, ["gamma"])
    assert "PartitionFilters: [isnotnull(bucket" in plan(read) or "PartitionFilters: [(bucket" in plan(read) or "PartitionFilters: [bucket" in plan(read)
    assert len(read.inputFiles()) == len(spark.read.parquet(index.path).inputFiles())  # of these, only the folder's are listed:
    files = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1 and read.count() == 1
    with pytest.raises(ValueError):
        inverted.postings(m, "klingon")


def test_engine_recalls_by_index(spark, tmp_path):
    m = memories(spark, texts(60)).selectExpr("*", "cast(null as bigint) agent_id", "cast(null as timestamp_ntz) deleted_at", "'{}' metadata")
    index = inverted.build(m, str(tmp_path / "index"), buckets=8)
    ask = rc.Request(0, "relation of motors", strategy="LEXICAL")
    by_index = rc.Engine(m, None, now(), index=index).recall(ask)[0].collect()
    assert by_index and by_index == rc.Engine(m, None, now()).recall(ask)[0].collect()


# --- vectors ---------------------------------------------------------------------------------------------------------


def vectors(n=1500, dim=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) + 2 * r.normal(size=(20, dim))[r.integers(0, 20, n)]
    x[n // 3 : n // 3 + 200] = x[0]  # ties
    return x


def table(spark, x):
    odd = [(90_000, None), (90_001, []), (90_002, [0.0] * x.shape[1]), (90_003, [1.0]), (90_004, [float("nan")] * x.shape[1])]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<double>")


def brute(x, asked, k):
    out = {}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    for i in asked:
        s = np.round((u * u[i]).sum(1), 12)
        s[i] = -np.inf
        out[i] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


def answered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_knn_is_exact_in_one_block_and_in_cells(spark, monkeypatch):
    x = vectors()
    df = table(spark, x).repartition(5)
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    want = brute(x, range(0, len(x), 20), 10)
    assert answered(nearest.knn(df, asked, 10)) == want
    monkeypatch.setattr(nearest, "BLOCK", 17)
    monkeypatch.setattr(nearest, "SLICE", 400)
    cells = nearest.knn(df, asked, 10)
    assert "FlatMapCoGroupsInArrow" in plan(cells) and answered(cells) == want
    assert nearest.knn(df, asked.limit(0), 10).count() == 0
    assert len(answered(nearest.knn(df.filter("id < 4"), asked, 10))[0]) == 3  # fewer rows than k


def test_inverted_file_reaches_its_recall_and_reads_only_probed_lists(spark, tmp_path, monkeypatch):
    x = vectors()
    df = table(spark, x)
    index = nearest.build(df, str(tmp_path / "lists"), k=10, recall=0.95)
    assert nearest.opened(spark, index.path) == index and index.lists == round(1505**0.5) or index.lists > 30
    assert spark.read.parquet(f"{index.path}/rows").count() == len(x)
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    want = brute(x, range(0, len(x), 20), 10)

    def recall(got):
        return sum(len(set(got[i]) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))

    assert index.probes < index.lists / 2
    got = answered(nearest.search(index, asked, 10))
    assert recall(got) >= 0.9
    assert answered(nearest.search(index, asked, 10, index.lists)) == want  # all lists: exact
    one = nearest.search(index, asked.filter("query_id = 40"), 10)
    assert "PartitionFilters: [cell" in plan(one) or "PartitionFilters: [isnotnull(cell" in plan(one)
    monkeypatch.setattr(nearest, "BLOCK", 17)
    many = nearest.search(index, asked, 10)
    assert "dynamicpruning" in plan(many)
    assert answered(many) == got and answered(nearest.search(index, asked, 10, index.lists)) == want
    with pytest.raises(ValueError):
        nearest.build(df.filter("id > 100000"), str(tmp_path / "none"))


def test_probes_come_in_batches_of_bounded_components(monkeypatch):
    """A batch of queries repeated for all their probes holds at most CELLS components, whatever the number of lists."""
    monkeypatch.setattr(nearest, "CELLS", 1000)
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(100, 4)), nearest.units(rng.normal(size=(10, 4)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    for probes in (3, 10, 99):
        got = list(nearest._listed(iter([batch]), c, ["id", "v", "cell", "place"], probes))
        assert max(b.num_rows for b in got) * 4 <= 1000
        rows = [(r["id"], r["place"], r["cell"]) for b in got for r in b.to_pylist()]
        order = np.argsort(-(nearest.units(x) @ c.T), axis=1, kind="stable")
        assert rows == [(i, k, order[i, k]) for i in range(100) for k in range(min(probes, 10))]
