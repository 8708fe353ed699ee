"""Operator 8: n-gram Jaccard join of documents over prefix trees.

A document's set holds its distinct 5-word shingles, as numbers in one global order: six bits for how frequent the shingle
is, then 58 of its hash, so rare shingles come first. Two sets of the similarity share one of the first
|s| - ceil(3|s|/4) + 1 shingles, so these are a set's keys. Candidates are verified by walking prefix trees of whole sets in
the same order (links.py). Frequencies are counted over all documents, and any order gives the same links, so the bound on
how many shingles are told apart (HEAVY) changes no result.

Defined results: null, empty and wordless texts have no shingles and are alone (component_id is the own id); repeated rows
share a component; a row with a null doc_id is linked (its text tells it) but never names a component unless all its documents
have none; empty tables give no rows; extra columns are ignored by ``classes`` and kept by ``one_of_each``, which decides by row where ids are null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_prefix, pieces, saved, set_id, shingle_sets, signature, small, table, text_bytes, words
from .links import SIMILAR, link, row_key, sets_sent

HEAVY, HEAVY_LEAST = 400_000, 24
WINDOW = 1_500_000
SIGNATURE = 16


def prefix_length(n: int) -> int:
    p, q = SIMILAR
    return n - -(-p * n // q) + 1


def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, off = text_bytes(batch.column("text"))
    h, unit, _ = words(data, off)
    return shingle_sets(h, unit, batch.num_rows)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have among the smallest of their sets, and the frequency class of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def told() -> pa.RecordBatch:
            k = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            n = np.diff(np.concatenate((first, [len(k)])))
            return pa.RecordBatch.from_arrays([pa.array(k[first][n >= 2].view(np.int64)), pa.array(n[n >= 2])], names=["k", "n"])

        for batch in pieces(batches):
            for _, s in sets_of(batch):
                held.append(s[: prefix_length(len(s))])
                total += len(held[-1])
            if total > WINDOW:
                yield told()
                held, total = [], 0
        if held:
            yield told()

    counts = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_LEAST)
    top = counts.orderBy(F.col("n").desc(), "k").limit(HEAVY).toArrow()  # bounded by HEAVY
    k = top.column("k").to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], (1 + np.log2(top.column("n").to_numpy()[order] if len(k) else np.zeros(0))).astype(np.int64)


Order = tuple[np.ndarray, np.ndarray]


def ordered_sets(batch: pa.RecordBatch, order: Order) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each row with words: its shingles as numbers of the global order, ascending."""
    heavy, level = order
    for i, s in sets_of(batch):
        code = s >> np.uint64(6)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
            hot = heavy[at] == s
            if hot.any():
                code[hot] |= level[at[hot]].astype(np.uint64) << np.uint64(58)
                code.sort()
        yield i, code


def keyed_sets(docs: DataFrame, sent) -> DataFrame:
    """doc_id, lk (row_key), node, n, sig, keys of each document; node null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            size = batch.num_rows
            node: list = [None] * size
            n, sig, keys = [0] * size, [None] * size, [None] * size
            seen: set[int] = set()
            for i, s in ordered_sets(batch, sent.value):
                node[i], n[i] = set_id(s), len(s)
                if node[i] in seen:
                    continue
                seen.add(node[i])
                sig[i] = signature(s, SIGNATURE)
                keys[i] = s[: prefix_length(len(s))].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lk"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.list_(pa.int64())), pa.array(keys, pa.binary())], names=["doc_id", "lk", "node", "n", "sig", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_key(docs).alias("lk"), "text").mapInArrow(run, f"doc_id {kind}, lk long, node long, n int, sig array<long>, keys binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (identity of the set), comp (a node that names the component), component_id."""
    return _classes(docs, docs.sparkSession.sparkContext.broadcast(frequent(docs)))


def _classes(docs: DataFrame, sent) -> DataFrame:
    docs = docs.select("doc_id", "text")
    sets = saved(keyed_sets(docs, sent))
    where = saved(sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("lk").alias("lk")))

    named_sets = lambda batch: ((i, set_id(s), s) for i, s in ordered_sets(batch, sent.value))
    fetch = lambda wanted: sets_sent(docs, wanted, where.select("node", "lk"), named_sets)
    labels = link(sets.filter("keys is not null").select("node", "n", "sig", "keys"), fetch)
    linked = where.join(labels, "node")
    first = linked.groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = where.join(linked.select("node", "comp").join(first, "comp").select("node", "comp", "least"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("least", "doc_id").alias("component_id"))
    out = sets.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def with_node(docs: DataFrame, sent, name: str) -> DataFrame:
    """docs and a column with the identity of each row's set; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            node: list = [None] * batch.num_rows
            for i, s in ordered_sets(batch, sent.value):
                node[i] = set_id(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id (null ids come last), with the columns of docs.

    A row is told by its id and set: equal ids with different texts are different documents, and so are null ids. Equal
    ids without shingles are one document; rows with neither id nor shingles all stay."""
    own = free_prefix(docs, "ng_")
    one_id, one_set, again_id = own + "id", own + "set", own + "again"
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    found = saved(_classes(docs, sent).select("doc_id", "node", "comp"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    least = found.filter("node is not null").groupBy("comp").agg(F.min(key).alias("least"))
    gone = saved(found.distinct().join(least, "comp").filter(key != F.col("least")).select(F.col("doc_id").alias(one_id), F.col("node").alias(one_set)))
    again = saved(found.groupBy(F.col("doc_id").alias(again_id)).count().filter(f"count > 1 or {again_id} is null").select(again_id))
    gone_ids = small(gone.select(one_id).filter(F.col(one_id).isNotNull()).distinct())
    if again.isEmpty():
        return docs.join(gone_ids, docs["doc_id"] == F.col(one_id), "left_anti")
    again = small(again)
    one = docs.filter(docs["doc_id"].isNotNull()).join(again, docs["doc_id"] == F.col(again_id), "left_anti")
    kept = one.join(gone_ids, one["doc_id"] == F.col(one_id), "left_anti")
    many = with_node(docs.join(again, docs["doc_id"].eqNullSafe(F.col(again_id)), "left_semi"), sent, own + "node")
    node = many[own + "node"]
    many = many.join(small(gone), many["doc_id"].eqNullSafe(F.col(one_id)) & (node == F.col(one_set)), "left_anti")
    alone = many.filter(F.col("doc_id").isNull() & F.col(own + "node").isNull())
    rest = many.filter(F.col("doc_id").isNotNull() | F.col(own + "node").isNotNull()).dropDuplicates(["doc_id", own + "node"])
    return kept.unionByName(rest.union(alone).drop(own + "node"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: DuckDB SQL: shingles joined on equality, reachability by a recursive query over the links between classes.
SHINGLES_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i + 1 : i + 5], ' ') END AS g FROM (SELECT *, unnest(range(0, greatest(len(ws) - 5, 0) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS doc_id, least(min(a), min(b)) AS component_id FROM r GROUP BY 1)"""

QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
SQL = {"op8_ngram_jaccard": f"WITH RECURSIVE {SHINGLES_SQL.format(documents='documents')} SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"}
