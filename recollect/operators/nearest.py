"""Nearest neighbours by cosine for sets of queries: exactly over all rows, or over the probed lists of an inverted file.

Rows and queries meet in cells (one for all, or one a list), cut into slices of rows and blocks of queries by their
counts, so that a task holds a bounded number of both and multiplies them as matrices. The best of each product are
worked out again in double precision, dimension by dimension, so that equal vectors have equal similarities and ties go
to the smaller id. Up to BLOCK queries are sent to the rows instead, which then aren't shuffled.

Null vectors, zero ones and those of another length than the first query's or the index's take no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a block, rows of a slice, and similarities that are held at a time.
BLOCK, SLICE, CELLS = 2000, 20_000, 1_000_000
#: Similarities of matrix products that are as near to the k-th as this are compared exactly.
MARGIN = 1e-9


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up dimension by dimension."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(a, b) / (np.sqrt(folded(a, a)) * np.sqrt(folded(b, b)))


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of a list column, of those of one length (by default the first's) that aren't null or zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    dim = int(size[size > 0][0]) if dim is None and (size > 0).any() else dim
    at = np.flatnonzero(size == dim)
    if not len(at):
        return at, np.zeros((0, dim or 0))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(flat, np.float64).reshape(len(at), -1)
    held = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[held], x[held]


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best_pairs(q: np.ndarray, x: np.ndarray, k: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's k best rows, and of those that tie with them; same: the row that each query skips (-1: none)."""
    found = []
    xu, per = units(x), max(1, CELLS // max(1, len(x)))
    for a in range(0, len(q), per):
        s = units(q[a : a + per]) @ xu.T
        if same is not None:
            own = np.flatnonzero(same[a : a + per] >= 0)
            s[own, same[a : a + per][own]] = -np.inf
        least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] if s.shape[1] else np.zeros(len(s))
        i, j = np.nonzero((s >= least[:, None] - MARGIN) & (s > -np.inf))
        found.append((i + a, j))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j, cosines(q[i], x[j])


def _emitted(qids: pa.Array, ids: pa.Array, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> list[pa.Array]:
    return [qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sim, pa.float64())]


def _skips(qids: pa.Array, ids: pa.Array) -> np.ndarray:
    """The row of each query's own id; -1 where it isn't among them."""
    return pc.index_in(qids, ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def in_cells(held: DataFrame, asked: DataFrame, k: int, cells: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity) of the nearest of rows (cell, id, embedding) for queries (cell, query_id, q) in each cell.

    cells: (cell, rows), where the rows of the cells are known."""
    rows = held.groupBy("cell").agg(F.count("*").alias("rows")) if cells is None else cells
    cut = rows.join(asked.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    cut = cut.select("cell", F.ceil(F.col("rows") / SLICE).alias("slices"), F.ceil(F.col("queries") / BLOCK).alias("blocks"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = held.join(cut, "cell").withColumn("slice", part("id", "slices")).withColumn("block", every("blocks"))
    right = asked.join(cut, "cell").withColumn("slice", every("slices")).withColumn("block", part("query_id", "blocks"))
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in ("cell", "slice", "block")], "query_id", "q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        qat, q = matrix(b.column("q"))
        at, x = matrix(a.column("embedding"), q.shape[1])
        qids, ids = b.column("query_id").combine_chunks().take(pa.array(qat)), a.column("id").combine_chunks().take(pa.array(at))
        return pa.table(_emitted(qids, ids, *best_pairs(q, x, k, _skips(qids, ids))), names=["query_id", "id", "similarity"])

    kinds = dict(held.dtypes) | dict(asked.dtypes)
    return left.groupBy("cell", "slice", "block").cogroup(right.groupBy("q_cell", "q_slice", "q_block")).applyInArrow(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")


def to_rows(held: DataFrame, asked: list, k: int, kind: str, lists: dict[int, list[int]] | None = None) -> DataFrame:
    """The same for at most BLOCK queries (query_id, q), which every task of the rows gets; lists: the queries (by number) of each cell."""
    qids, q = pa.array([r[0] for r in asked]), np.array([r[1] for r in asked], np.float64)
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column("embedding"), q.shape[1])
            ids = batch.column("id").take(pa.array(at))
            if lists is None:
                groups = [(np.arange(len(q)), np.arange(len(x)))]
            else:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)[at]
                groups = [(np.array(lists[c]), np.flatnonzero(cell == c)) for c in np.unique(cell).tolist() if c in lists]
            for which, own in groups:
                if len(own):
                    mine, theirs = qids.take(pa.array(which)), ids.take(pa.array(own))
                    columns = _emitted(mine, theirs, *best_pairs(q[which], x[own], k, _skips(mine, theirs)))
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity"])

    return held.mapInArrow(run, f"query_id {kind}, id {kinds['id']}, similarity double")


def few(queries: DataFrame) -> list | None:
    """The queries (query_id, q) if they are at most BLOCK, without those that take no part; else None."""
    got = queries.select("query_id", "q").limit(BLOCK + 1).collect()
    if len(got) > BLOCK:
        return None
    dim = next((len(r[1]) for r in got if r[1]), 0)
    return [r for r in got if r[1] and len(r[1]) == dim and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]


def knn(m: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows (id, embedding) nearest to each query (query_id, q), but for a query's own id."""
    held, kinds = m.select("id", "embedding"), dict(m.dtypes) | dict(queries.dtypes)
    asked = few(queries)
    if asked is None:
        one = F.lit(0).alias("cell")
        return _ranked(in_cells(held.select(one, "id", "embedding"), queries.select(one, "query_id", "q"), k), k)
    if not asked:
        return m.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double, rank int")
    return _ranked(to_rows(held, asked, k, kinds["query_id"]), k)


# --- inverted file ---------------------------------------------------------------------------------------------------

#: Vectors that the lists' centers are fitted on, and queries that the number of probes is measured with, at most.
SAMPLE, MEASURED, MOST_LISTS = 20_000, 200, 65_536


@dataclass(frozen=True)
class Lists:
    """Where an inverted file lies, its vectors' length, and the probes at which it reached the wanted recall."""

    path: str
    dim: int
    lists: int
    probes: int


def centers_of(x: np.ndarray, n: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centers by k-means on the sphere; an emptied one stays."""
    x = units(x)
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.add.reduceat(x[order], first)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c[own[order][first]] = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c[own[order][first]])
    return c


def _listed(batches: Iterator[pa.RecordBatch], c: np.ndarray, names: list[str], probes: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) of batches with the nearest of centers c, a row each. Similarities and the components that are
    repeated for every probe are both held for at most CELLS at a time."""
    probes = min(probes, len(c))
    per = max(1, CELLS // max(len(c), probes * c.shape[1]))
    for batch in batches:
        at, x = matrix(batch.column(1), c.shape[1])
        for a in range(0, len(x), per):
            order = np.argsort(-(units(x[a : a + per]) @ c.T), axis=1, kind="stable")[:, :probes]
            take = pa.array(np.repeat(at[a : a + per], probes))
            place = np.tile(np.arange(probes), len(order))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(order.ravel(), pa.int32()), pa.array(place, pa.int32())], names=names)


def _with_lists(df: DataFrame, centers: np.ndarray, id_column: str, column: str, probes: int) -> DataFrame:
    """(id, vector, cell) for the nearest lists of each vector, nearest first as place."""
    sent = df.sparkSession.sparkContext.broadcast(centers)  # MOST_LISTS centers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _listed(batches, sent.value, [id_column, column, "cell", "place"], probes)

    kinds = dict(df.dtypes)
    return df.select(id_column, column).mapInArrow(run, f"{id_column} {kinds[id_column]}, {column} {kinds[column]}, cell int, place int")


def build(m: DataFrame, path: str, lists: int | None = None, k: int = 10, recall: float = 0.95, files: int = 4) -> Lists:
    """Writes rows (id, embedding) under path, a folder a list, and measures the probes that the wanted recall at k takes.

    The centers come from at most SAMPLE vectors; every row is in a list. A list's rows go to several files, so that one of
    a large part of all rows is no single task."""
    spark = m.sparkSession
    vectors = m.select("id", "embedding").filter(F.size("embedding") > 0)
    taken = matrix(pa.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()], pa.list_(pa.float64())))[1]
    if not len(taken):
        raise ValueError("no vectors")
    n = lists or min(MOST_LISTS, max(1, round(vectors.count() ** 0.5)))
    centers = centers_of(taken, min(n, len(taken)))
    rows = _with_lists(vectors, centers, "id", "embedding", 1).drop("place")
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows")
    held.groupBy("cell").agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")  # a row a list
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    # a neighbour is found from as many probes on as its list's place among the query's lists
    some = held.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MEASURED).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = knn(held, some, k).join(held.select("id", "cell"), "id").select("query_id", "cell")
    places = _with_lists(some, centers, "query_id", "q", len(centers)).select("query_id", "cell", "place")
    place = sorted(r[0] for r in near.join(places, ["query_id", "cell"]).select("place").collect())  # MEASURED * k rows
    probes = place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)] + 1 if place else 1
    made = Lists(path, centers.shape[1], len(centers), int(probes))
    spark.createDataFrame([(json.dumps(asdict(made)),)], "index string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return made


def opened(spark: SparkSession, path: str) -> Lists:
    """An inverted file that was built before."""
    return Lists(**json.loads(spark.read.text(f"{path}/about").first()[0]) | {"path": path})


def search(index: Lists, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) from the probed lists alone: their folders are all that is read."""
    spark, kinds = queries.sparkSession, dict(queries.dtypes)
    held = spark.read.parquet(f"{index.path}/rows")
    centers = np.array([r[1] for r in spark.read.parquet(f"{index.path}/centers").orderBy("cell").collect()])  # MOST_LISTS at most
    probes = min(probes or index.probes, index.lists)
    asked = few(queries)
    if asked is not None:
        asked = [r for r in asked if len(r[1]) == index.dim]
        order = np.argsort(-(units(np.array([r[1] for r in asked], float)) @ centers.T), axis=1, kind="stable")[:, :probes] if asked else np.zeros((0, 0), int)
        lists: dict[int, list[int]] = {}
        for i, own in enumerate(order.tolist()):
            for c in own:
                lists.setdefault(c, []).append(i)
        if not lists:
            return spark.createDataFrame([], f"query_id {kinds['query_id']}, id {dict(held.dtypes)['id']}, similarity double, rank int")
        return _ranked(to_rows(held.filter(F.col("cell").isin(list(lists))), asked, k, kinds["query_id"], lists), k)
    many = _with_lists(queries, centers, "query_id", "q", probes).drop("place")
    sizes = spark.read.parquet(f"{index.path}/sizes")
    # a list that no query probes is pruned when the join with the probed ones runs
    probed = F.broadcast(many.filter("cell >= 0").select("cell").distinct())  # a row a list
    return _ranked(in_cells(held.join(probed, "cell"), many, k, sizes), k)


def folder(shared: str) -> str:
    """A new folder for an index."""
    return f"{shared}/lists-{uuid.uuid4().hex}"
