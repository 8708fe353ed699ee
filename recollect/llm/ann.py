"""Operator 1: approximate nearest neighbours with a hierarchical k-means tree.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of the table, and queries a zero there, so that
the Euclidean order around a query is that of its inner products. The tree is fitted on a bounded sample (SAMPLE vectors)
and broadcast; its size is fixed by that bound. Every vector is put into its leaf. A query walks the tree best-bin-first
through a priority queue; the number of leaves it visits is widened on calibration queries until their recall against
brute force over the sample reaches TARGET. Neighbouring leaves are packed into buckets of about BLOCK rows, a larger leaf
is split into several, and a query goes once to each bucket that holds a leaf of its walk. A leaf that has more than
SUBTREE rows in a bucket gets a tree of its own there, walked and calibrated in the same way, so that the leaves grow in
number with the table. Nothing is capped.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of another length
than the most frequent one (the smaller on ties), take no part; repeated rows are separate candidates, but none with the
query's own id; a query id of several rows is asked once, with its smallest vector; ties go to the smaller id; a null id
takes no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

SAMPLE = 8192
BRANCH = 8
LEAF = 12
TARGET = 0.94
BLOCK = 4096
SUBTREE = 512
QUERIES_PER_TASK = 256
K = 20


class Tree:
    """Hierarchical k-means: inner nodes hold their children's centroids, leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []  # >= 0: node, < 0: leaf -(n + 1)
        self.n_leaves = 0
        self._split(sample, branch, leaf, rng)

    def _leaf(self) -> int:
        self.n_leaves += 1
        return -self.n_leaves

    def _split(self, x: np.ndarray, branch: int, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.centroids)
        self.centroids.append(x[:0])
        self.children.append([])
        distinct = np.unique(x, axis=0)
        k = min(branch, len(distinct))
        if k < 2:
            self.centroids[node] = distinct[:1] if len(distinct) else np.zeros((1, x.shape[1]))
            self.children[node] = [self._leaf()]
            return node
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(8):
            near = self._near(x, c)
            for j in range(k):
                if (own := near == j).any():
                    c[j] = x[own].mean(0)
        near = self._near(x, c)
        used = [j for j in range(k) if (near == j).any()]
        self.centroids[node] = c[used]
        for j in used:
            part = x[near == j]
            small = len(part) <= leaf or len(used) < 2
            self.children[node].append(self._leaf() if small else self._split(part, branch, leaf, rng))
        return node

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int64)

        def down(node: int, rows: np.ndarray) -> None:
            near = self._near(x[rows], self.centroids[node])
            for j, child in enumerate(self.children[node]):
                if len(part := rows[near == j]):
                    if child < 0:
                        out[part] = -child - 1
                    else:
                        down(child, part)

        if len(x):
            down(0, np.arange(len(x)))
        return out

    def order(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves of a query, best bin first: the priority is the distance to the branch's centroid."""
        heap: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        found, tick = [], 1
        while heap and len(found) < visits:
            _, _, node = heapq.heappop(heap)
            if node < 0:
                found.append(-node - 1)
                continue
            c = self.centroids[node]
            for d, child in zip(((c * c).sum(1) - 2 * c @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(heap, (d, tick, child))
                tick += 1
        return found


def raised(x: np.ndarray, most: float) -> np.ndarray:
    """The vectors with the coordinate that turns inner products into distances; most: the largest squared norm."""
    return np.concatenate((x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]), 1)


def asked_of(q: np.ndarray) -> np.ndarray:
    return np.concatenate((q, np.zeros((len(q), 1))), 1)


def fitted(x: np.ndarray, n_rows: int, most: float, k: int, target: float, n_queries: int = 256) -> tuple[Tree, int]:
    """A tree of the vectors, a sample of n_rows, and its leaf visits, widened until the recall of nearest vectors reaches target.

    Every fourth vector is held out of the fit, and held-out vectors ask. Vectors that the centroids were fitted to lie
    nearer to them than others, so the neighbours of both kinds are weighed by their shares in the n_rows."""
    up = raised(x, most)
    held = np.arange(len(x)) % 4 == 3
    tree = Tree(up[~held])
    ask = np.flatnonzero(held)
    ask = ask[:: max(1, len(ask) // n_queries)]
    k = min(k, len(x) - 1)
    if not len(ask):
        return tree, tree.n_leaves
    leaf = tree.leaves(up)
    exact = x[ask] @ x.T
    exact[np.arange(len(ask)), ask] = -np.inf
    ranks, weights = [], []
    known = min(1.0, (~held).sum() / n_rows)
    worth = np.where(held, (1 - known) / held.mean(), known / (~held).mean())
    for row, q in enumerate(asked_of(x[ask])):
        seen = np.empty(tree.n_leaves, np.int64)
        seen[tree.order(q, tree.n_leaves)] = np.arange(tree.n_leaves)
        best = np.argpartition(-exact[row], k - 1)[:k]
        ranks.append(seen[leaf[best]])
        weights.append(worth[best])
    ranks, weights = np.concatenate(ranks), np.concatenate(weights)
    order = np.argsort(ranks, kind="stable")
    reached = np.cumsum(weights[order])
    at = min(int(np.searchsorted(reached, target * reached[-1])), len(order) - 1) if len(order) else 0
    return tree, int(ranks[order][at]) + 1 if len(order) else tree.n_leaves


def valid_vectors(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int, float]:
    """(id, v) rows that take part, the length of their vectors, and their largest squared norm."""
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("most"))
    top = lengths.orderBy(F.col("rows").desc(), "n").first()
    return (rows.filter(F.size("v") == top["n"]), top["n"], top["most"]) if top else (rows, 0, 0.0)


def buckets(counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each leaf: neighbouring leaves share one up to block rows, larger leaves have several."""
    first, many, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts):
        if held and held + n > block:
            at, held = at + 1, 0
        first[leaf], many[leaf] = at, max(1, -(-int(n) // block))
        at, held = (at + many[leaf], 0) if many[leaf] > 1 else (at, held + int(n))
    return first, many


def _walked(y: np.ndarray, leaf: np.ndarray, q: np.ndarray, visits: list[np.ndarray], most: float, k: int, target: float) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Order of a bucket's vectors, and (start, end, queries) of the runs of them that queries visit; visits: leaves by query."""
    by: dict[int, list[int]] = {}
    for i, to in enumerate(visits):
        for x in to.tolist():
            by.setdefault(x, []).append(i)
    order, runs, at = [], [], 0
    for x in np.unique(leaf):
        rows, who = np.flatnonzero(leaf == x), np.array(by.get(int(x), []), np.int64)
        if len(rows) <= SUBTREE or not len(who):
            order.append(rows)
            runs.append((at, at + len(rows), who))
            at += len(rows)
            continue
        up = raised(y[rows], most)
        tree, some = fitted(y[rows], len(rows), most, k, target)
        own = tree.leaves(up)
        sub: dict[int, list[int]] = {}
        for i, v in zip(who, asked_of(q[who]), strict=True):
            for s in tree.order(v, some):
                sub.setdefault(s, []).append(int(i))
        for s in range(tree.n_leaves):
            part = rows[own == s]
            order.append(part)
            runs.append((at, at + len(part), np.array(sub.get(s, []), np.int64)))
            at += len(part)
    return np.concatenate(order), runs


def nearest(q_ids: np.ndarray, q: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, y: np.ndarray, leaf: np.ndarray, most: float, k: int, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, id, score): each query's k best vectors of the leaves it visits; ties at the last place are cut by id."""
    order, runs = _walked(y, leaf, q, visits, most, k, target)
    y, ids = y[order], ids[order]
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(q), QUERIES_PER_TASK):
        part, me = q[a : a + QUERIES_PER_TASK], q_ids[a : a + QUERIES_PER_TASK]
        scores = np.full((len(part), len(y)), -np.inf)
        for lo, hi, who in runs:
            who = who[(who >= a) & (who < a + len(part))] - a
            if len(who):
                scores[who, lo:hi] = part[who] @ y[lo:hi].T
        scores[me[:, None] == ids[None, :]] = -np.inf
        last = np.partition(scores, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(part), -np.inf)
        row, col = np.nonzero((scores >= last[:, None] - 1e-9 * np.abs(np.nan_to_num(last, neginf=0.0))[:, None] - 1e-12) & (scores > -np.inf))
        exact = (y[col] * part[row]).sum(1)
        by = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[by], col[by], exact[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append((me[row[keep]], ids[col[keep]], exact[keep]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def search(rows: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = K, sample: int = SAMPLE, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: each query's k rows with the largest inner product found, its own id left out."""
    spark = rows.sparkSession
    base, dim, most = valid_vectors(rows, id_column, vector)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    asked = valid_vectors(queries, id_column, vector)[0].filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    picked = base.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # bounded by sample

    def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    x = vectors(picked.column("v"))
    tree, visits = fitted(x, base.count(), most, k, target)
    sent = spark.sparkContext.broadcast((tree, visits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(sent.value[0].leaves(raised(vectors(b.column("v")), most)))], names=["id", "v", "leaf"])

    kind = dict(base.dtypes)["v"]
    placed = saved(base.mapInArrow(place, f"id long, v {kind}, leaf long"))
    counts = np.zeros(tree.n_leaves, np.int64)
    for leaf, n in placed.groupBy("leaf").count().collect():  # a row a leaf: bounded by the tree
        counts[leaf] = n
    first, many = buckets(counts, block)
    dealt = spark.sparkContext.broadcast((first, many))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, many = dealt.value
        for b in batches:
            leaf, ids = b.column("leaf").to_numpy(), b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + ids % many[leaf]), *b.columns], names=["bucket", "id", "v", "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree, visits), (first, many) = sent.value, dealt.value
        for b in batches:
            for i, q in enumerate(asked_of(vectors(b.column("v")))):
                to = np.sort(np.array(tree.order(q, visits), np.int64))
                leaf = np.repeat(to, many[to])
                bucket = first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(many[to]) - many[to], many[to])
                where, start = np.unique(bucket, return_index=True)  # buckets ascend with the leaves
                parts = [leaf[s:e].tobytes() for s, e in zip(start, [*start[1:], len(leaf)], strict=True)]
                one = pa.array(np.zeros(len(where), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(where), b.column("id").slice(i, 1).take(one), b.column("v").slice(i, 1).take(one), pa.array(parts, pa.binary())], names=["q_bucket", "q_id", "q_v", "q_leaves"])

    index = placed.mapInArrow(deal, f"bucket long, id long, v {kind}, leaf long")
    n_tasks = max(1, -(-asked.count() // QUERIES_PER_TASK))
    visited = asked.repartition(n_tasks, "id").mapInArrow(visit, f"q_bucket long, q_id long, q_v {kind}, q_leaves binary")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        visits = [np.frombuffer(v, np.int64) for v in left.column("q_leaves").to_pylist()]
        got = nearest(left.column("q_id").to_numpy(), vectors(left.column("q_v")), visits, right.column("id").to_numpy(), vectors(right.column("v")), right.column("leaf").to_numpy(), most, k, target)
        return pa.table({n: pa.array(c) for n, c in zip(("query_id", "id", "score"), got, strict=True)})

    near = visited.groupBy("q_bucket").cogroup(index.groupBy("bucket")).applyInArrow(meet, "query_id long, id long, score double")
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


QUERIES = {"op1_ann": op1_ann}
SQL: dict[str, str] = {}
