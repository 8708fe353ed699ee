"""Operator 12: centroid clustering by partial-distance search over integer vectors.

Squared differences are accumulated over the dimensions of highest variance first. The centroid that is nearest over
the first few gets its whole distance at once, which bounds the others: a centroid is abandoned as soon as its partial
distance is strictly above that, and the survivors finish all dimensions, so that ties go to the smaller number.

Each round is one scan of the table: a task returns one row of sums a cluster, and the driver sees the sums of the
clusters alone. Sums are exact at any size: they travel as digits to the base 2^30, which long sums can't overflow; a
batch with components of 2^26 and more is computed in whole numbers of any length.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; a null
vec_id counts as the text 'null' where starting centroids are drawn, equal ids are ordered by components; fewer vectors
than k give fewer centroids; repeated rows repeat their results; a distance or inertia beyond the range of long is null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

DIM, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Dimensions that are added between two tests for abandoning.
STEP = 8
#: Components below it leave room for the squares of DIM differences in 64 bits.
PLAIN = 1 << 26
BASE = 30
ROWS = 4096


def kept(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    whole = F.size(v) == dim
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).alias("id"), v.alias("v")).filter(F.col("v").isNotNull()).filter(whole & finite)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as int64 where all are small, else as whole numbers of any length."""
    if not x.size or np.abs(x).max() < PLAIN / scale - 1:
        return np.floor(scale * x).astype(np.int64)
    whole = [int(np.floor(scale * v)) if abs(v) < 1e15 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid (ties: the smaller number)."""
    if centroids.dtype == object or x.dtype == object or np.abs(centroids).max(initial=0) >= PLAIN:
        x, centroids = x.astype(object), centroids.astype(object)
    x, c = x[:, order], centroids[:, order]
    part = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    best = ((x - c[part.argmin(1)]) ** 2).sum(1)
    row, number = np.nonzero(part <= best[:, None])
    at = part[row, number]
    for d in range(step, x.shape[1], step):
        at = at + ((x[row, d : d + step] - c[number, d : d + step]) ** 2).sum(1)
        stays = at <= best[row]
        row, number, at = row[stays], number[stays], at[stays]
    # rows stand in order, and so do a row's centroids
    least = np.minimum.reduceat(at, np.flatnonzero(np.diff(row, prepend=-1)))
    won = np.flatnonzero(at == least[row])
    won = won[np.unique(row[won], return_index=True)[1]]
    return number[won], at[won]


def blocks(batches: Iterator[pa.RecordBatch], scale: int, rows: int = ROWS) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors, some rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), integers(flat.reshape(part.num_rows, -1), scale)


def digits(value: int) -> list[int]:
    """value as digits to the base 2^BASE, lowest first; the highest one is signed."""
    out = []
    while not -(1 << BASE) < value < 1 << BASE:
        out.append(value & ((1 << BASE) - 1))
        value >>= BASE
    return [*out, value]


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; empty ones stay."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, x in blocks(batches, scale):
            number, _ = nearest(x, centroids, order)
            for c in np.unique(number):
                total[c] += x[number == c].sum(0).astype(object)
            count += np.bincount(number, minlength=k)
        out = []
        for c in np.flatnonzero(count):
            by_dim = [digits(int(v)) for v in total[c]]
            for j in range(max(map(len, by_dim))):
                out.append([int(c), j, int(count[c]) if j == 0 else 0, *(d[j] if j < len(d) else 0 for d in by_dim)])
        if out:
            kinds = [pa.int32(), pa.int32()] + [pa.int64()] * (dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["cluster", "digit", "n", *(f"s{i}" for i in range(dim))]
    parts = vectors.mapInArrow(sums, "cluster int, digit int, " + ", ".join(f"{n} long" for n in names[2:]))
    # k rows for each digit, whatever the number of vectors
    rows = parts.groupBy("cluster", "digit").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect()
    total, count = np.zeros((k, dim), object), [0] * k
    for r in rows:
        total[r[0]] += np.array([int(v) << (BASE * r[1]) for v in r[3:]], object)
        count[r[0]] += r[2]
    return whole(np.array([[int(v) // n for v in t] if (n := count[c]) else centroids[c].tolist() for c, t in enumerate(total)], object))


def whole(x: np.ndarray) -> np.ndarray:
    """x as int64 where all are small."""
    return x.astype(np.int64) if all(abs(v) < PLAIN for v in x.ravel().tolist()) else x


def started(vectors: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = vectors.withColumn("key", key).orderBy("key", "v").limit(k).select("v").collect()
    return whole(integers(np.array([r.v for r in first], float), scale).astype(object)) if first else np.zeros((0, DIM), np.int64)


def by_variance(vectors: DataFrame, dim: int = DIM) -> np.ndarray:
    """The dimensions, those of the highest variance first."""
    spread = vectors.agg(*[F.var_pop(F.col("v")[i]).alias(f"d{i}") for i in range(dim)]).first()
    return np.argsort([-(s if s is not None and np.isfinite(s) else np.inf) for s in spread], kind="stable")


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector that takes part, and the final centroids."""
    held = kept(vectors, id_column, column, dim)
    centroids = started(held, k, seed, scale)
    kind = vectors.schema[id_column].dataType.simpleString()
    if not len(centroids):
        return held.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids
    order = by_variance(held, dim)
    for _ in range(rounds):
        centroids = moved(held, centroids, order, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, scale):
            number, distance = nearest(x, centroids, order)
            far = distance if distance.dtype != object else [d if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    return held.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    assigned = saved(assigned)
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(exact.alias("total")).collect()}  # K rows at most
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    every = fits(sum(per.values())) if None not in per.values() else None
    known = [(c, fits(t), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in per.items()]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroid_sql() -> str:
    assigned = lambda n: f"""a{n} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM
 (SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k CROSS JOIN c{n} c)) WHERE rn = 1)"""  # noqa: E731
    centroids = lambda n: f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS v FROM
 (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY 1, 2)) GROUP BY 1) m ON m.c = o.c)"""  # noqa: E731
    steps = ",\n".join(f(n) for n in range(ROUNDS) for f in (assigned, centroids)) + ",\n" + assigned(ROUNDS)
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {K})),
{steps}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (c)"""


QUERIES = {"op12_centroids": op12_centroids}
SQL = {"op12_centroids": _centroid_sql()}
