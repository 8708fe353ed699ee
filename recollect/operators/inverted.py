"""A positional inverted index for lexical recall.

``build`` writes one row a (term, memory) with the term's positions, partitioned by a hash of the term and sorted by term
inside, so that a recall reads the folders of its few terms and in them the row groups that hold them, never the texts.
A term's rows go to several files by a hash of the memory, so a term of every memory is no single task. ``postings`` makes
the same rows from the texts, for recalls without an index. ``recall`` is the same over both.

The rank is that of the reference's full-text search for queries whose terms must all occur: for one term the sum of
weight / j^2 over its occurrences, for several the closeness of each pair of occurrences of two terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.porter import positioned_terms

#: Fixed values of full-text ranks: the weight of plain text, occurrences and positions that count, how closeness falls.
WEIGHT, MOST_OCCURRENCES, LAST_POSITION, ZETA = 0.1, 256, 16_383, 1.64493406685
CONFIGS = ("english", "simple")
POSTING = "term string, id {id}, org_id {org}, positions array<int>"


@lru_cache
def stop_words() -> frozenset[str]:
    """The English list that Spark holds; asked for on the driver."""
    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def postings(m: DataFrame, config: str = "english", only: list[str] | None = None) -> DataFrame:
    """(term, id, org_id, positions) of memories' contents, in Arrow batches; only: these terms alone.

    english: Porter stems without stop words, which still count as positions; simple: lower-cased words as they are."""
    if config not in CONFIGS:
        raise ValueError(f"config must be one of {', '.join(CONFIGS)}")
    stop, wanted = stop_words() if config == "english" else None, None if only is None else frozenset(only)
    kinds = dict(m.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                row, term, at = [], [], []
                for i, text in enumerate(part.column("content").to_pylist()):
                    for t, positions in positioned_terms(text, stop).items():
                        if wanted is None or t in wanted:
                            row.append(i)
                            term.append(t)
                            at.append(positions)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), part.column("id").take(take), part.column("org_id").take(take), pa.array(at, pa.list_(pa.int32()))], names=["term", "id", "org_id", "positions"])

    return m.select("id", "org_id", "content").mapInArrow(run, POSTING.format(id=kinds["id"], org=kinds["org_id"]))


@dataclass(frozen=True)
class Index:
    """Where an index lies, how its texts were split, and over how many folders."""

    path: str
    config: str
    buckets: int

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def build(m: DataFrame, path: str, config: str = "english", buckets: int = 256, files: int = 4) -> Index:
    """Writes the index of the memories' contents; files: at most so many a folder, each with all terms of some memories."""
    index = Index(path, config, buckets)
    rows = postings(m, config).withColumn("bucket", index.bucket(F.col("term")))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "term", "org_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return index


def add(index: Index, m: DataFrame, files: int = 1) -> None:
    """Appends new memories; those that an index has already must not come again."""
    rows = postings(m, index.config).withColumn("bucket", index.bucket(F.col("term")))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "term", "org_id").write.mode("append").partitionBy("bucket").parquet(index.path)


def read(index: Index, spark: SparkSession, terms: list[str], org=None) -> DataFrame:
    """The postings of some terms; only their folders are listed in the plan."""
    held = spark.read.parquet(index.path)
    folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(index.bucket(F.col("term"))).collect()})  # a query's terms
    rows = held.filter(F.col("bucket").isin(folders) & F.col("term").isin(terms)).drop("bucket")
    return rows if org is None else rows.filter(F.col("org_id") == F.lit(org))


def asked(query: str, config: str = "english") -> list[str]:
    return sorted(positioned_terms(query, stop_words() if config == "english" else None))


def pair_closeness(a: Column, b: Column) -> Column:
    """The product of 1 - closeness over all pairs of positions of two terms."""
    distance = lambda x, y: F.abs(x - y).cast("double")
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
    closeness = lambda x, y: F.when(x == y, 0.0).otherwise(F.sqrt(F.lit(WEIGHT * WEIGHT) * near(distance(x, y))))
    return F.aggregate(a, F.lit(1.0), lambda out, x: out * F.aggregate(b, F.lit(1.0), lambda inner, y: inner * (1.0 - closeness(x, y))))


def ranked(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(id, rank) of the memories that hold all terms, from their postings."""
    counted = F.transform(F.slice("positions", 1, MOST_OCCURRENCES), lambda p: F.least(p, F.lit(LAST_POSITION)))
    held = rows.groupBy("id").agg(*[F.first(F.when(F.col("term") == t, counted), True).alias(f"p{i}") for i, t in enumerate(terms)])
    held = held.dropna(subset=[f"p{i}" for i in range(len(terms))])
    if len(terms) == 1:
        # occurrences weigh the same, so the heaviest is the first
        parts = F.transform(F.sequence(F.lit(1), F.size("p0")), lambda j: F.lit(WEIGHT) / (j * j))
        rank = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / ZETA
    else:
        apart = F.lit(1.0)
        for i in range(len(terms)):
            for j in range(i):
                apart = apart * pair_closeness(F.col(f"p{i}"), F.col(f"p{j}"))
        rank = F.greatest(1.0 - apart, F.lit(1e-20))
    return held.select("id", rank.cast("float").cast("double").alias("rank"))  # ranks are of single precision


def recall(m: DataFrame, query: str, now: Column, k: int = 10, index: Index | None = None, config: str = "english", org=None) -> DataFrame:
    """The k memories of highest rank that hold all terms of the query, ties by created_at and id, with lexical = min(rank, 1)
    and relevance_score of .70 lexical, .20 importance and .10 recency.

    With an index the postings come from its folders. It is that of a snapshot: memories that were forgotten since drop out
    by the join with m, changed contents must have been added under it anew."""
    config = index.config if index else config
    terms = asked(query, config)
    if not terms:
        return m.limit(0).withColumn("lexical", F.lit(0.0)).withColumn("relevance_score", F.lit(0.0))
    rows = read(index, m.sparkSession, terms, org) if index else postings(m, config, terms)
    found = ranked(rows, terms).select(F.col("id").alias("r_id"), "rank")
    # ids and times alone meet the ranks; contents are read for the k best
    best = m.select("id", "created_at").join(found, F.col("id") == F.col("r_id")).orderBy(F.col("rank").desc(), F.col("created_at").desc(), "id").limit(k)
    top = m.join(F.broadcast(best.select("r_id", "rank")), F.col("id") == F.col("r_id"))
    lexical = F.least(F.col("rank"), F.lit(1.0))
    score = 0.7 * lexical + 0.2 * F.col("importance_score") + 0.1 * sc.recency(now, F.col("created_at"))
    return top.withColumn("lexical", lexical).withColumn("relevance_score", score).orderBy(F.col("rank").desc(), F.col("created_at").desc(), "id").select(*m.columns, "lexical", "relevance_score")
