"""The graph of memories and relationships: walks, components, matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, label, weight): an edge for each direction, so that a walk is one hash join."""
    one = edges.select(F.col("source_memory_id").alias("src"), F.col("target_memory_id").alias("dst"), F.col("relationship_type").alias("label"), "weight")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight"))


def reach(seeds: DataFrame, edges: DataFrame, hops: int, key: str | None = None) -> DataFrame:
    """(key, id, hop): nodes within so many hops of seeds (key, id), at their smallest hop; seeds have hop 0."""
    steps = both_ways(edges).select("src", "dst")  # met by the front as they are: what repeats goes with the front's own rows
    by = [key] if key else []
    found = seeds.select(*by, "id", F.lit(0).alias("hop"))
    front = found
    for h in range(1, hops + 1):
        near = front.join(steps, front["id"] == steps["src"]).select(*by, F.col("dst").alias("id")).distinct()
        front = cut(near.join(found.select(*by, "id"), [*by, "id"], "left_anti").withColumn("hop", F.lit(h)))
        found = found.unionByName(front)
        if front.isEmpty():
            break
    return found


def chains(edges: DataFrame, start, label: str, depth: int) -> DataFrame:
    """(target, depth) of each directed path of a label from start, a row for each path."""
    e = edges.filter(F.col("relationship_type") == label).select(F.col("id").alias("edge"), F.col("source_memory_id").alias("s"), F.col("target_memory_id").alias("t"))
    front = e.filter(F.col("s") == start).select(F.col("t").alias("target"), F.array("edge").alias("path"))
    out = front.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        front = front.join(e, (F.col("target") == F.col("s")) & ~F.array_contains("path", F.col("edge"))).select(F.col("t").alias("target"), F.concat("path", F.array("edge")).alias("path"))
        out = out.unionByName(front.withColumn("depth", F.lit(d)))
    return out.select("target", "depth")


def shortest_path(edges: DataFrame, start, end, most: int) -> DataFrame:
    s = edges.sparkSession
    return reach(s.createDataFrame([(start,)], "id long"), edges, most).filter(F.col("id") == end).select(F.col("hop").cast("long").alias("length"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges reach; labels fall to neighbours' and jump to their label's label."""
    steps = cut(both_ways(edges).select("src", "dst").distinct())
    labels = steps.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("c"))
    while True:
        near = steps.join(labels.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        low = cut(labels.join(near, "id").select("id", F.least("c", "m").alias("c"), F.col("c").alias("old")))
        up = low.select(F.col("id").alias("c"), F.col("c").alias("top"))
        new = cut(low.join(up, "c").select("id", F.col("top").alias("c"), "old"))
        if new.filter("c <> old").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        labels = new.select("id", "c")


def orphans(m: DataFrame, edges: DataFrame) -> DataFrame:
    return m.join(both_ways(edges).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def contradictions(edges: DataFrame, memory_id=None) -> DataFrame:
    x = both_ways(edges).filter(F.col("label") == "contradicts")
    return (x.filter(F.col("src") == memory_id) if memory_id is not None else x).select("src", "dst").distinct()


def graph_recall(seeds: DataFrame, edges: DataFrame, hops: int, most: int = 50) -> DataFrame:
    """Seeds (id, similarity, importance_score) with the richness of their surroundings and a fused score."""
    walk = reach(seeds.select(F.col("id").alias("seed"), "id"), edges, hops, "seed").filter("hop > 0")
    walk = walk.withColumn("rn", F.row_number().over(W.partitionBy("seed").orderBy("hop", "id"))).filter(F.col("rn") <= most)
    nodes = walk.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    mine = both_ways(edges).join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    steps = mine.groupBy(F.col("src").alias("seed")).agg(F.least(F.count("*"), F.lit(most)).alias("n_edges"))
    x = seeds.join(nodes.withColumnRenamed("seed", "s1"), F.col("id") == F.col("s1"), "left").join(steps.withColumnRenamed("seed", "s2"), F.col("id") == F.col("s2"), "left").fillna(0, ["n_nodes", "n_edges"])
    rich = F.least(F.lit(1.0), (F.col("n_nodes") + F.col("n_edges")) / 10)
    return x.withColumn("richness", rich).withColumn("relevance_score", 0.5 * F.col("similarity") + 0.3 * F.col("richness") + 0.2 * F.col("importance_score")).drop("s1", "s2")


def context(seeds: DataFrame, m: DataFrame, edges: DataFrame, hops: int, most: int = 50) -> DataFrame:
    """seeds (id, ...) with graph_context: the nodes (id, memory_type) within so many hops, nearest and smallest id first, and the
    distinct edges (type, target) that meet the seed, at most so many of each, all among current memories (id, memory_type)."""
    live = m.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("n_id"), "memory_type")
    ids = live.select("n_id")
    inside = edges.join(ids, F.col("source_memory_id") == F.col("n_id"), "left_semi").join(ids, F.col("target_memory_id") == F.col("n_id"), "left_semi")
    walk = reach(seeds.select(F.col("id").alias("seed"), "id"), inside, hops, "seed").filter("hop > 0").join(live, F.col("id") == F.col("n_id"))
    walk = walk.select("seed", F.col("id").alias("node"), "memory_type", "hop")
    ends = both_ways(inside).join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    ends = ends.select(F.col("src").alias("end"), F.col("label").alias("type"), F.col("dst").alias("target")).distinct()
    # for each seed its own first ones: the optimiser makes ranks by seed of both
    near = walk.where(F.col("seed") == F.col("own_id").outer()).orderBy("hop", "node").limit(most)
    near = near.select(F.struct("hop", "node", "memory_type").alias("n"))
    meet = ends.where(F.col("end") == F.col("own_id").outer()).orderBy("type", "target").limit(most)
    meet = meet.select(F.struct("type", "target").alias("e"))
    own = seeds.select(F.col("id").alias("own_id"))
    nodes = own.lateralJoin(near).groupBy(F.col("own_id").alias("a_id")).agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: F.struct(n["node"].alias("id"), n["memory_type"].alias("memory_type"))).alias("nodes"))  # most a seed
    met = own.lateralJoin(meet).groupBy(F.col("own_id").alias("b_id")).agg(F.array_sort(F.collect_list("e")).alias("edges"))  # most a seed
    x = seeds.join(nodes, F.col("id") == F.col("a_id"), "left").join(met, F.col("id") == F.col("b_id"), "left").drop("a_id", "b_id")
    kinds = dict(nodes.dtypes) | dict(met.dtypes)
    full = lambda c: F.coalesce(c, F.array().cast(kinds[c]))
    return x.withColumn("graph_context", F.struct(full("nodes").alias("nodes"), full("edges").alias("edges"))).drop("nodes", "edges")


def triplet_match(m: DataFrame, edges: DataFrame, known: str, label: str | None) -> DataFrame:
    """Ends of undirected edges of a label whose other end's preview holds a text."""
    start = m.filter(F.lower(F.left("content", F.lit(200))).contains(known.lower())).select(F.col("id").alias("src"))
    steps = both_ways(edges) if label is None else both_ways(edges).filter(F.col("label") == label)
    return steps.join(start, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def code_recall(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Walk from seeds; the score falls with the smallest hop: .7 max(0, 1 - h / (hops + 1))."""
    return reach(seeds, edges, hops).withColumn("walk_score", 0.7 * F.greatest(F.lit(0.0), 1 - F.col("hop") / F.lit(hops + 1.0)))


def contradiction_counts(edges: DataFrame) -> DataFrame:
    """(id, n): how many others each memory contradicts or is contradicted by."""
    return contradictions(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def concept_recall(m: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Current memories an edge away from concepts (id)."""
    near = both_ways(edges).join(concepts.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return near.join(m.filter(F.col("deleted_at").isNull()).select("id"), "id", "left_semi")


def subgraph(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges whose ends are both among ids: those of a session, or of what held at a time."""
    ids = inside.select(F.col("id").alias("in_id")).distinct()
    return edges.join(ids, F.col("source_memory_id") == F.col("in_id"), "left_semi").join(ids, F.col("target_memory_id") == F.col("in_id"), "left_semi")
