"""The recall dispatcher: strategies by name, routing, reranking, filters, counters and the audit row of one call."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import scalar as sc
from ..operators import graph, inverted, memory, mutations
from ..operators.cuts import cut
from . import cypher
from .gateway import Gateway


class UnknownStrategyError(ValueError):
    """No strategy of that name."""


class CypherDisabledError(PermissionError):
    """Raw graph queries aren't allowed here."""


@dataclass
class Request:
    """One call of recall. embedding is the query's vector, as a literal column."""

    org: Any
    query: str = ""
    embedding: Column | None = None
    strategy: str = "AUTO"
    agent: Any = None
    user: Any = None
    memory_type: str | None = None
    metadata: dict | None = None
    between: tuple | None = None
    as_of: Column | None = None
    top_k: int = 10
    threshold: float = 0.0
    weights: tuple[float, float, float] = sc.WEIGHTS
    tier_route: bool = False
    role: str | None = None
    extra: dict = field(default_factory=dict)


#: The strategies that AUTO may pick, and those of them that need edges.
CANDIDATES = ("VECTOR", "LEXICAL", "GRAPH", "TRIPLET", "TEMPORAL", "TRACE", "ASK")
NEEDS_EDGES = ("GRAPH", "TRIPLET", "ASK")
STRATEGIES: dict[str, Callable[[Engine, Request], DataFrame]] = {}


def strategy(name: str):
    def add(f):
        STRATEGIES[name] = f
        return f

    return add


class Engine:
    """Memories, relationships and memo versions of a snapshot, with a clock and injected providers."""

    def __init__(self, m: DataFrame, edges: DataFrame, now: Column, gateway: Gateway | None = None, versions: DataFrame | None = None, allow_cypher: bool = False, rules: tuple = (), reranker: Callable[[str], Column] | None = None, index: inverted.Index | None = None):
        self.m, self.edges, self.now, self.gateway, self.versions = m, edges, now, gateway, versions
        self.allow_cypher, self.rules, self.reranker, self.index = allow_cypher, rules, reranker, index
        self._tiers: dict[str, list[str]] = {}
        self._probe: dict[Any, tuple[float, bool]] = {}
        self.steps: list[Callable[[int, str], None]] = []

    # --- parts ---

    def scan(self, r: Request) -> DataFrame:
        return memory.scan(self.m, r.org, r.agent, r.user, r.memory_type, r.metadata, r.between, r.as_of)

    def ask(self, system: str, user: str) -> dict[str, Any]:
        """The model's answer; nothing without a model or an answer."""
        try:
            return self.gateway.complete(system, user) if self.gateway else {}
        except Exception:
            return {}

    def has_edges(self, org, ttl: float = 60.0) -> bool:
        """Whether a tenant has edges, known for a minute."""
        at, known = self._probe.get(org, (0.0, False))
        if time.monotonic() - at > ttl or org not in self._probe:
            known = not self.edges.filter(F.col("org_id") == F.lit(org)).isEmpty()
            self._probe[org] = (time.monotonic(), known)
        return known

    def tiers(self, query: str) -> list[str]:
        """Memory types for a query: one pattern's, else the model's first three, else all patterns', else all."""
        key = query.strip().casefold()
        if key in self._tiers:
            return self._tiers[key]
        hits = list(dict.fromkeys(t for t, p in sc.TIER_PATTERNS if re.search(p, key)))
        if len(hits) != 1 and key:
            told = [t for x in self.ask("tiers", query).get("tiers", []) if (t := str(x).strip().lower()) in mutations.MEMORY_TYPES]
            hits = list(dict.fromkeys(told))[:3] or hits
        hits = hits or ["working", "episodic", "semantic", "procedural"]
        if key:
            self._tiers[key] = hits
        return hits

    def rows_of(self, r: Request, ids: DataFrame) -> DataFrame:
        """Current memories of a tenant by ids (id, rank), with relevance 1 / rank."""
        held = self.m.filter((F.col("org_id") == F.lit(r.org)) & F.col("deleted_at").isNull())
        return held.join(F.broadcast(ids.select(F.col("id").alias("r_id"), "rank")), F.col("id") == F.col("r_id")).withColumn("relevance_score", F.round(1 / F.col("rank"), 4)).drop("r_id", "rank")  # at most top_k ids

    # --- the call ---

    def route(self, r: Request) -> str:
        told = str(self.ask("strategy", r.query).get("strategy", "VECTOR")).upper()
        name = told if told in CANDIDATES else "VECTOR"
        return "VECTOR" if name in NEEDS_EDGES and not self.has_edges(r.org) else name

    def recall(self, r: Request) -> tuple[DataFrame, dict[str, Any]]:
        """(rows with relevance_score, what was done). Weights must sum to 1."""
        if abs(sum(r.weights) - 1) > 0.01:
            raise ValueError("weights must sum to 1")
        name = r.strategy.upper()
        if name != "AUTO" and name not in STRATEGIES:
            raise UnknownStrategyError(r.strategy)
        name = self.route(r) if name == "AUTO" else name
        if r.tier_route and name == "VECTOR" and r.embedding is not None:
            rows = memory.tier_fanout(self.scan(r), r.embedding, self.now, self.tiers(r.query), r.top_k)
        else:
            rows = STRATEGIES[name](self, r)
        if self.reranker is not None:
            rows = memory.rerank(rows, self.reranker(r.query), r.top_k)
        if self.rules:
            rows = redacted_rows(rows, self.rules)
        return rows, {"strategy": name, "audit": {"org_id": r.org, "operation": "recall", "details": {"strategy": name, "top_k": r.top_k}}}

    def counted(self, rows: DataFrame) -> DataFrame:
        """The memories after a call: recall_count and last_recalled_at of its rows."""
        return memory.bump_recalls(self.m, rows.select("id", self.now.alias("at")))


def redacted_rows(rows: DataFrame, rules: tuple) -> DataFrame:
    """Content, summary and every text inside metadata, by the rules."""
    for c in ("content", "summary"):
        if c in rows.columns:
            rows = rows.withColumn(c, sc.redacted(F.col(c), rules))
    return rows.withColumn("metadata", jsons.scrubbed(F.col("metadata"), rules)) if "metadata" in rows.columns else rows


def nothing(engine: Engine) -> DataFrame:
    return engine.m.limit(0).withColumn("relevance_score", F.lit(0.0))


@strategy("VECTOR")
def vector(engine: Engine, r: Request) -> DataFrame:
    rows = engine.scan(r)
    if r.embedding is None:
        return memory.recall_fallback(rows, engine.now, r.top_k)
    return memory.recall_vector(rows, r.embedding, engine.now, r.top_k, r.threshold, r.weights)


@strategy("LEXICAL")
def lexical(engine: Engine, r: Request) -> DataFrame:
    """By full-text rank, from the engine's index where it has one (extra: ts_config, english or simple, where it hasn't)."""
    config = r.extra.get("ts_config", "english")
    return inverted.recall(engine.scan(r), r.query, engine.now, r.top_k, engine.index, config, r.org) if r.query.strip() else nothing(engine)


@strategy("GRAPH")
def graph_strategy(engine: Engine, r: Request) -> DataFrame:
    if r.embedding is None:
        return nothing(engine)
    seeds = memory.recall_vector(engine.scan(r), r.embedding, engine.now, 3, max(r.threshold, -1.0), r.weights).drop("relevance_score")
    own = F.col("org_id") == F.lit(r.org)
    x = graph.context(cut(seeds), engine.m.filter(own), engine.edges.filter(own), int(r.extra.get("hops", 2)))
    rich = F.least(F.lit(1.0), (F.size("graph_context.nodes") + F.size("graph_context.edges")) / 10)
    x = x.withColumn("relevance_score", 0.5 * F.col("similarity") + 0.3 * rich + 0.2 * F.col("importance_score"))
    if engine.gateway is not None and r.query.strip() and "metadata" in x.columns:
        x = cut(x)
        known = x.orderBy(F.col("similarity").desc(), "id").select(F.left("content", F.lit(200)), F.to_json("graph_context")).collect()  # three seeds
        answer = engine.ask("graph", "\n".join([r.query, *(f"- {c}: {g}" for c, g in known)])).get("answer")
        if answer:  # rides on the nearest seed
            first = x.orderBy(F.col("similarity").desc(), "id").limit(1).select(F.col("id").alias("f_id"))
            told = jsons.merged(F.col("metadata"), F.to_json(F.struct(F.lit(str(answer)).alias("graph_answer"))))
            x = x.join(F.broadcast(first), F.col("id") == F.col("f_id"), "left").withColumn("metadata", F.when(F.col("f_id").isNotNull(), told).otherwise(F.col("metadata"))).drop("f_id")  # one row
    return x.orderBy(F.col("similarity").desc(), "id").limit(r.top_k)


@strategy("TRIPLET")
def triplet(engine: Engine, r: Request) -> DataFrame:
    """Subject, predicate and object, one of them '?', told by the caller or the model; the unknown end's memories."""
    t = r.extra.get("triplet") or engine.ask("triplet", r.query).get("triplet")
    if not t or len(t) != 3 or sum(x == "?" for x in t) != 1:
        return nothing(engine)
    known = next(x for x in (t[0], t[2]) if x != "?")
    ids = graph.triplet_match(engine.scan(r), engine.edges.filter(F.col("org_id") == F.lit(r.org)), known, None if t[1] == "?" else t[1])
    ranked = ids.orderBy("id").limit(r.top_k)
    rows = engine.scan(r).join(F.broadcast(ranked), "id")  # at most top_k ids
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy("id"))  # top_k rows
    return rows.withColumn("relevance_score", 0.6 / place + 0.25 * F.col("importance_score") + 0.15 * sc.recency(engine.now, F.col("created_at"))).orderBy(F.col("relevance_score").desc(), "id")


@strategy("TEMPORAL")
def temporal(engine: Engine, r: Request) -> DataFrame:
    """VECTOR over what held at a time (given, or an ISO time of the model's), with that time and the memo's version then."""
    at = r.as_of
    if at is None and (told := engine.ask("timestamp", r.query).get("timestamp")):
        at = sc.iso_timestamp(F.lit(str(told))).cast("timestamp_ntz")
    if at is None:
        return nothing(engine)
    rows = vector(engine, Request(**{**r.__dict__, "as_of": at, "strategy": "VECTOR"})).withColumn("temporal_as_of", at)
    if engine.versions is not None:
        v = memory.memo_as_of(rows.select("id").distinct(), engine.versions, at).withColumnRenamed("version", "memo_version")
        rows = rows.join(v, "id", "left")
    return rows


@strategy("CODE")
def code(engine: Engine, r: Request) -> DataFrame:
    """Code memories that hold the query, and what the walk over code edges reaches from them."""
    rows = engine.scan(r)
    seeds = rows.filter(F.col("memo_type").startswith("CODE_") & F.lower("content").contains(r.query.lower())).orderBy(F.col("importance_score").desc(), "id").limit(r.top_k)
    hops = int(r.extra.get("hops", 2))
    edges = engine.edges.filter(F.col("org_id") == F.lit(r.org))
    if "metadata" in edges.columns:
        edges = edges.filter(jsons.has_key(F.col("metadata"), "codegraph_kind"))
    walk = graph.code_recall(seeds, edges, hops).select(F.col("id").alias("w_id"), "hop", "walk_score")
    return rows.join(walk, F.col("id") == F.col("w_id")).withColumn("relevance_score", F.col("walk_score") + 0.3 * F.col("importance_score")).drop("w_id").orderBy("hop", F.col("importance_score").desc(), "id").limit(r.top_k)


@strategy("TRACE")
def trace(engine: Engine, r: Request) -> DataFrame:
    """Up to three rounds of VECTOR, the model's refined embedding in between (extra: refine, a function of the round's rows); the best of each id."""
    steps, asked = None, r
    for k in range(int(r.extra.get("steps", 3))):
        found = vector(engine, Request(**{**asked.__dict__, "top_k": 5, "strategy": "VECTOR"})).withColumn("step", F.lit(k))
        steps = found if steps is None else steps.unionByName(found)
        for told in engine.steps:
            told(k, asked.query)
        refine = r.extra.get("refine")
        again = refine(k, asked) if refine else None
        if again is None:
            break
        asked = again
    return memory.trace_merge(steps).orderBy(F.col("relevance_score").desc(), "id").limit(r.top_k)


def _graph_query(engine: Engine, r: Request, query: str, label: str) -> DataFrame:
    nodes, edges = mutations.mirror(engine.m.filter(F.col("org_id") == F.lit(r.org)), engine.edges.filter(F.col("org_id") == F.lit(r.org)))
    values = cypher.answers(query, nodes, edges, r.top_k)
    if dict(values.dtypes)["value"] == "double":  # an aggregate: one made-up row
        made = values.select(F.lit(0).cast(dict(engine.m.dtypes)["id"]).alias("id"), F.concat(F.lit(f"{label} aggregate result: "), F.col("value").cast("string")).alias("content"), F.lit(1.0).alias("relevance_score"), F.col("value").alias("aggregate"))
        return made
    from pyspark.sql import Window as W

    # ids of all returned items, each at its first place
    each = F.explode(F.array_compact(F.array(*[F.col(c) for c in values.columns if c != "place"])))
    ids = values.select(each.alias("id"), "place").groupBy("id").agg(F.min("place").alias("place"))
    ids = ids.withColumn("rank", F.row_number().over(W.orderBy("place", "id"))).drop("place").limit(r.top_k)  # a few for each of at most top_k rows
    return engine.rows_of(r, ids).orderBy(F.col("relevance_score").desc(), "id")


@strategy("ASK")
def ask(engine: Engine, r: Request) -> DataFrame:
    query = r.extra.get("cypher") or engine.ask("cypher", r.query).get("cypher", "")
    try:
        return _graph_query(engine, r, query, "ASK")
    except cypher.CypherError:
        return nothing(engine)


@strategy("CYPHER")
def raw_cypher(engine: Engine, r: Request) -> DataFrame:
    if not engine.allow_cypher:
        raise CypherDisabledError("raw graph queries are disabled")
    return _graph_query(engine, r, r.extra.get("raw_cypher", ""), "CYPHER")
