"""Read-only graph queries of one pattern, compiled to DataFrames over the mirror's nodes and edges.

MATCH (a:Memory)-[r:label*1..3]->(b) WHERE a.id = 7 AND b.memory_type = 'semantic' RETURN b.id, a.id | count(*) ... ORDER BY
b.id DESC LIMIT n. Nodes have the properties of the mirror (id, org_id, memory_type, preview); a direction or a label may be
left out. A row stands for a path, and no path takes an edge twice; nulls are the greatest values. Nodes without a label of
their own are all of label Memory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import WRITING


class CypherError(ValueError):
    """A query that isn't allowed or not understood."""


def validate(query: str) -> None:
    """Raises unless a query starts with MATCH, RETURN or WITH after its comments and holds no writing keyword and no dollar quote."""
    if not (query or "").strip():
        raise CypherError("empty query")
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", " ", query, flags=re.S).strip()
    if not re.match(r"(MATCH|RETURN|WITH)\b", bare, re.I):
        raise CypherError("must start with MATCH / RETURN / WITH")
    if found := re.search(rf"\b({'|'.join(WRITING)})\b", query, re.I):
        raise CypherError(f"forbidden keyword: {found.group(1).upper()}")
    if "$$" in query:
        raise CypherError("must not hold '$$'")


_NODE = r"\(\s*(?P<{0}>\w*)\s*(?::\s*(?P<{0}_label>\w+))?\s*\)"
_QUERY = re.compile(
    r"MATCH\s+" + _NODE.format("a") + r"(?:\s*(?P<left><)?-\s*(?:\[\s*\w*\s*(?::\s*(?P<label>\w+))?\s*(?:\*\s*(?P<lo>\d+)?(?P<dots>\.\.)?(?P<hi>\d+)?)?\s*\])?\s*-(?P<right>>)?\s*" + _NODE.format("b") + r")?"
    r"(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<what>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)
_TEST = re.compile(r"^\s*(?P<var>\w+)\.(?P<key>\w+)\s*(?P<op>=|<>|<=|>=|<|>|CONTAINS|STARTS\s+WITH)\s*(?P<value>'[^']*'|-?\d+(?:\.\d+)?)\s*$", re.I)
MOST_HOPS = 10


def _literal(text: str):
    return text[1:-1] if text.startswith("'") else float(text) if "." in text else int(text)


def _test(text: str, columns: dict[str, str]) -> Column:
    m = _TEST.match(text)
    if not m or m["var"] not in columns:
        raise CypherError(f"not understood: {text.strip()}")
    c, v = F.col(f"{columns[m['var']]}_{m['key']}"), F.lit(_literal(m["value"]))
    op = re.sub(r"\s+", " ", m["op"].upper())
    return {"=": lambda: c == v, "<>": lambda: c != v, "<": lambda: c < v, ">": lambda: c > v, "<=": lambda: c <= v, ">=": lambda: c >= v, "CONTAINS": lambda: c.contains(v), "STARTS WITH": lambda: c.startswith(v)}[op]()


def _labelled(nodes: DataFrame, label: str | None) -> DataFrame:
    if label is None:
        return nodes
    if "label" in nodes.columns:
        return nodes.filter(F.lower("label") == label.lower())
    return nodes if label.lower() == "memory" else nodes.limit(0)


def _paths(rows: DataFrame, edges: DataFrame, m: re.Match, pattern: str) -> DataFrame:
    """rows (with a_id) with the end of each path as 'at'."""
    e = edges if m["label"] is None else edges.filter(F.lower("label") == m["label"].lower())
    # edges without an id are told by all they hold
    e = e.select("src", "dst", (F.col("id") if "id" in e.columns else F.xxhash64(*e.columns)).cast("long").alias("edge"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge")
    steps = back if m["left"] else e if m["right"] else e.unionByName(back.filter("src <> dst"))
    star = "*" in pattern[pattern.index("[") : pattern.index("]")] if "[" in pattern else False
    lo = int(m["lo"] or 1) if star else 1
    hi = int(m["hi"] or (MOST_HOPS if m["dots"] or not m["lo"] else m["lo"])) if star else 1
    if hi > MOST_HOPS:
        raise CypherError(f"at most {MOST_HOPS} hops")
    front = rows.withColumn("at", F.col("a_id")).withColumn("used", F.array().cast("array<long>"))
    reached = front if lo == 0 else None
    for hop in range(1, hi + 1):
        front = front.join(steps, front["at"] == steps["src"]).filter(~F.array_contains("used", F.col("edge")))
        front = front.withColumn("at", F.col("dst")).withColumn("used", F.array_append("used", F.col("edge"))).drop("src", "dst", "edge")
        if hop >= lo:
            reached = front if reached is None else reached.unionByName(front)
    if reached is None:
        raise CypherError("a path has no length")
    return reached.drop("used")


_ITEM = re.compile(r"(\w+)(?:\.(\w+))?(?:\s+AS\s+(\w+))?$", re.I)
_AGGREGATE = re.compile(r"(count|avg|sum|min|max)\s*\(\s*(DISTINCT\s+)?(?:\*|(\w+)(?:\.(\w+))?)\s*\)(?:\s+AS\s+\w+)?$", re.I)


def answers(query: str, nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Rows of a validated query: value (and value2 and so on for further items) with place from 1 on, or a single aggregate."""
    validate(query)
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", " ", query, flags=re.S).strip()
    m = _QUERY.match(bare)
    if not m:
        raise CypherError("only MATCH of one pattern with RETURN is understood")
    side = lambda s, label: _labelled(nodes, label).select(*[F.col(c).alias(f"{s}_{c}") for c in nodes.columns])
    names = {m["a"]: "a"}
    tests = re.split(r"\s+AND\s+", m["where"], flags=re.I) if m["where"] else []
    rows = side("a", m["a_label"])
    if m["b"] is not None:
        if m["a"] and m["a"] == m["b"]:
            raise CypherError("both ends have one name")
        names[m["b"]] = "b"
        # tests of the first node come before the walk, so that it starts from few
        early = [t for t in tests if (x := _TEST.match(t)) and x["var"] == m["a"]]
        for t in early:
            rows = rows.filter(_test(t, {m["a"]: "a"}))
        tests = [t for t in tests if t not in early]
        rows = _paths(rows, edges, m, bare).join(side("b", m["b_label"]), F.col("at") == F.col("b_id"))
    for t in tests:
        rows = rows.filter(_test(t, names))
    what = m["what"].strip()
    if counted := _AGGREGATE.match(what):
        f = counted[1].lower()
        if counted[3] is None:
            if f != "count" or counted[2]:
                raise CypherError(f"not understood: RETURN {what}")
            return rows.agg(F.count("*").cast("double").alias("value")).withColumn("place", F.lit(1))
        c = _property(counted[3], counted[4], names, rows)
        return rows.agg((F.count_distinct(c) if counted[2] and f == "count" else getattr(F, f)(c)).cast("double").alias("value")).withColumn("place", F.lit(1))
    single = re.match(r"DISTINCT\s+", what, re.I)
    items, known = {}, {}
    for k, item in enumerate((what[single.end() :] if single else what).split(",")):
        x = _ITEM.match(item.strip())
        if not x:
            raise CypherError(f"not understood: RETURN {what}")
        name = f"value{k + 1}" if k else "value"
        items[name] = _property(x[1], x[2], names, rows)
        known |= {f"{x[1]}.{x[2] or 'id'}".lower(): name, (x[3] or "").lower(): name}
    keys = []
    for k, item in enumerate(m["order"].split(",") if m["order"] else ()):
        x = re.match(r"(\w+)(?:\.(\w+))?(?:\s+(ASC|DESC)(?:ENDING)?)?$", item.strip(), re.I)
        if not x:
            raise CypherError(f"not understood: ORDER BY {item}")
        name = known.get(x[1].lower() if x[2] is None and x[1].lower() in known else f"{x[1]}.{x[2] or 'id'}".lower())
        if name is None:
            if single:
                raise CypherError("DISTINCT rows are ordered by what is returned")
            name = f"key{k}"
            rows = rows.withColumn(name, _property(x[1], x[2], names, rows))
        keys.append((name, (x[3] or "asc").lower() == "desc"))
    out = rows.select(*[c.alias(n) for n, c in items.items()], *[n for n, _ in keys if n not in items])
    out = out.distinct() if single else out
    order = [F.col(n).desc_nulls_first() if down else F.col(n).asc_nulls_last() for n, down in keys] + [F.col(n).asc_nulls_last() for n in items]
    few = out.orderBy(*order).limit(min(limit, int(m["limit"] or limit)))
    return few.withColumn("place", F.row_number().over(W.orderBy(*order))).select(*items, "place")  # limit rows


def _property(var: str, key: str | None, names: dict[str, str], rows: DataFrame) -> Column:
    if var not in names or f"{names[var]}_{key or 'id'}" not in rows.columns:
        raise CypherError(f"not understood: {var}{'.' + key if key else ''}")
    return F.col(f"{names[var]}_{key or 'id'}")


def run(query: str, nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Rows (value, value2 ...) of a validated query, in order: ids as they are, or a single aggregate."""
    return answers(query, nodes, edges, limit).orderBy("place").drop("place")
