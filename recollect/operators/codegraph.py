"""Code graphs: modules, classes, functions and imports of Python, TypeScript, Go and Rust sources, and the edges between them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codelex
from .cuts import dealt


def symbols(path: str, source: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(kind, qualified name, name) of a source's symbols, and (kind, from, to) edges; names outside it are bare.

    The language is told by the path's extension; Python where it is no known one. Broken Python sources have a module alone."""
    stem, _, extension = path.rpartition(".")
    if extension in codelex.EXTENSIONS:
        return codelex.symbols(codelex.EXTENSIONS[extension], stem.strip("/").replace("/", "."), source)
    module = path.removesuffix(".py").strip("/").replace("/", ".")
    nodes, edges = [("MODULE", module, module.rsplit(".", 1)[-1])], []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return nodes, edges

    def called(node: ast.AST) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def walk(body: list[ast.stmt], owner: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind, name = ("CLASS" if isinstance(node, ast.ClassDef) else "FUNCTION"), f"{owner}.{node.name}"
                nodes.append((kind, name, node.name))
                edges.append(("DEFINES", owner, name))
                for base in getattr(node, "bases", []):
                    if b := called(base):
                        edges.append(("INHERITS", name, b))
                if kind == "FUNCTION":
                    inner = [x for x in node.body if not isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
                    edges.extend(("CALLS", name, c) for s in inner for x in ast.walk(s) if isinstance(x, ast.Call) and (c := called(x.func)))
                walk(node.body, name)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    nodes.append(("IMPORT", f"{module}:{a.name}", a.name))
                    edges.append(("IMPORTS", module, a.name))
            elif isinstance(node, ast.ImportFrom):
                nodes.append(("IMPORT", f"{module}:{node.module or '.'}", node.module or "."))
                edges.append(("IMPORTS", module, node.module or "."))

    walk(tree.body, module)
    return nodes, list(dict.fromkeys(edges))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, qualified_name, name, path) and (kind, source, target) of files (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["text"], strict=True):
                nodes, edges = symbols(path, source or "")
                rows += [("node", k, q, n, path) for k, q, n in nodes] + [("edge", k, a, b, path) for k, a, b in edges]
            yield pd.DataFrame(rows, columns=["what", "kind", "a", "b", "path"])

    found = dealt(files.select("path", "text"), "path").mapInPandas(run, "what string, kind string, a string, b string, path string")
    nodes = found.filter("what = 'node'").select("kind", F.col("a").alias("qualified_name"), F.col("b").alias("name"), "path")
    return nodes, found.filter("what = 'edge'").select("kind", F.col("a").alias("source"), F.col("b").alias("target"))


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with placeholders '<unresolved>.name' for ends that no symbol has, and edges between qualified names, none to itself.

    A bare name means the symbol with the smallest qualified name that has it."""
    by_name = nodes.filter(F.col("kind") != "IMPORT").groupBy("name").agg(F.min("qualified_name").alias("known"))
    full = nodes.select(F.col("qualified_name").alias("q")).distinct()
    x = edges.join(full, F.col("target") == F.col("q"), "left").join(by_name, F.col("target") == F.col("name"), "left")
    x = x.withColumn("to", F.coalesce("q", "known", F.concat(F.lit("<unresolved>."), F.col("target"))))
    out = x.select("kind", "source", F.col("to").alias("target")).filter("source <> target").distinct()
    holes = out.filter(F.col("target").startswith("<unresolved>.")).select(F.lit("UNRESOLVED").alias("kind"), F.col("target").alias("qualified_name"), F.substring_index("target", "<unresolved>.", -1).alias("name"), F.lit(None).cast("string").alias("path")).distinct()
    return nodes.unionByName(holes), out
