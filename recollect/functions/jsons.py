"""JSON text columns: containment, keys, merges. Nested values are compared in Arrow batches, top-level ones natively."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(value, part) -> bool:
    """Whether a JSON value contains another: objects by keys, arrays by elements, the rest by type and value.

    A scalar is held by an array that it is an element of at the top level alone."""
    if isinstance(value, list) and not isinstance(part, dict | list):
        return any(_same(x, part) for x in value)
    return _within(value, part)


def _same(value, part) -> bool:
    return value == part and isinstance(value, bool) is isinstance(part, bool) and isinstance(value, str) is isinstance(part, str)


def _within(value, part) -> bool:
    if isinstance(part, dict):
        return isinstance(value, dict) and all(k in value and _within(value[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(value, list) and all(any(_within(x, p) for x in value) for p in part)
    return not isinstance(value, dict | list) and _same(value, part)


def _read(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def is_json(text: str) -> bool:
    """Whether a text could also be the text of a JSON value that is no string."""
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def contains(column: Column, part: dict) -> Column:
    """Whether a JSON text holds all of part, at any depth; null or broken text holds nothing."""

    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda t: (v := _read(t)) is not None and holds(v, part)).astype(bool)

    return check(column)


def has_key(column: Column, key: str) -> Column:
    """Whether a JSON object has a top-level key, also one whose value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def value_at(column: Column, key: str) -> Column:
    """Text of a top-level key, which may hold dots."""
    return F.get_json_object(column, f"$['{key}']")


def _mapped(column: Column, other: Column, f: Callable) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(f(_read(x), _read(y)), sort_keys=True, separators=(",", ":")) for x, y in zip(a, b, strict=True)])

    return run(column, other)


def merged(column: Column, other: Column) -> Column:
    """Both objects' keys, the second's values where both have one; null counts as an empty object."""
    return _mapped(column, other, lambda a, b: {**(a or {}), **(b or {})})


def appended(column: Column, path: tuple[str, ...], values: Column) -> Column:
    """The object with the elements of a JSON array added to the array at a path of keys, which is made where it isn't there."""

    def run(a, b):
        top = at = dict(a or {})
        for k in path[:-1]:
            at[k] = dict(at.get(k) or {})
            at = at[k]
        at[path[-1]] = [*(at.get(path[-1]) or []), *(b or [])]
        return top

    return _mapped(column, values, run)


def scrubbed(column: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Redaction rules on every text inside a JSON value; keys stay."""
    import re

    compiled = [(re.compile(p), m) for _, p, m in rules]

    def walk(v):
        if isinstance(v, str):
            for p, m in compiled:
                v = p.sub(m, v)
            return v
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if (v := _read(t)) is None else json.dumps(walk(v), sort_keys=True, separators=(",", ":")))

    return run(column)
