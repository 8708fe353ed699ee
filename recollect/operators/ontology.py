"""Matches of names to the labels of an ontology that allow for small differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def indel(a: str, b: str) -> float:
    """1 - (insertions + deletions) / summed length, by a bit-parallel longest common subsequence."""
    if not a or not b:
        return float(a == b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """Likeness of two texts as sets of tokens: 1 if one's tokens are all in the other; 0 without tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 1.0
    whole_x, whole_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max([indel(whole_x, whole_y), *((indel(both, whole_x), indel(both, whole_y)) if both else ())])


def _grams(folded: Column) -> Column:
    """Keys that two texts of likeness 0.75 share: bigrams within sorted tokens' text, and characters of short texts."""
    tokens = F.array_sort(F.array_distinct(F.split(F.trim(F.regexp_replace(folded, r"\s+", " ")), " ")))
    text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) <= 9, F.concat(at(2), F.filter(at(1), lambda c: c != " "))).otherwise(at(2)))


def match(names: DataFrame, labels: DataFrame, least: float = 0.80, bonus: float = 0.05) -> DataFrame:
    """(name, type, uri, score): each distinct name's best label; names (name, type), labels (label, uri, type_hint).

    A case-folded equal label scores 1. Otherwise the score is the token-set likeness, and bonus more where the types are
    equal, up to 1; below least there is no row. Ties go to the smallest uri. Only pairs that share a bigram are compared;
    bigrams are joined on equality, so neither side is collected."""
    n = names.filter(F.trim("name") != "").select("name", "type").distinct()
    lab = labels.filter(F.trim("label") != "").select("label", "uri", "type_hint").distinct()

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    keyed = lambda x, c: x.withColumn("gram", F.explode(_grams(F.lower(c))))
    pairs = keyed(n, "name").join(keyed(lab, "label"), "gram").select("name", "type", "label", "uri", "type_hint").distinct()
    base = F.when(F.lower("name") == F.lower("label"), F.lit(1.0)).otherwise(like(F.lower("name"), F.lower("label")))
    more = F.when(F.col("type").isNotNull() & (F.lower("type") == F.lower("type_hint")), bonus).otherwise(0.0)
    scored = pairs.withColumn("score", F.least(F.lit(1.0), base + more)).withColumn("exact", F.lower("name") == F.lower("label")).filter(F.col("score") >= least)
    best = scored.groupBy("name", "type").agg(F.min(F.struct((~F.col("exact")).alias("fuzzy"), (-F.col("score")).alias("less"), "uri")).alias("b"))
    return best.select("name", "type", F.col("b.uri").alias("uri"), (-F.col("b.less")).alias("score"))
