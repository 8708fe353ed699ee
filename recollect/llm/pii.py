"""Operator 6: personal data, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (address parts, Luhn, digit counts, mod 97), and words near
a span raise its score. A text is split at a kind's pattern; the pieces between the matches give the code-point offsets.

Defined results: null text counts as empty (no spans) and stays null in ``redact``; repeated rows give repeated results; an
empty table gives no rows; a null doc_id is a row like others; extra columns pass through untouched, but for one named
pii_spans, which ``detect`` replaces. Spans are gathered in groups of GROUP, so a text of many takes time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: Kinds in their order, base kinds first. The atomic and look-behind forms find what the plain patterns find, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: A character without which a kind can't occur: texts without it skip the pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": ""}
BASE = ("email", "ip", "card", "phone")
NEAR = 40
GROUP = 256
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
#: Score of a confirmed span without and the gain with such a word near it; a checksum weighs more than a shape.
SCORES = {"email": (0.9, 0.08), "ip": (0.6, 0.3), "card": (0.8, 0.18), "phone": (0.7, 0.25), "iban": (0.95, 0.04)}


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a proposed span of a kind passes its validator."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return n.between(12, 19) & _luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind: array of (start, rank, kind, end, match, score), by start."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    rank = list(PATTERNS).index(kind)
    low, gain = SCORES[kind]

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        near = F.lower(F.concat(F.right(x["before"], F.lit(NEAR)), F.lit(" "), F.left(x["after"], F.lit(NEAR))))
        score = F.lit(low) + F.when(near.rlike(CONTEXT[kind]), gain).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("match"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), acc["done"].alias("done"))

    kind_of = "array<struct<start:int,rank:int,kind:string,end:int,match:string,score:double>>"
    none = F.array().cast(kind_of)
    cells = F.transform(found, lambda m, i: F.struct(F.get(parts, i).alias("before"), m.alias("m"), F.get(parts, i + 1).alias("after")))
    # a step appends to a group's spans, so a group at a time is copied and not all spans so far
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / GROUP).cast("int")), lambda g: F.slice(cells, g * GROUP + 1, GROUP))
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"), F.array().cast(f"array<{kind_of}>").alias("done"))
    after = lambda acc, group: F.aggregate(group, F.struct(acc["at"].alias("at"), none.alias("spans"), F.concat(acc["done"], F.array(acc["spans"])).alias("done")), step)
    spans = F.aggregate(groups, zero, after, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["spans"]))))
    has = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
    return F.when(has & (F.size(found) > 0), spans).otherwise(none)


def detect(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with pii_spans: all confirmed spans by start and kind, offsets in code points, end exclusive."""
    docs = without(docs, "pii_spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [_spans(k, text) for k in kinds]
    return docs.withColumn("pii_spans", F.array_sort(F.concat(*arrays)))


def redact(docs: DataFrame, kinds: tuple[str, ...] = BASE) -> DataFrame:
    """docs whose texts have each confirmed span replaced by [KIND], kind by kind: what an earlier kind's marks replace is seen by no later one."""
    for kind in kinds:
        docs = docs.withColumn("text", _marked(kind, F.col("text")))
    return docs


def _marked(kind: str, text: Column) -> Column:
    mark = lambda m: F.when(confirmed(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m)
    shown = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), mark)
    new = F.array_join(F.zip_with(F.split(text, PATTERNS[kind], -1), shown, lambda part, m: F.concat(part, F.coalesce(m, F.lit("")))), "")
    has = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
    return F.when(has, new).otherwise(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    label = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", label), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
