"""Column builders for scores, times, names and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of similarity, importance and recency; personal-data rules (name, pattern, mark) in their order.
WEIGHTS = (0.60, 0.25, 0.15)
REDACTIONS = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[REDACTED:EMAIL]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:SSN]"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b", "[REDACTED:CARD]"),
    ("phone_us", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED:PHONE]"),
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def recency(now: Column, created: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(1.0) / F.greatest(days_between(now, created), F.lit(0.01)))


def decayed(score: Column, days: Column, rate: float, floor: float, curve: str = "exponential") -> Column:
    """Importance after so many days under one of three curves: exponential, logarithmic (divided by 1 + rate * ln(1 + days)), or a step (halved from 1 / rate days on)."""
    d = F.greatest(days, F.lit(0.0))
    left = {"exponential": score * F.exp(-F.lit(rate) * d), "logarithmic": score / (1 + F.lit(rate) * F.log1p(d)), "step": F.when(d < 1 / rate, score).otherwise(score * 0.5)}[curve]
    return F.greatest(F.lit(floor), left)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normal_name(x: Column) -> Column:
    """Lower case, without white space (of any script) at the ends and with one space for a run of it inside."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def rules_for(role: str | None, by_role: dict[str, tuple] | None = None, fallback: str = "", defaults: tuple = REDACTIONS) -> tuple:
    """Rules of a role before the defaults; an unknown role has those of the fallback role, no role the defaults alone."""
    if not role:
        return defaults
    by_role = by_role or {}
    return (*by_role.get(role, by_role.get(fallback, ()) if fallback else ()), *defaults)


def redacted(text: Column, rules: tuple[tuple[str, str, str], ...] = REDACTIONS) -> Column:
    """Each rule's matches replaced by its mark, rule by rule; a text without a sign that all matches hold is passed over."""
    signs = {"email": lambda t: t.contains("@"), "ssn": lambda t: t.rlike(r"\d{3}-"), "credit_card": lambda t: t.rlike(r"(?:\d[ -]?){13}"), "phone_us": lambda t: t.rlike(r"\d{3}[-.\s]?\d{4}")}
    for name, pattern, mark in rules:
        new = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
        text = F.when(signs[name](text), new).otherwise(text) if name in signs and (name, pattern, mark) in REDACTIONS else new
    return text


def safe_label(x: Column) -> Column:
    """Lower-case letters a-z, digits and underscores, another character an underscore, none at the ends; related_to when nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    return F.when((clean == "") | clean.isNull(), F.lit("related_to")).otherwise(clean)


def safe_identifier(x: Column) -> Column:
    """Whether a name is letters, digits and underscores with no digit first."""
    return F.coalesce(x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def local_name(uri: Column) -> Column:
    """What follows the last # or, without one, the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def entity_content(name: Column, kind: Column, description: Column) -> Column:
    """name (type), followed by a dash and the description where there is one."""
    head = F.concat(name, F.lit(" ("), kind, F.lit(")"))
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(" \u2014 "), description)).otherwise(head)


def vector_literal(v: Column) -> Column:
    """[x,y,...] of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def iso_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text, with Z or an offset; null where it is none."""
    return F.try_to_timestamp(F.trim(text))


#: Heuristics of the memory tiers, each with its pattern, in order.
TIER_PATTERNS = (
    ("procedural", r"(?i)\bhow\s+(do|can|should)\s+i\b"),
    ("procedural", r"(?i)\b(steps?\s+to|procedure\s+for|recipe|workflow)\b"),
    ("procedural", r"(?i)\bhow\s+to\s+\w+"),
    ("episodic", r"(?i)\b(yesterday|today|this morning|earlier|last (week|month|quarter|year)|this (week|month|year)|recent(ly)?|when did|when were|on \d{4}-\d{2}-\d{2})\b"),
    ("episodic", r"(?i)\bwhat (did|happened|occurred)\b"),
    ("working", r"(?i)\b(current(ly)?|right now|in this (session|chat|conversation)|in progress|so far)\b"),
    ("semantic", r"(?i)\b(prefer(s|ence)?|likes?|favou?rite|always|usually|tends? to|what (is|are)|who (is|are)|where (is|are)|why)\b"),
)


def tiers(query: Column) -> Column:
    """Tiers whose patterns a query meets; all four when none does."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(query.rlike(p), F.lit(t)) for t, p in TIER_PATTERNS])))
    return F.when(F.size(hits) == 0, F.array(*[F.lit(t) for t in ("working", "episodic", "semantic", "procedural")])).otherwise(hits)


#: Keywords that a read-only graph query may not hold.
WRITING = ("CREATE", "MERGE", "DELETE", "DETACH", "REMOVE", "SET", "DROP", "CALL", "LOAD", "EXECUTE", "USING", "GRANT", "REVOKE")


def read_only(query: Column) -> Column:
    """Whether a graph query only reads: it starts with MATCH, RETURN or WITH after its comments and has no writing keyword or dollar quote; null: false."""
    bare = F.regexp_replace(F.regexp_replace(query, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    ok = bare.rlike(r"(?i)^\s*(MATCH|RETURN|WITH)\b") & ~bare.rlike(rf"(?i)\b({'|'.join(WRITING)})\b") & ~query.contains("$$")
    return F.coalesce(ok, F.lit(False))


def artifact_key(org: Column, at: Column, uid: Column, name: Column) -> Column:
    """org/YYYY/MM/uid.ext; without an extension of letters and digits, no suffix."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(org.cast("string"), F.lit("/"), F.date_format(at, "yyyy/MM"), F.lit("/"), uid.cast("string"), F.when(F.length(ext) > 0, F.concat(F.lit("."), ext)).otherwise(F.lit("")))
